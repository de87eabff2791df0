"""Transcripts, titles and ordering of stored chats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import truncated

# Role headings of the markdown transcript.
ROLE_HEADINGS = {"user": "👤 用户", "assistant": "🦙 AI", "system": "⚙️ 系统"}
TITLE_CHARS = 32
DEFAULT_TITLE = "新对话"


def _heading(role: Column) -> Column:
    chain = None
    for name, heading in ROLE_HEADINGS.items():
        chain = F.when(role == name, heading) if chain is None else chain.when(role == name, heading)
    return chain.otherwise(role)


def transcript_markdown(title: Column, conv: Column, thinking: Column | None = None) -> Column:
    """A chat as a markdown document; ``thinking`` holds one optional note per turn."""

    def section(t: Column, note: Column | None) -> Column:
        head = F.concat(F.lit("\n## "), _heading(t["role"]), F.lit("\n"))
        body = F.concat(F.lit("\n"), F.coalesce(t["content"], F.lit("")), F.lit("\n"))
        if note is None:
            return F.concat_ws("\n", head, body)
        details = F.concat(F.lit("<details><summary>💭 思考</summary>\n\n"), note, F.lit("\n</details>\n"))
        return F.concat_ws("\n", head, F.when(F.coalesce(note, F.lit("")) != "", details), body)

    if thinking is None:
        sections = F.transform(conv, lambda t: section(t, None))
    else:
        sections = F.zip_with(conv, thinking, section)
    return F.concat_ws("\n", F.concat(F.lit("# "), title, F.lit("\n")), sections)


def transcript_json(title: Column, conv: Column) -> Column:
    return F.to_json(F.struct(title.alias("title"), conv.alias("messages")))


def conversation_title(turns: DataFrame, conv_id: str, order: str, role: str, content: str) -> DataFrame:
    """Start of the first user message of every conversation."""
    asked = turns.where(F.col(role) == "user")
    return asked.groupBy(conv_id).agg(truncated(F.min_by(content, order), TITLE_CHARS).alias("title"))


def title_of(conv: Column) -> Column:
    """The same title from a nested conversation."""
    first = F.get(F.filter(conv, lambda t: t["role"] == "user"), F.lit(0))["content"]
    return F.coalesce(truncated(first, TITLE_CHARS), F.lit(DEFAULT_TITLE))


def pinned_then_recent(chats: DataFrame, pin: str, ts: str, conv_id: str) -> DataFrame:
    return chats.orderBy(F.desc(pin), F.desc(ts), conv_id)
