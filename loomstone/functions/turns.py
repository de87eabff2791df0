"""Conversation columns: arrays of ``struct<role, content>`` built and reshaped in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import strip

CONV_TYPE = "array<struct<role:string,content:string>>"

# Role names of other formats and what they mean.
USER_ROLES = ["human", "user"]
ASSISTANT_ROLES = ["gpt", "assistant", "bot"]


def turn(role, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def user_assistant(question: Column, answer: Column) -> Column:
    return F.array(turn("user", question), turn("assistant", answer))


def no_turns() -> Column:
    return F.array().cast(CONV_TYPE)


def canonical_role(role: Column) -> Column:
    return (
        F.when(role.isin(USER_ROLES), F.lit("user"))
        .when(role.isin(ASSISTANT_ROLES), F.lit("assistant"))
        .otherwise(role)
    )


def finetune_role(role: Column) -> Column:
    """The narrower role map of the fine-tuning formatter (``bot`` stays as it is)."""
    return (
        F.when(role == "human", F.lit("user")).when(role == "gpt", F.lit("assistant")).otherwise(role)
    )


def _read_turn(t: Column, from_first: bool) -> tuple[Column, Column]:
    if from_first:
        return F.coalesce(t["from"], t["role"], F.lit("user")), F.coalesce(t["value"], t["content"], F.lit(""))
    return F.coalesce(t["role"], t["from"], F.lit("user")), F.coalesce(t["content"], t["value"], F.lit(""))


def normalize_turns(turns: Column, from_first: bool = False, drop_empty: bool = True) -> Column:
    """Turns with ``role``/``from`` and ``content``/``value`` in the common schema.

    With ``drop_empty`` the strict rule holds: empty turns go, and at least two
    turns must be given and remain. Otherwise any non-empty list is kept.
    """

    def canonical(t: Column) -> Column:
        role, content = _read_turn(t, from_first)
        return turn(canonical_role(role), content)

    conv = F.transform(turns, canonical)
    if not drop_empty:
        return F.when(F.size(conv) > 0, conv)
    kept = F.filter(conv, lambda t: t["content"] != "")
    return F.when((F.size(turns) >= 2) & (F.size(kept) >= 2), kept)


def _text(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def pair_or_null(question: Column, answer: Column) -> Column:
    """Two stripped texts as a conversation, null unless both are non-empty."""
    q, a = _text(question), _text(answer)
    return F.when((q != "") & (a != ""), user_assistant(q, a))


def alpaca_strict(instruction: Column, extra: Column, output: Column) -> Column:
    i, x, o = _text(instruction), _text(extra), _text(output)
    question = F.when(x != "", F.concat_ws("\n", i, x)).otherwise(i)
    return F.when((i != "") & (o != ""), user_assistant(question, o))


def alpaca_lenient(instruction: Column, extra: Column, output: Column) -> Column:
    """Nothing stripped or required beyond the instruction key."""
    i, x, o = (F.coalesce(c, F.lit("")) for c in (instruction, extra, output))
    question = F.when(x != "", F.concat(i, F.lit("\n"), x)).otherwise(i)
    return user_assistant(question, o)


def with_optional_system(system: Column, question: Column, answer: Column, strict: bool = True) -> Column:
    if strict:
        s, q, a = _text(system), _text(question), _text(answer)
        guard = (q != "") & (a != "")
    else:
        s, q, a = F.coalesce(system, F.lit("")), F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit(""))
        guard = F.lit(True)
    head = F.when(s != "", F.array(turn("system", s))).otherwise(no_turns())
    return F.when(guard, F.concat(head, user_assistant(q, a)))


def first_two_texts(columns: list[Column], min_chars: int = 5) -> Column:
    """The first two columns (in order) whose stripped text is longer than ``min_chars``."""
    return first_two_of(F.array(*columns), min_chars)


def first_two_of(values: Column, min_chars: int = 5) -> Column:
    """As ``first_two_texts``, of the texts in an array."""
    texts = F.filter(F.transform(values, _text), lambda t: F.length(t) > min_chars)
    return F.when(F.size(texts) >= 2, user_assistant(texts[0], texts[1]))


def inject_system(conv: Column, system_prompt) -> Column:
    """Replace any system turns by one in front; a blank prompt changes nothing."""
    prompt = F.lit(system_prompt) if isinstance(system_prompt, str) else system_prompt
    rest = F.filter(conv, lambda t: t["role"] != "system")
    return F.when(_text(prompt) == "", conv).otherwise(F.concat(F.array(turn("system", prompt)), rest))


def show(conv: Column) -> Column:
    """One line per conversation, ``role: content`` turns joined by a unit separator."""
    return F.array_join(F.transform(conv, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\x1f")
