"""Named queries of chat templates and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import templates as tp
from ..operators import chat as op
from . import inputs
from .convert_queries import nested
from .registry import query

_HEADER = {
    "chatml": "'<|im_start|>' || role || chr(10)",
    "llama": "CASE role WHEN 'system' THEN '<<SYS>>' || chr(10) WHEN 'user' THEN '[INST] ' ELSE '' END",
    "simple": "'### ' || upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ':' || chr(10)",
}
_FOOTER = {
    "chatml": "'<|im_end|>' || chr(10)",
    "llama": "CASE role WHEN 'system' THEN chr(10) || '<</SYS>>' || chr(10) || chr(10) WHEN 'user' THEN ' [/INST]' || chr(10) ELSE chr(10) END",
    "simple": "chr(10) || chr(10)",
}


def rendered_sql(template: str) -> str:
    return f"SELECT conv_id, string_agg({_HEADER[template]} || text || {_FOOTER[template]}, '' ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id"


def _register_render(template: str) -> None:
    @query(f"render_{template}", rendered_sql(template))
    def render(spark, sf_dir):
        return nested(spark, sf_dir).select("conv_id", tp.render(F.col("conv"), template).alias("rendered"))


for _name in tp.TEMPLATES:
    _register_render(_name)


def spans_sql(template: str) -> str:
    return f"""spans AS (SELECT conv_id, turn, role, length({_HEADER[template]}) AS h, length(text || {_FOOTER[template]}) AS b,
      sum(length({_HEADER[template]}) + length(text || {_FOOTER[template]})) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations)"""


@query(
    "assistant_char_spans",
    " UNION ALL ".join(
        f"(WITH {spans_sql(t)} SELECT '{t}' AS template, conv_id, (upto - b)::BIGINT AS span_start, upto::BIGINT AS span_end FROM spans WHERE role = 'assistant')"
        for t in tp.TEMPLATES
    ),
)
def assistant_char_spans(spark, sf_dir):
    chats = nested(spark, sf_dir)
    per_template = F.array(
        *[F.struct(F.lit(t).alias("template"), tp.assistant_spans(F.col("conv"), t).alias("spans")) for t in tp.TEMPLATES]
    )
    return chats.select("conv_id", F.inline(per_template)).select("template", "conv_id", F.inline("spans"))


_PROMPT_TURN = {
    "chatml": "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)",
    "llama": "CASE WHEN role = 'user' THEN '[INST] ' || text || ' [/INST]' || chr(10) ELSE text || '</s>' || chr(10) END",
    "simple": "CASE WHEN role = 'user' THEN '### User:' ELSE '### Assistant:' END || chr(10) || text || chr(10) || chr(10)",
}
_PROMPT_LEAD = {"chatml": "'<|im_start|>assistant' || chr(10)", "llama": "''", "simple": "'### Assistant:' || chr(10)"}


@query(
    "render_generation_prompt",
    " UNION ALL ".join(
        f"SELECT '{t}' AS template, conv_id, string_agg({_PROMPT_TURN[t]}, '' ORDER BY turn) || {_PROMPT_LEAD[t]} AS prompt FROM conversations GROUP BY conv_id"
        for t in tp.TEMPLATES
    ),
)
def render_generation_prompt(spark, sf_dir):
    per_template = F.array(
        *[F.struct(F.lit(t).alias("template"), tp.generation_prompt(F.col("conv"), t).alias("prompt")) for t in tp.TEMPLATES]
    )
    return nested(spark, sf_dir).select("conv_id", F.inline(per_template))


def _stop_sql(template: str) -> str:
    positions = ", ".join(f"nullif(strpos(g, '{s}'), 0)" for s in tp.STOP_TOKENS[template])
    generated = {
        "chatml": "text || '<|im_end|>' || chr(10) || 'x <|im_start|>'",
        "llama": "CASE WHEN turn % 2 = 0 THEN text ELSE text || '</s> more [INST]' END",
        "simple": "text || ' ### note ### User: y'",
    }[template]
    return f"""SELECT '{template}' AS template, conv_id, turn, CASE WHEN least({positions}) IS NULL THEN g ELSE substr(g, 1, least({positions}) - 1) END AS answer
      FROM (SELECT conv_id, turn, {generated} AS g FROM conversations)"""


@query("stop_sequence_cut", " UNION ALL ".join(_stop_sql(t) for t in tp.TEMPLATES))
def stop_sequence_cut(spark, sf_dir):
    text = F.col("text")
    generated = {
        "chatml": F.concat(text, F.lit("<|im_end|>\nx <|im_start|>")),
        "llama": F.when(F.col("turn") % 2 == 0, text).otherwise(F.concat(text, F.lit("</s> more [INST]"))),
        "simple": F.concat(text, F.lit(" ### note ### User: y")),
    }
    answers = F.array(
        *[
            F.struct(F.lit(t).alias("template"), tp.cut_at_stop(generated[t], tp.STOP_TOKENS[t]).alias("answer"))
            for t in tp.TEMPLATES
        ]
    )
    return inputs.conversations(spark, sf_dir).select("conv_id", "turn", F.inline(answers))


_NAMES = ["Qwen2.5-7B", "Phi-3-mini", "Meta-Llama-3-8B", "TinyLlama-1.1B", "gemma-2b", "Mixtral-8x7B", "CodeLlama-7b", "vicuna-13b", "other-1b"]
_MARKS = ["<|im_start|>", "<|start_header_id|>", "<start_of_turn>", "<|user|>", "<<SYS>>[INST]", "[INST]", "USER: ASSISTANT:", "plain"]
_FAMILY_OF = ["chatml", "chatml", "llama3", "zephyr", "gemma", "mistral", "llama2", "vicuna", None]
_FAMILY_OF_MARK = ["chatml", "llama3", "gemma", "zephyr", "llama2", "mistral", "vicuna", None]


def _sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@query(
    "template_family",
    f"""SELECT p_partkey, p_name || '/' || {_sql_list(_NAMES)}[p_partkey % 9 + 1] AS model, {_sql_list(_FAMILY_OF)}[p_partkey % 9 + 1] AS by_name,
      {_sql_list(_FAMILY_OF_MARK)}[p_partkey % 8 + 1] AS by_template,
      coalesce({_sql_list(_FAMILY_OF)}[p_partkey % 9 + 1], {_sql_list(_FAMILY_OF_MARK)}[p_partkey % 8 + 1]) AS family FROM part""",
)
def template_family(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in _NAMES])
    marks = F.array(*[F.lit(m) for m in _MARKS])
    key = F.col("p_partkey")
    models = inputs.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat(F.col("p_name"), F.lit("/"), F.get(names, (key % 9).cast("int"))).alias("model"),
        F.concat(F.lit("{{ "), F.get(marks, (key % 8).cast("int")), F.lit(" }}")).alias("template"),
    )
    return models.select(
        "p_partkey",
        "model",
        tp.family_of_name(F.col("model")).alias("by_name"),
        tp.family_of_template(F.col("template")).alias("by_template"),
    ).withColumn("family", F.coalesce("by_name", "by_template"))


_TITLES_SQL = """titles AS (SELECT conv_id, CASE WHEN length(first_text) > 32 THEN substr(first_text, 1, 32) || '...' ELSE first_text END AS title
  FROM (SELECT conv_id, arg_min(text, turn) AS first_text FROM conversations WHERE role = 'user' GROUP BY conv_id))"""


@query("conversation_title", f"WITH {_TITLES_SQL} SELECT conv_id, title FROM titles")
def conversation_title(spark, sf_dir):
    return op.conversation_title(inputs.conversations(spark, sf_dir), "conv_id", "turn", "role", "text")


@query(
    "transcript_markdown",
    f"""WITH {_TITLES_SQL} SELECT conv_id, '# ' || title || chr(10) || chr(10) || string_agg(chr(10) || '## ' ||
      CASE role WHEN 'user' THEN '👤 用户' WHEN 'assistant' THEN '🦙 AI' WHEN 'system' THEN '⚙️ 系统' ELSE role END || chr(10) || chr(10) ||
      CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN '<details><summary>💭 思考</summary>' || chr(10) || chr(10) || 'note ' || turn || chr(10) || '</details>' || chr(10) || chr(10) ELSE '' END ||
      chr(10) || text || chr(10), chr(10) ORDER BY turn) AS document
    FROM conversations JOIN titles USING (conv_id) GROUP BY conv_id, title""",
)
def transcript_markdown(spark, sf_dir):
    """Every fourth turn, when it is an answer, carries a thinking note."""
    turns = inputs.conversations(spark, sf_dir)
    note = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 1), F.concat(F.lit("note "), F.col("turn").cast("string")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"), note.alias("note"))))
    chats = turns.groupBy("conv_id").agg(ordered.alias("conv"))
    return chats.select(
        "conv_id",
        op.transcript_markdown(
            op.title_of(F.col("conv")), F.col("conv"), F.transform("conv", lambda t: t["note"])
        ).alias("document"),
    )


@query(
    "transcript_json",
    f"""WITH {_TITLES_SQL} SELECT conv_id, to_json({{'title': title, 'messages': list({{'role': role, 'content': text}} ORDER BY turn)}})::VARCHAR AS document
    FROM conversations JOIN titles USING (conv_id) GROUP BY conv_id, title""",
)
def transcript_json(spark, sf_dir):
    return nested(spark, sf_dir).select(
        "conv_id", op.transcript_json(op.title_of(F.col("conv")), F.col("conv")).alias("document")
    )


@query(
    "pinned_recent_order",
    """SELECT conv_id, conv_id % 5 = 0 AS pin, (max(turn) * 37 + conv_id * 11) % 101 AS ts
    FROM conversations GROUP BY conv_id ORDER BY pin DESC, ts DESC, conv_id""",
)
def pinned_recent_order(spark, sf_dir):
    chats = (
        inputs.conversations(spark, sf_dir)
        .groupBy("conv_id")
        .agg(F.max("turn").alias("last"))
        .select("conv_id", (F.col("conv_id") % 5 == 0).alias("pin"), ((F.col("last") * 37 + F.col("conv_id") * 11) % 101).alias("ts"))
    )
    return op.pinned_then_recent(chats, "pin", "ts", "conv_id")
