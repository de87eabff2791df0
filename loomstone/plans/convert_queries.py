"""Named queries of format detection and conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import turns as tn
from ..operators import convert as op, formats as fm
from . import corpus, inputs
from .inputs import DIRTY_SQL, PAIRS_SQL
from .registry import query

_WS = "' ' || chr(9) || chr(10) || chr(13)"


def _pair(q: str, a: str) -> str:
    return f"'user: ' || {q} || chr(31) || 'assistant: ' || {a}"


def _strip(c: str) -> str:
    return f"trim({c}, {_WS})"


def _parsed(spark, sf_dir):
    return op.parse_records(inputs.foreign_rows(spark, sf_dir).select("conv_id", "turn", "line"), "line")


# ---- records and their formats ---------------------------------------------


@query(
    "jsonl_tolerant_parse",
    f"""WITH {DIRTY_SQL} SELECT line_no,
      CASE fmt WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 4 THEN 1 ELSE 2 END::BIGINT AS n_keys,
      CASE WHEN fmt IN (0) THEN user_text END AS instruction, CASE WHEN fmt = 2 THEN assistant_text END AS completion
    FROM dirty WHERE kind = 'good'""",
)
def jsonl_tolerant_parse(spark, sf_dir):
    parsed = op.parse_records(inputs.dirty_lines(spark, sf_dir), "line")
    return parsed.select(
        "line_no", F.size("keys").cast("bigint").alias("n_keys"), "rec.instruction", "rec.completion"
    )


@query(
    "quarantine_bad_json",
    f"WITH {DIRTY_SQL} SELECT line_no, 'line ' || line_no || ': malformed JSON' AS error FROM dirty WHERE kind = 'malformed'",
)
def quarantine_bad_json(spark, sf_dir):
    _, bad = op.split_malformed(inputs.dirty_lines(spark, sf_dir), "line", "line_no")
    return bad


def _detected(spark, sf_dir, detector):
    return _parsed(spark, sf_dir).select("conv_id", "turn", detector.alias("format"))


def _format_sql(*names: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"WITH {PAIRS_SQL} SELECT conv_id, turn, CASE (conv_id + turn) % 6 {cases} END AS format FROM pairs"


@query("detect_format_upload", _format_sql("alpaca", "qa", "completion", "qa", "sharegpt", "unknown"))
def detect_format_upload(spark, sf_dir):
    return _detected(spark, sf_dir, fm.detect_upload(F.col("keys")))


@query("detect_format_listing", _format_sql("alpaca", "other", "other", "other", "sharegpt", "other"))
def detect_format_listing(spark, sf_dir):
    return _detected(spark, sf_dir, fm.detect_listing(F.col("keys")))


@query(
    "detect_format_sft",
    _format_sql("alpaca", "openorca", "prompt_completion", "qa:query,answer", "conversations", "unknown"),
)
def detect_format_sft(spark, sf_dir):
    listed = F.coalesce("rec.conversations", "rec.messages").isNotNull()
    return _detected(spark, sf_dir, fm.detect_sft(F.col("keys"), listed, F.col("rec.conversation").isNotNull()))


@query("detect_format_bulk", _format_sql("alpaca", "unchanged", "mapped", "unchanged", "sharegpt", "unchanged"))
def detect_format_bulk(spark, sf_dir):
    def holds_objects(name):
        return F.get(F.col(f"rec.{name}"), F.lit(0)).isNotNull()

    dialog = F.size(F.coalesce(*[op.dialog_values(F.col("line"), n) for n in fm.DIALOG_KEYS])) > 0
    detector = fm.detect_bulk(F.col("keys"), holds_objects("conversations"), holds_objects("messages"), dialog)
    return _detected(spark, sf_dir, detector)


# ---- one format at a time --------------------------------------------------

_TURN_FIELDS = "struct<role:string,from:string,content:string,value:string>"


def _foreign_turns(spark, sf_dir):
    """Conversations with foreign role names, both key styles, and some empty turns."""
    role = (
        F.when(F.col("role") == "user", F.when(F.col("conv_id") % 2 == 0, "human").otherwise("user"))
        .when(F.col("role") == "assistant", F.when(F.col("conv_id") % 3 == 0, "bot").otherwise("gpt"))
        .otherwise(F.col("role"))
    )
    text = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.lit("")).otherwise(F.col("text"))
    modern = F.col("conv_id") % 2 == 1
    turn = F.struct(
        F.col("turn"),
        F.when(modern, role).alias("role"),
        F.when(~modern, role).alias("from"),
        F.when(modern, text).alias("content"),
        F.when(~modern, text).alias("value"),
    )
    return (
        inputs.conversations(spark, sf_dir)
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    )


_FOREIGN_SQL = """
src AS (SELECT conv_id, turn, role AS kept_role,
    CASE WHEN role = 'user' AND conv_id % 2 = 0 THEN 'human' WHEN role = 'user' THEN 'user'
         WHEN role = 'assistant' AND conv_id % 3 = 0 THEN 'bot' WHEN role = 'assistant' THEN 'gpt' ELSE role END AS foreign_role,
    CASE WHEN (conv_id + turn) % 5 = 0 THEN '' ELSE text END AS content,
    count(*) OVER (PARTITION BY conv_id) AS given FROM conversations),
kept AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS remain,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM src WHERE content <> '')
"""


def _long(df):
    return op.unnest_turns(df.where("conv IS NOT NULL"), "conv_id", "conv")


@query(
    "normalize_turns",
    f"WITH {_FOREIGN_SQL} SELECT conv_id, pos AS turn, kept_role AS role, content FROM kept WHERE given >= 2 AND remain >= 2",
)
def normalize_turns(spark, sf_dir):
    conv = tn.normalize_turns(F.col("turns"))
    return _long(_foreign_turns(spark, sf_dir).select("conv_id", conv.alias("conv")))


@query(
    "sharegpt_to_conv",
    f"""WITH {_FOREIGN_SQL}
    SELECT 'strict' AS mode, conv_id, pos AS turn, kept_role AS role, content FROM kept WHERE given >= 2 AND remain >= 2
    UNION ALL
    SELECT 'lenient', conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1, kept_role, content FROM src""",
)
def sharegpt_to_conv(spark, sf_dir):
    turns = _foreign_turns(spark, sf_dir)
    strict = turns.select("conv_id", tn.normalize_turns(F.col("turns"), from_first=True).alias("conv"))
    lenient = turns.select(
        "conv_id", tn.normalize_turns(F.col("turns"), from_first=True, drop_empty=False).alias("conv")
    )
    return (
        _long(strict).withColumn("mode", F.lit("strict")).unionByName(_long(lenient).withColumn("mode", F.lit("lenient")))
    )


@query(
    "role_map_finetune",
    f"""WITH {_FOREIGN_SQL} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn,
      CASE foreign_role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE foreign_role END AS role, content FROM src""",
)
def role_map_finetune(spark, sf_dir):
    conv = op.finetune_roles(F.col("turns"))
    return _long(_foreign_turns(spark, sf_dir).select("conv_id", conv.alias("conv")))


def _fields(spark, sf_dir):
    """Pairs as instruction fields with padding, optional context, and some empty answers."""
    return inputs.pairs(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.concat(F.lit("  "), F.col("user_text"), F.lit(" ")).alias("question"),
        F.expr("CASE conv_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE concat('about ', conv_id) END").alias("extra"),
        F.expr("CASE WHEN (conv_id + turn) % 7 = 0 THEN ' ' ELSE assistant_text END").alias("answer"),
    )


_FIELDS_SQL = f"""{PAIRS_SQL.strip()}, fields AS (SELECT conv_id, turn, '  ' || user_text || ' ' AS question,
  CASE conv_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE 'about ' || conv_id END AS extra,
  CASE WHEN (conv_id + turn) % 7 = 0 THEN ' ' ELSE assistant_text END AS answer FROM pairs),
clean AS (SELECT conv_id, turn, {_strip("question")} AS q, {_strip("extra")} AS x, {_strip("answer")} AS a FROM fields)"""


def _shown(df, conv):
    return df.select("conv_id", "turn", tn.show(conv).alias("conversation")).where("conversation IS NOT NULL")


@query(
    "alpaca_to_conv_strict",
    f"""WITH {_FIELDS_SQL} SELECT conv_id, turn, {_pair("q || CASE WHEN x <> '' THEN chr(10) || x ELSE '' END", "a")} AS conversation
    FROM clean WHERE q <> '' AND a <> ''""",
)
def alpaca_to_conv_strict(spark, sf_dir):
    return _shown(_fields(spark, sf_dir), tn.alpaca_strict(F.col("question"), F.col("extra"), F.col("answer")))


@query(
    "alpaca_to_conv_lenient",
    f"""WITH {_FIELDS_SQL} SELECT conv_id, turn, {_pair("question || CASE WHEN extra <> '' THEN chr(10) || extra ELSE '' END", "answer")} AS conversation FROM fields""",
)
def alpaca_to_conv_lenient(spark, sf_dir):
    return _shown(_fields(spark, sf_dir), tn.alpaca_lenient(F.col("question"), F.col("extra"), F.col("answer")))


@query(
    "openorca_to_conv",
    f"""WITH {_FIELDS_SQL} SELECT conv_id, turn, CASE WHEN x <> '' THEN 'system: ' || x || chr(31) ELSE '' END || {_pair("q", "a")} AS conversation
    FROM clean WHERE q <> '' AND a <> ''""",
)
def openorca_to_conv(spark, sf_dir):
    return _shown(_fields(spark, sf_dir), tn.with_optional_system(F.col("extra"), F.col("question"), F.col("answer")))


@query(
    "prompt_completion_to_conv",
    f"WITH {_FIELDS_SQL} SELECT conv_id, turn, {_pair('q', 'a')} AS conversation FROM clean WHERE q <> '' AND a <> ''",
)
def prompt_completion_to_conv(spark, sf_dir):
    return _shown(_fields(spark, sf_dir), tn.pair_or_null(F.col("question"), F.col("answer")))


@query(
    "qa_to_conv",
    f"""WITH {PAIRS_SQL}, c AS (SELECT conv_id, turn, (conv_id + turn) % 6 AS fmt, {_strip("user_text")} AS q, {_strip("assistant_text")} AS a FROM pairs)
    SELECT conv_id, turn, CASE fmt WHEN 0 THEN 'instruction,output' WHEN 1 THEN 'question,response' WHEN 2 THEN 'prompt,completion' ELSE 'query,answer' END AS keys_used,
      {_pair("q", "a")} AS conversation FROM c WHERE fmt < 4 AND fmt <> 0 AND q <> '' AND a <> ''""",
)
def qa_to_conv(spark, sf_dir):
    """Every record read through its first question/answer key pair (an empty ``input`` gives nothing)."""
    pair = fm.qa_keys(F.col("keys"))
    conv = op.qa_conversation(F.col("keys"), F.col("rec"))
    return (
        _parsed(spark, sf_dir)
        .select("conv_id", "turn", F.concat_ws(",", pair["q"], pair["a"]).alias("keys_used"), conv.alias("conv"))
        .where("conv IS NOT NULL")
        .select("conv_id", "turn", "keys_used", tn.show(F.col("conv")).alias("conversation"))
    )


@query(
    "convert_by_first_record",
    f"""WITH {PAIRS_SQL}, c AS (SELECT conv_id, turn, conv_id % 4 AS part, conv_id * 100 + turn AS ord, (conv_id + turn) % 6 AS fmt, {_strip("user_text")} AS q, {_strip("assistant_text")} AS a FROM pairs),
    f AS (SELECT part, arg_min(fmt, ord) AS fmt FROM c GROUP BY part)
    SELECT part, conv_id, turn, CASE f.fmt WHEN 0 THEN 'alpaca' WHEN 1 THEN 'openorca' WHEN 2 THEN 'prompt_completion' WHEN 3 THEN 'qa:query,answer' WHEN 4 THEN 'conversations' ELSE 'unknown' END AS format,
      CASE WHEN c.fmt <> f.fmt OR q = '' OR a = '' OR (f.fmt = 5 AND least(length(q), length(a)) <= 5) THEN NULL
        ELSE CASE WHEN f.fmt = 1 THEN 'system: You are helper ' || (conv_id % 3) || chr(31) ELSE '' END || {_pair("q", "a")} END AS conversation
    FROM c JOIN f USING (part)""",
)
def convert_by_first_record(spark, sf_dir):
    """Four data sets of mixed records, each converted by what its first record shows; texts have no white space at their ends."""
    result = None
    rows = inputs.foreign_rows(spark, sf_dir).withColumn("ord", F.col("conv_id") * 100 + F.col("turn"))
    for part in range(4):
        converted, fmt = op.convert_by_first_record(rows.where(F.col("conv_id") % 4 == part), "line", "ord")
        shown = converted.select(F.lit(part).cast("bigint").alias("part"), "conv_id", "turn", F.lit(fmt).alias("format"), tn.show(F.col("conv")).alias("conversation"))
        result = shown if result is None else result.unionByName(shown)
    return result


@query(
    "unknown_two_text_cols",
    f"""WITH {PAIRS_SQL}, c AS (SELECT conv_id, turn, list_filter([{_strip("'id ' || turn")}, {_strip("user_text")}, {_strip("assistant_text")}], lambda t: length(t) > 5) AS t FROM pairs)
    SELECT conv_id, turn, {_pair("t[1]", "t[2]")} AS conversation FROM c WHERE len(t) >= 2""",
)
def unknown_two_text_cols(spark, sf_dir):
    """JSON records of unknown format: foreign field names, other types between them, key order against the alphabet."""
    label = F.concat(F.lit("id "), F.col("turn").cast("string"))
    record = F.struct(
        label.alias("zone"), F.col("turn").alias("number"), F.col("user_text").alias("headline"), F.array("turn").alias("extra"), F.col("assistant_text").alias("article")
    )
    rows = op.parse_records(inputs.pairs(spark, sf_dir).withColumn("line", F.to_json(record)), "line")
    return _shown(rows, op.strict_conversation(F.col("keys"), F.col("rec"), F.col("own")))


@query(
    "dialog_alternating_roles",
    f"""WITH {_FOREIGN_SQL} SELECT conv_id, pos, "from", value FROM (
      SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
        CASE WHEN conv_id % 3 = 0 AND (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 2 = 0 THEN 'human'
             WHEN conv_id % 3 = 0 THEN 'gpt' ELSE foreign_role END AS "from", content AS value FROM
        (SELECT * REPLACE (CASE WHEN content = '' THEN 'none' ELSE content END AS content) FROM src))""",
)
def dialog_alternating_roles(spark, sf_dir):
    """Dialogs whose turns lack a role in every third conversation."""

    def dialog_turn(t):
        content = F.coalesce(t["content"], t["value"])
        return F.struct(
            F.when(F.col("conv_id") % 3 != 0, F.coalesce(t["role"], t["from"])).alias("role"),
            F.lit(None).cast("string").alias("from"),
            F.lit("").alias("content"),
            F.lit(None).cast("string").alias("value"),
            F.when(content == "", F.lit("none")).otherwise(content).alias("text"),
        )

    dialogs = _foreign_turns(spark, sf_dir).select("conv_id", F.transform("turns", dialog_turn).alias("dialog"))
    turns = op.dialog_values(F.to_json(F.struct("dialog")), "dialog")
    return dialogs.select("conv_id", F.posexplode(op.dialog_to_sharegpt(turns)).alias("pos", "t")).select(
        "conv_id", F.col("pos").cast("bigint").alias("pos"), "t.from", "t.value"
    )


@query(
    "field_map_to_alpaca",
    f"""WITH {PAIRS_SQL} SELECT conv_id, turn, user_text AS instruction, '' AS input, assistant_text AS output FROM pairs
    WHERE (conv_id + turn) % 6 IN (0, 2)""",
)
def field_map_to_alpaca(spark, sf_dir):
    mapped = op.fields_to_alpaca(F.col("keys"), F.col("rec"))
    return (
        _parsed(spark, sf_dir).select("conv_id", "turn", mapped.alias("m")).where("m IS NOT NULL").select("conv_id", "turn", "m.*")
    )


@query(
    "text_marker_route",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR regexp_matches(text, '<\\|im_start\\|>|<\\|user\\|>|### Human:|### Assistant:|USER:|ASSISTANT:')
      THEN 'raw' ELSE 'alpaca' END AS route FROM documents""",
)
def text_marker_route(spark, sf_dir):
    docs = inputs.documents(spark, sf_dir, "doc_id", "text")
    marked = F.when(F.col("doc_id") % 4 == 0, F.concat(F.col("text"), F.lit("\n### Human: hello"))).otherwise(F.col("text"))
    return docs.select("doc_id", op.text_route(marked).alias("route"))


# ---- plain text ------------------------------------------------------------

# Text of a turn on one line, without tabs.
def _flat(c):
    return F.trim(F.translate(c, "\n\t\r", "   "))


_FLAT_SQL = f"""{PAIRS_SQL.strip()}, flat AS (SELECT conv_id, turn,
  trim(translate(user_text, chr(10) || chr(9) || chr(13), '   ')) AS q,
  trim(translate(assistant_text, chr(10) || chr(9) || chr(13), '   ')) AS a FROM pairs)"""


@query(
    "qa_line_pairs",
    f"""WITH {_FLAT_SQL} SELECT conv_id, turn, {_pair(_strip("q"), _strip("a"))} AS conversation FROM flat WHERE turn % 4 < 2 AND {_strip("q")} <> '' AND {_strip("a")} <> ''""",
)
def qa_line_pairs(spark, sf_dir):
    """One small text per pair; in some, a line between question and answer breaks the pair."""
    q, a = _flat("user_text"), _flat("assistant_text")
    between = F.when(F.col("turn") % 4 < 2, F.lit("\n")).otherwise(F.lit("\nplain line\n"))
    text = F.concat(F.lit("intro\nuser: "), q, between, F.lit("ASSISTANT："), a, F.lit("\nQ: alone\nnext"))
    found = inputs.pairs(spark, sf_dir).select("conv_id", "turn", F.explode(op.qa_line_pairs(text)).alias("conv"))
    return _shown(found, F.col("conv"))


@query(
    "tab_pairs",
    f"""WITH {_FLAT_SQL} SELECT conv_id, turn, {_pair("trim(q)", "trim(a)")} AS conversation FROM flat WHERE length(q) > 3 AND length(a) > 3""",
)
def tab_pairs(spark, sf_dir):
    q, a = _flat("user_text"), _flat("assistant_text")
    text = F.concat(F.lit("head\n"), q, F.lit("\t"), a, F.lit("\nab\tlong enough"))
    found = inputs.pairs(spark, sf_dir).select("conv_id", "turn", F.explode(op.tab_pairs(text)).alias("conv"))
    return _shown(found, F.col("conv"))


def _chat_files(spark, sf_dir):
    """Files (one per conversation) as lines: JSON with Q/A lines, Q/A with tab lines, or tab lines."""
    q, a = _flat("user_text"), _flat("assistant_text")
    record = F.to_json(F.struct(q.alias("instruction"), a.alias("output")))
    qa = F.array(F.concat(F.lit("Q: "), q), F.concat(F.lit("A: "), a))
    tabs = F.array(F.concat_ws("\t", q, a))
    kind = F.col("conv_id") % 3
    lines = (
        F.when(kind == 0, F.concat(F.array(record), qa)).when(kind == 1, F.concat(qa, tabs)).otherwise(tabs)
    )
    return inputs.pairs(spark, sf_dir).select(
        F.col("conv_id").alias("source"), "turn", F.posexplode(lines).alias("k", "line")
    ).select("source", (F.col("turn") * 10 + F.col("k")).alias("line_no"), "line")


@query(
    "convert_fallback_ladder",
    f"""WITH {_FLAT_SQL} SELECT conv_id AS source, turn * 10 AS line_no, ['json', 'qa_lines', 'tabs'][conv_id % 3 + 1] AS rule,
      {_pair("q", "a")} AS conversation FROM flat WHERE CASE conv_id % 3 WHEN 0 THEN true WHEN 1 THEN q <> '' AND a <> '' ELSE length(q) > 3 AND length(a) > 3 END""",
)
def convert_fallback_ladder(spark, sf_dir):
    found = op.convert_lines(_chat_files(spark, sf_dir), "source", "line_no", "line")
    return found.select("source", "line_no", "rule", tn.show(F.col("conv")).alias("conversation"))


@query(
    "convert_mixed_records",
    f"""WITH {PAIRS_SQL} SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 6 = 1 THEN 'system: You are helper ' || (conv_id % 3) || chr(31) ELSE '' END
      || {_pair("user_text", "assistant_text")} AS conversation FROM pairs WHERE (conv_id + turn) % 6 IN (0, 1, 4)""",
)
def convert_mixed_records(spark, sf_dir):
    return _shown(_parsed(spark, sf_dir), op.mixed_conversation(F.col("keys"), F.col("rec")))


@query(
    "convert_counts",
    f"""WITH {DIRTY_SQL} SELECT fmt, count(*) FILTER ({_strip("user_text")} <> '' AND {_strip("assistant_text")} <> ''
        AND (fmt <> 5 OR (length({_strip("user_text")}) > 5 AND length({_strip("assistant_text")}) > 5))) AS written,
      count(*) FILTER (NOT ({_strip("user_text")} <> '' AND {_strip("assistant_text")} <> ''
        AND (fmt <> 5 OR (length({_strip("user_text")}) > 5 AND length({_strip("assistant_text")}) > 5)))) AS skipped
    FROM dirty WHERE kind = 'good' GROUP BY fmt""",
)
def convert_counts(spark, sf_dir):
    parsed = op.parse_records(inputs.dirty_lines(spark, sf_dir), "line")
    return op.convert_counts(
        parsed.select("fmt", op.strict_conversation(F.col("keys"), F.col("rec"), F.col("own")).alias("conv")), "conv", "fmt"
    )


@query(
    "alpaca_column_fallback",
    f"""WITH {PAIRS_SQL} SELECT 'instruction+input' AS shape, conv_id, turn, {_pair("user_text || CASE WHEN conv_id % 2 = 0 THEN '' ELSE chr(10) || 'context' END", "assistant_text")} AS conversation FROM pairs
    UNION ALL SELECT 'input only', conv_id, turn, {_pair("user_text", "assistant_text")} FROM pairs""",
)
def alpaca_column_fallback(spark, sf_dir):
    rows = inputs.pairs(spark, sf_dir)
    extra = F.when(F.col("conv_id") % 2 == 0, F.lit("")).otherwise(F.lit("context"))
    full = rows.select("conv_id", "turn", F.col("user_text").alias("instruction"), extra.alias("input"), F.col("assistant_text").alias("output"))
    bare = rows.select("conv_id", "turn", F.col("user_text").alias("input"), F.col("assistant_text").alias("text"))
    parts = [
        _shown(df, op.alpaca_fallback(df)).withColumn("shape", F.lit(shape))
        for df, shape in ((full, "instruction+input"), (bare, "input only"))
    ]
    return parts[0].unionByName(parts[1])


def nested(spark, sf_dir):
    return op.nest_turns(inputs.conversations(spark, sf_dir), "conv_id", "turn", "role", "text")


@query(
    "inject_system_prompt",
    """SELECT conv_id, 'system: Answer briefly.' || chr(31) || string_agg(role || ': ' || text, chr(31) ORDER BY turn) AS conversation
    FROM conversations WHERE role <> 'system' GROUP BY conv_id""",
)
def inject_system_prompt(spark, sf_dir):
    conv = tn.inject_system(F.col("conv"), "Answer briefly.")
    return nested(spark, sf_dir).select("conv_id", tn.show(conv).alias("conversation"))


@query(
    "conversation_nest",
    "SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(31) ORDER BY turn) AS conversation FROM conversations GROUP BY conv_id",
)
def conversation_nest(spark, sf_dir):
    return nested(spark, sf_dir).select(
        "conv_id", F.size("conv").cast("bigint").alias("turns"), tn.show(F.col("conv")).alias("conversation")
    )


@query(
    "import_dialogs",
    """SELECT place, CASE WHEN place % 2 = 0 THEN 'human' ELSE 'gpt' END AS sender, text AS value, count(*) AS n FROM (
      SELECT row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, text FROM conversations WHERE text <> '') GROUP BY ALL""",
)
def import_dialogs(spark, sf_dir):
    """Conversations imported as dialogs whose turns are plain strings and objects by turns."""
    turns = inputs.conversations(spark, sf_dir).where("text <> ''")
    quoted = F.to_json(F.array("text"))
    plain = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    item = F.when(F.col("turn") % 2 == 0, plain).otherwise(F.to_json(F.struct(F.col("text").alias("content"))))
    items = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))).alias("items"))
    listed = F.concat(F.lit('{"id": '), F.col("conv_id").cast("string"), F.lit(', "dialog": ['), F.array_join("items.item", ", "), F.lit("]}"))
    imported = corpus.import_rows(items.select(listed.alias("line")), "line").where("format = 'sharegpt'")
    parsed = F.from_json("line", "conversations array<struct<from:string,value:string>>")["conversations"]
    placed = imported.select(F.posexplode(parsed).alias("place", "t"))
    return placed.groupBy(F.col("place").cast("bigint").alias("place"), F.col("t.from").alias("sender"), F.col("t.value").alias("value")).agg(
        F.count("*").alias("n")
    )
