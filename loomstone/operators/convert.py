"""Records of many formats to conversations, row by row and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx, turns as tn
from . import formats as fm

# Fields the converters look at. One parse per record reads them all; a field
# of another type than declared is read as null.
_TURN = "struct<role:string,from:string,content:string,value:string,text:string>"
TEXT_FIELDS = [
    "instruction", "input", "output", "system_prompt", "question", "response", "prompt", "completion",
    "query", "answer", "reply", "text", "title", "body", "human", "user", "assistant", "context", "best_answer",
]
TURN_FIELDS = ["conversations", "messages", "conversation", "dialog", "dialogue", "turns", "chat"]
RECORD_SCHEMA = ", ".join([f"`{n}` string" for n in TEXT_FIELDS] + [f"`{n}` array<{_TURN}>" for n in TURN_FIELDS])

# Substrings that show a text already holds a conversation.
CONVERSATION_MARKERS = ["<|im_start|>", "<|user|>", "### Human:", "### Assistant:", "USER:", "ASSISTANT:"]

# Prefixes of question and answer lines in plain text.
_DELIMITER = "[:" + tx.SPACE_CLASS + "\\p{Z}：]"
QUESTION_LINE = "(?isu)^(?:Q|User|Human|问|用户)" + _DELIMITER + "(.+)"
ANSWER_LINE = "(?isu)^(?:A|Assistant|Bot|答|助手)" + _DELIMITER + "(.+)"


def parse_records(df: DataFrame, line: str) -> DataFrame:
    """Add ``keys``, the parsed ``rec`` and its ``own`` texts; malformed lines and non-objects are dropped."""
    return (
        df.withColumn("keys", fm.record_keys(F.col(line)))
        .where(F.col("keys").isNotNull())
        .withColumn("rec", F.from_json(F.col(line), RECORD_SCHEMA, tx.ANY_LENGTH))
        .withColumn("own", own_texts(F.col(line)))
    )


def own_texts(line: Column) -> Column:
    """The text values of a record, whatever their names, in the record's own key order."""
    fields = F.map_entries(F.from_json(line, "map<string,variant>", tx.ANY_LENGTH))
    texts = F.filter(fields, lambda f: F.schema_of_variant(f["value"]) == "STRING")
    return F.transform(texts, lambda f: f["value"].cast("string"))


def split_malformed(df: DataFrame, line: str, line_no: str) -> tuple[DataFrame, DataFrame]:
    """Good lines, and ``(line_no, error)`` of those that are no JSON; blank lines are neither."""
    filled = df.where(~tx.is_blank(F.col(line)))
    valid = tx.valid_json(F.col(line))
    bad = filled.where(~valid).select(
        line_no, F.concat(F.lit("line "), F.col(line_no).cast("string"), F.lit(": malformed JSON")).alias("error")
    )
    return filled.where(valid), bad


def mixed_conversation(keys: Column, rec: Column) -> Column:
    """Each record routed by its own keys, lenient about contents; null when no rule takes it."""
    listed = F.coalesce(rec["conversations"], rec["messages"])
    other = F.when(F.size(rec["conversation"]) > 0, rec["conversation"]).otherwise(rec["dialog"])
    return (
        F.when(fm.has_any(keys, "conversations", "messages"), tn.normalize_turns(listed))
        .when(fm.has_all(keys, "instruction"), tn.alpaca_lenient(rec["instruction"], rec["input"], rec["output"]))
        .when(F.size(other) > 0, tn.normalize_turns(other, from_first=True, drop_empty=False))
        .when(
            fm.has_all(keys, "question", "response"),
            tn.with_optional_system(rec["system_prompt"], rec["question"], rec["response"], strict=False),
        )
    )


def _field(rec: Column, name: Column, names: list[str]) -> Column:
    """The field of ``rec`` called ``name``, among a fixed list of fields."""
    chain = F.when(name == names[0], rec[names[0]])
    for n in names[1:]:
        chain = chain.when(name == n, rec[n])
    return chain


def qa_conversation(keys: Column, rec: Column) -> Column:
    """The record's first question/answer key pair as a conversation."""
    pair = fm.qa_keys(keys)
    return tn.pair_or_null(_field(rec, pair["q"], fm.QUESTION_KEYS), _field(rec, pair["a"], fm.ANSWER_KEYS))


def strict_conversation(keys: Column, rec: Column, own: Column) -> Column:
    """Each record converted by the format its keys show, strict about empty contents."""
    listed = F.coalesce(rec["conversations"], rec["messages"])
    fmt = fm.detect_sft(keys, listed.isNotNull(), rec["conversation"].isNotNull())
    return (
        F.when(fmt == "conversations", tn.normalize_turns(listed))
        .when(fmt == "alpaca", tn.alpaca_strict(rec["instruction"], rec["input"], rec["output"]))
        .when(fmt == "sharegpt", tn.normalize_turns(rec["conversation"], from_first=True))
        .when(fmt == "openorca", tn.with_optional_system(rec["system_prompt"], rec["question"], rec["response"]))
        .when(fmt == "prompt_completion", tn.pair_or_null(rec["prompt"], rec["completion"]))
        .when(F.startswith(fmt, F.lit("qa:")), qa_conversation(keys, rec))
        .otherwise(tn.first_two_of(own))
    )


def convert_by_first_record(rows: DataFrame, line: str, order: str) -> tuple[DataFrame, str]:
    """Records of one data set converted by the format its first record shows: ``rows`` with ``conv``, and the format.

    The first record in ``order`` (a record, not a line that is none) also tells which turn list, which question and answer keys and,
    for an unknown format, which columns are read of all. A record that does not fit has a null ``conv``, as have lines that are no record.
    """
    spark = rows.sparkSession
    usable = rows.where(fm.record_keys(F.col(line)).isNotNull())
    first = usable.groupBy().agg(F.min_by(line, order).alias("line")).first()["line"]
    if first is None:
        return rows.withColumn("conv", tn.normalize_turns(F.from_json(F.lit(None).cast("string"), f"array<{_TURN}>"))), "unknown"
    turns = F.when(fm.has_all(F.col("keys"), "conversations"), F.col("rec.conversations")).otherwise(F.col("rec.messages"))
    probe = parse_records(spark.createDataFrame([(first,)], "line string"), "line")
    decided = probe.select("keys", fm.detect_sft(F.col("keys"), turns.isNotNull(), F.col("rec.conversation").isNotNull()).alias("format")).first()
    keys, fmt = decided["keys"], decided["format"]
    rec = F.from_json(F.col(line), RECORD_SCHEMA, tx.ANY_LENGTH)
    if fmt == "conversations":
        conv = tn.normalize_turns(rec["conversations" if "conversations" in keys else "messages"])
    elif fmt == "alpaca":
        conv = tn.alpaca_strict(rec["instruction"], rec["input"], rec["output"])
    elif fmt == "sharegpt":
        conv = tn.normalize_turns(rec["conversation"], from_first=True)
    elif fmt == "openorca":
        conv = tn.with_optional_system(rec["system_prompt"], rec["question"], rec["response"])
    elif fmt == "prompt_completion":
        conv = tn.pair_or_null(rec["prompt"], rec["completion"])
    elif fmt.startswith("qa:"):
        question, answer = fmt[3:].split(",")
        conv = tn.pair_or_null(rec[question], rec[answer])
    else:
        fields = F.from_json(F.col(line), "map<string,variant>", tx.ANY_LENGTH)

        def text(name: str) -> Column:
            value = F.try_element_at(fields, F.lit(name))
            return F.when(F.schema_of_variant(value) == "STRING", value.cast("string"))

        conv = tn.first_two_of(F.array(*[text(k) for k in keys]))
    return rows.withColumn("conv", F.when(fm.record_keys(F.col(line)).isNotNull(), conv)), fmt


def dialog_values(line: Column, name: str) -> Column:
    """The list of turns a record holds under ``name``, of any types; null when it is no list."""
    return F.from_json(line, f"`{name}` array<variant>", tx.ANY_LENGTH)[name]


def dialog_to_sharegpt(turns: Column) -> Column:
    """``from``/``value`` turns of a list of variants: objects and plain strings, others are left out.

    A string, or an object without a role, is human or gpt by its position.
    """

    def convert(t: Column, i: Column) -> Column:
        alternating = F.when(i % 2 == 0, F.lit("human")).otherwise(F.lit("gpt"))
        kind = F.schema_of_variant(t)

        def filled(name: str) -> Column:
            value = F.try_variant_get(t, f"$.{name}", "string")
            return F.when(value != "", value)

        said = F.struct(alternating.alias("from"), t.cast("string").alias("value"))
        named = F.struct(
            F.coalesce(filled("role"), filled("from"), alternating).alias("from"),
            F.coalesce(filled("content"), filled("value"), filled("text"), F.to_json(t)).alias("value"),
        )
        return F.when(kind == "STRING", said).when(F.startswith(kind, F.lit("OBJECT")), named)

    return F.filter(F.transform(turns, convert), lambda t: t.isNotNull())


def fields_to_alpaca(keys: Column, rec: Column) -> Column:
    """``struct<instruction, input, output>``: kept when complete, else from the first known field pair."""
    pair = fm.field_pair(keys)
    questions = sorted({q for q, _ in fm.FIELD_PAIRS})
    answers = sorted({a for _, a in fm.FIELD_PAIRS})

    def row(instruction: Column, extra: Column, output: Column) -> Column:
        return F.struct(
            F.coalesce(instruction, F.lit("")).alias("instruction"),
            F.coalesce(extra, F.lit("")).alias("input"),
            F.coalesce(output, F.lit("")).alias("output"),
        )

    kept = row(rec["instruction"], rec["input"], rec["output"])
    mapped = row(_field(rec, pair["q"], questions), F.lit(""), _field(rec, pair["a"], answers))
    return F.when(fm.has_all(keys, "instruction", "output"), kept).when(pair.isNotNull(), mapped)


def text_route(text: Column) -> Column:
    """``raw`` when the text holds a conversation marker, else ``alpaca``."""
    marked = F.lit(False)
    for marker in CONVERSATION_MARKERS:
        marked = marked | F.contains(text, F.lit(marker))
    return F.when(marked, F.lit("raw")).otherwise(F.lit("alpaca"))


def qa_line_pairs(text: Column) -> Column:
    """Question lines directly followed by an answer line, as an array of conversations.

    Question and answer prefixes never match the same line, so pairing each
    line with its successor finds exactly what a two-line reader would.
    """
    lines = F.transform(tx.lines_of(tx.strip(text)), lambda line: tx.strip(line))
    marked = F.transform(
        lines,
        lambda line: F.struct(
            F.regexp_extract(line, QUESTION_LINE, 1).alias("q"), F.regexp_extract(line, ANSWER_LINE, 1).alias("a")
        ),
    )
    following = F.slice(marked, F.lit(2), F.greatest(F.size(marked) - 1, F.lit(0)))
    joined = F.zip_with(
        marked, following, lambda here, after: F.struct(here["q"].alias("q"), F.coalesce(after["a"], F.lit("")).alias("a"))
    )
    found = F.filter(joined, lambda p: (p["q"] != "") & (p["a"] != ""))
    return F.transform(found, lambda p: tn.user_assistant(tx.strip(p["q"]), tx.strip(p["a"])))


def tab_pairs(text: Column) -> Column:
    """Lines of two tab-separated fields, both longer than three characters, as conversations."""
    fields = F.transform(tx.lines_of(tx.strip(text)), lambda line: F.split(tx.strip(line), "\t", -1))
    found = F.filter(fields, lambda f: (F.size(f) >= 2) & (F.length(f[0]) > 3) & (F.length(F.get(f, F.lit(1))) > 3))
    return F.transform(found, lambda f: tn.user_assistant(tx.strip(f[0]), tx.strip(f[1])))


def convert_lines(lines: DataFrame, source: str, line_no: str, line: str) -> DataFrame:
    """Conversations of text files given as lines: ``(source, line_no, rule, conv)``.

    JSON records first; question/answer lines only for a file without any JSON
    conversation; tab pairs only for a file without either. Files are told
    apart by anti-joins on the files that already gave something, and a line
    finds its successor by an equi-join, so no file is ever held in one task.
    """
    lines = lines.select(source, line_no, tx.strip(F.col(line)).alias("line"))
    from_json = (
        parse_records(lines, "line")
        .select(source, line_no, mixed_conversation(F.col("keys"), F.col("rec")).alias("conv"))
        .where("conv IS NOT NULL")
    )
    rest = lines.join(from_json.select(source).distinct(), source, "left_anti")
    question = rest.select(
        source, line_no, (F.col(line_no) + 1).alias("next_no"), F.regexp_extract("line", QUESTION_LINE, 1).alias("q")
    ).where("q <> ''")
    answer = rest.select(
        source, F.col(line_no).alias("next_no"), F.regexp_extract("line", ANSWER_LINE, 1).alias("a")
    ).where("a <> ''")
    from_qa = question.join(answer, [source, "next_no"]).select(
        source, line_no, tn.user_assistant(tx.strip(F.col("q")), tx.strip(F.col("a"))).alias("conv")
    )
    last = rest.join(from_qa.select(source).distinct(), source, "left_anti")
    from_tabs = last.select(source, line_no, F.explode(tab_pairs(F.col("line"))).alias("conv"))
    columns = [source, line_no, F.col("rule"), F.col("conv")]
    found = [from_json.withColumn("rule", F.lit("json")), from_qa.withColumn("rule", F.lit("qa_lines"))]
    result = from_tabs.withColumn("rule", F.lit("tabs")).select(*columns)
    for part in found:
        result = result.unionByName(part.select(*columns))
    return result


def convert_counts(df: DataFrame, conv: str, *keys: str) -> DataFrame:
    """How many records became a conversation and how many were skipped."""
    return df.groupBy(*keys).agg(
        F.count_if(F.col(conv).isNotNull()).alias("written"), F.count_if(F.col(conv).isNull()).alias("skipped")
    )


def alpaca_fallback(df: DataFrame) -> Column:
    """Prompt and answer text by the columns a table has: instruction or input, output or response or text."""
    columns = set(df.columns)
    if "instruction" in columns:
        question, extra = "instruction", "input" if "input" in columns else None
    else:
        question, extra = ("input" if "input" in columns else None), None
    answer = next((c for c in ("output", "response", "text") if c in columns), None)
    if answer is None:
        raise ValueError("no output, response or text column")
    q = F.coalesce(F.col(question), F.lit("")) if question else F.lit("")
    if extra:
        x = F.coalesce(F.col(extra), F.lit(""))
        q = F.when(x == "", q).when(q == "", x).otherwise(F.concat(q, F.lit("\n"), x))
    return tn.user_assistant(q, F.col(answer))


def finetune_roles(turns: Column) -> Column:
    """``from``/``value`` turns with the fine-tuning role map."""
    return F.transform(
        turns,
        lambda t: tn.turn(
            tn.finetune_role(F.coalesce(t["from"], t["role"], F.lit("user"))),
            F.coalesce(t["value"], t["content"], F.lit("")),
        ),
    )


def nest_turns(df: DataFrame, conv_id: str, order: str, role: str, content: str) -> DataFrame:
    """Long-form turns to one row per conversation, in turn order.

    A conversation is one row of the result by definition, so its turns meet;
    that is one dialogue, not a group that grows with the table.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("r"), F.col(content).alias("c"))))
    return df.groupBy(conv_id).agg(F.transform(ordered, lambda t: tn.turn(t["r"], t["c"])).alias("conv"))


def unnest_turns(df: DataFrame, conv_id: str, conv: str) -> DataFrame:
    return df.select(conv_id, F.posexplode(conv).alias("turn", "t")).select(
        conv_id, F.col("turn").cast("bigint").alias("turn"), "t.role", "t.content"
    )
