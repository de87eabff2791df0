"""Profiling: text statistics, line lengths, frequent tokens, and column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as tx
from ..session import checkpointed
from . import counting

HISTOGRAM_BINS = 10
SAMPLE_ROWS = 20
SAMPLES_KEPT = 5
SAMPLE_CHARS = 200

# Column names preferred as training text when profiling a file.
SUGGESTED_COLUMNS = [
    "text", "content", "output", "instruction", "input", "question", "answer",
    "response", "prompt", "completion", "story", "document", "passage", "sentence",
]
CONVERSATION_WORDS = ["conversation", "messages", "dialog"]

STAT_COLUMNS = [
    "chars", "lines", "non_blank_lines", "words", "cjk", "ascii_letters", "digits", "punctuation", "spaces",
]


def text_stats(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Per-row counts, language guess and rough token count."""
    return with_language(counting.measured(df, text, *keep).select(*keep, *STAT_COLUMNS))


def with_language(stats: DataFrame) -> DataFrame:
    return stats.withColumn("language", tx.language_guess(F.col("cjk"), F.col("ascii_letters"))).withColumn(
        "rough_tokens", F.col("cjk") + F.col("words")
    )


def _stats_of(counts: DataFrame, key: str) -> DataFrame:
    """The counters of a tally as columns, with the language guessed from the sums."""
    pick = [F.sum(F.when((F.col("kind") == "measure") & (F.col("item") == c), F.col("n"))).alias(c) for c in STAT_COLUMNS]
    return with_language(counts.groupBy(key).agg(*pick))


def text_stats_by(df: DataFrame, text: str, key: str) -> DataFrame:
    """Statistics of a whole file: row counts summed per ``key``, language guessed from the sums."""
    return _stats_of(counting.tally(df, text, key, kinds=("measure",)), key)


def simple_text_stats(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """The variant that counts a trailing empty line and files the rest under ``other``."""
    columns = ["words", "cjk", "ascii_letters", "digits", "spaces"]
    counted = counting.measured(df, text, *keep).select(*keep, "chars", (F.col("newlines") + 1).alias("lines"), *columns)
    other = F.expr("chars - cjk - ascii_letters - digits - spaces")
    return counted.select(
        "*",
        other.alias("other"),
        (F.col("cjk") + F.col("words")).alias("rough_tokens"),
        tx.primary_language(F.col("cjk"), F.col("ascii_letters")).alias("primary_language"),
    )


def line_length_counts(df: DataFrame, text: str, key: str) -> DataFrame:
    """How often each line length occurs among the non-blank lines, per file.

    Everything about line lengths is computed from this table, whose size per
    file is the number of different lengths, however many lines there are.
    """
    return _lengths_of(counting.tally(df, text, key, kinds=("line",)), key)


def _lengths_of(counts: DataFrame, key: str) -> DataFrame:
    return counts.where("kind = 'line'").select(key, F.col("length").alias("line_length"), "n")


def line_length_distribution(counts: DataFrame, key: str) -> DataFrame:
    """Minimum, maximum, mean and upper median (element n // 2 of the sorted lengths)."""
    upto = Window.partitionBy(key).orderBy("line_length").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(key)
    ranked = counts.select(
        key, "line_length", "n", F.sum("n").over(upto).alias("upto"), F.sum("n").over(every).alias("total")
    )
    return ranked.groupBy(key).agg(
        F.sum("n").alias("line_count"),
        F.min("line_length").cast("bigint").alias("min_length"),
        F.max("line_length").cast("bigint").alias("max_length"),
        (F.sum(F.col("n") * F.col("line_length")) / F.sum("n")).alias("avg_length"),
        F.min(F.when(F.expr("upto > total div 2"), F.col("line_length"))).cast("bigint").alias("median_length"),
    )


def line_length_histogram(counts: DataFrame, key: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins per file; the last takes the overflow and empty bins are kept."""
    every = Window.partitionBy(key)
    bounded = counts.select(
        key, "line_length", "n", F.min("line_length").over(every).alias("low"), F.max("line_length").over(every).alias("high")
    ).withColumn("width", F.greatest(F.lit(1), F.expr(f"(high - low + 1) div {bins}")))
    bin_of = F.least(F.expr("(line_length - low) div width"), F.lit(bins - 1)).cast("int")
    filled = bounded.groupBy(key, "low", "width", bin_of.alias("bin")).agg(F.sum("n").alias("n"))
    held = filled.groupBy(key, "low", "width").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("held"))
    slots = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    start = F.col("low") + F.col("bin") * F.col("width")
    return slots.select(
        key,
        F.col("bin").cast("bigint").alias("bin"),
        F.concat_ws("-", start.cast("bigint"), (start + F.col("width") - 1).cast("bigint")).alias("range"),
        F.coalesce(F.element_at("held", F.col("bin")), F.lit(0)).alias("n"),
    )


def char_counts(df: DataFrame, text: str, key: str | None = None) -> DataFrame:
    """Occurrences of every character, counted by numpy per Arrow batch and then summed.

    Each batch yields at most its number of different characters (per key),
    so the shuffle is a few rows per batch instead of a row per character.
    """
    return _items_of(counting.tally(df, text, key, kinds=("char",)), "char", *([] if key is None else [key]))


def word_counts(df: DataFrame, text: str, key: str | None = None, pattern: str = tx.WORD_PATTERN) -> DataFrame:
    """Occurrences of each word: a CJK character or a run of ASCII letters, lower-cased."""
    return _items_of(counting.tally(df, text, key, kinds=("word",), word_pattern=pattern), "word", *([] if key is None else [key]))


def _items_of(counts: DataFrame, kind: str, *keys: str) -> DataFrame:
    return counts.where(F.col("kind") == kind).select(*keys, F.col("item").alias(kind), "n")


def top_k(counts: DataFrame, item: str, k: int = 30) -> DataFrame:
    """Most frequent items, equal counts in the order of the item."""
    return counts.orderBy(F.desc("n"), item).limit(k)


def top_k_per(counts: DataFrame, key: str, item: str, k: int = 30) -> DataFrame:
    """Most frequent items of each key with their rank; ranks are cut before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.desc("n"), item)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _ranked_list(top: DataFrame, key: str, item: str, name: str) -> DataFrame:
    """One text per key: ``item=count`` in rank order (at most k entries)."""
    entries = F.array_sort(F.collect_list(F.struct("rank", item, "n")))
    shown = F.transform(entries, lambda e: F.concat_ws("=", e[item], e["n"].cast("string")))
    return top.groupBy(key).agg(F.array_join(shown, "|").alias(name))


def dataset_report(df: DataFrame, text: str, key: str, k: int = 30) -> DataFrame:
    """Everything known about each file in one row: statistics, line lengths, histogram, top items.

    The texts are read once, into a written table of counts that all parts are taken from.
    """
    tally = checkpointed(counting.tally(df, text, key, kinds=("measure", "line", "char", "word")))
    counts = _lengths_of(tally, key)
    histogram = line_length_histogram(counts, key)
    bars = F.array_sort(F.collect_list(F.struct("bin", "range", "n")))
    histogram = histogram.groupBy(key).agg(
        F.array_join(F.transform(bars, lambda b: F.concat_ws(":", b["range"], b["n"].cast("string"))), " ").alias(
            "histogram"
        )
    )
    chars = _ranked_list(top_k_per(_items_of(tally, "char", key), key, "char", k), key, "char", "top_chars")
    words = _ranked_list(top_k_per(_items_of(tally, "word", key), key, "word", k), key, "word", "top_words")
    report = _stats_of(tally.where("kind = 'measure'"), key).join(line_length_distribution(counts, key), key, "left")
    for part in (histogram, chars, words):
        report = report.join(part, key, "left")
    return report


def row_counts(df: DataFrame, text: str, key: str) -> DataFrame:
    """Rows a file holds when read as records, as JSON lines, and as CSV with a header line."""
    newlines = tx.newline_count(text)
    return df.groupBy(key).agg(
        F.count("*").alias("records"),
        F.sum(tx.non_blank_lines(text)).alias("jsonl_rows"),
        F.sum(newlines).cast("bigint").alias("csv_rows"),
    )


# ---- column profiles -------------------------------------------------------

# The type name reported for each Spark type.
TYPE_NAMES = {
    "string": "str", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int",
    "float": "float", "double": "float", "boolean": "bool",
}


def cells_of_columns(df: DataFrame, order: str) -> DataFrame:
    """A table as cells ``(ord, pos, name, type, value)``, one per row and column."""
    cells = []
    for pos, (name, kind) in enumerate(df.dtypes):
        label = TYPE_NAMES.get(kind, "list" if kind.startswith("array") else "dict")
        value = F.col(name).cast("string") if label not in ("list", "dict") else F.to_json(name)
        cells.append(
            F.struct(
                F.lit(pos).alias("pos"),
                F.lit(name).alias("name"),
                F.when(F.col(name).isNull(), "NoneType").otherwise(label).alias("type"),
                F.coalesce(value, F.lit("")).alias("value"),
            )
        )
    return df.select(F.col(order).alias("ord"), F.inline(F.array(*cells)))


def cells_of_records(df: DataFrame, line: str, order: str) -> DataFrame:
    """JSON lines as cells; records may differ in their keys, lines that are no object are left out.

    A cell's ``pos`` is the place of its key in the record as written.
    """
    keys = F.from_json(line, "map<string,variant>", tx.ANY_LENGTH)
    parsed = df.select(F.col(order).alias("ord"), F.when(tx.valid_json(F.col(line)), keys).alias("record"))
    cells = parsed.select("ord", F.posexplode("record").alias("pos", "name", "value"))
    kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
    label = (
        F.when(kind == "STRING", "str")
        .when(kind == "BIGINT", "int")
        .when(kind.isin("DOUBLE", "DECIMAL", "FLOAT"), "float")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "ARRAY", "list")
        .when(kind == "OBJECT", "dict")
        .otherwise("NoneType")
    )
    shown = F.when(label == "NoneType", "").when(label == "str", F.col("value").cast("string")).otherwise(
        F.to_json("value")
    )
    return cells.select("ord", "pos", "name", label.alias("type"), shown.alias("value"))


def column_profile(cells: DataFrame, sample: DataFrame) -> DataFrame:
    """Per column: cells, filled cells, main type, mean sample length, fill rate, and five samples.

    ``cells`` are the rows to profile (all of them, or the first few); the five
    samples come from ``sample``, the cells of the first rows, a bounded set.
    """
    filled = ~tx.is_blank(F.col("value"))
    shown = F.length(F.substring("value", 1, SAMPLE_CHARS))
    by_type = cells.groupBy("name", "type").agg(
        F.count("*").alias("n"),
        F.count_if(filled).alias("non_empty"),
        F.sum(F.when(filled, shown).otherwise(0)).cast("bigint").alias("chars"),
        F.min("pos").alias("pos"),
    )
    stats = by_type.groupBy("name").agg(
        F.min("pos").alias("pos"),
        F.sum("n").alias("row_count"),
        F.sum("non_empty").alias("non_empty"),
        (F.sum("chars") / F.greatest(F.sum("non_empty"), F.lit(1))).alias("avg_len"),
        (F.sum("non_empty") * 100 / F.sum("n")).alias("fill_rate"),
        F.max_by("type", F.struct("n", "type")).alias("primary_type"),
    )
    first = Window.partitionBy("name").orderBy("ord")
    samples = (
        sample.withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= SAMPLES_KEPT)
        .groupBy("name")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("rank", F.substring("value", 1, SAMPLE_CHARS).alias("value")))),
                    lambda s: s["value"],
                ),
                " | ",
            ).alias("samples")
        )
    )
    return stats.join(samples, "name", "left")


def with_column_roles(profile: DataFrame) -> DataFrame:
    """Flags: usable as training text, holds conversations."""
    hinted = F.lower("name").rlike("|".join(CONVERSATION_WORDS))
    return profile.withColumn(
        "is_text",
        (F.col("primary_type") == "str") & (F.round("avg_len", 1) > 10) & (F.round("fill_rate", 1) > 50),
    ).withColumn(
        "is_conversation", (F.col("primary_type") == "list") | ((F.col("primary_type") == "str") & hinted)
    )


def suggest_columns(profile: DataFrame) -> DataFrame:
    """Text columns, known names first, then in column order."""
    names = F.array(*[F.lit(n) for n in SUGGESTED_COLUMNS])
    known = F.array_position(names, F.col("name"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.when(known > 0, known).otherwise(1000), "pos", "name")
    return (
        with_column_roles(profile)
        .where("is_text")
        .select("name", F.row_number().over(order).cast("bigint").alias("rank"))
    )
