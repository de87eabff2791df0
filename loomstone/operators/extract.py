"""From records to training text: column choice, joining, separators, previews and filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx

PREVIEW_LINES = 30
SAMPLE_CHARS = 500

# Column names taken as the text of a table, in order of preference.
TEXT_COLUMNS = [
    "text", "content", "story", "document", "passage", "sentence",
    "input", "output", "question", "answer", "prompt", "completion",
]


def join_columns(columns: Sequence[Column], separator: str = "\n", keep_blank: bool = False) -> Column:
    """Stripped columns joined to one text, null when there is no part.

    With ``keep_blank`` (the rule for JSON records) a value of only white space
    still counts as an empty part; without (the rule for CSV rows) it is left out.
    """

    def part(c: Column) -> Column:
        stripped = tx.strip(c)
        return F.when((c if keep_blank else stripped) != "", stripped)

    parts = [part(c) for c in columns]
    any_part = F.coalesce(*parts).isNotNull()
    return F.when(any_part, F.concat_ws(separator, *parts))


def extract_columns(df: DataFrame, columns: Sequence[str], separator: str = "\n", keep_blank: bool = False) -> DataFrame:
    """Add ``text`` from the chosen columns and drop records without any."""
    return df.withColumn("text", join_columns([F.col(c) for c in columns], separator, keep_blank)).where(
        "text IS NOT NULL"
    )


def extract_by_config(rows: DataFrame, config: DataFrame, source: str, fields: str, plain: str, separator: str = "\n") -> DataFrame:
    """Text of records whose files each choose their own columns.

    ``rows`` carries a record as a map ``fields``; ``config`` has the chosen
    ``columns`` per ``source``. A file without configuration keeps ``plain``.
    Whether the configuration is broadcast is left to its measured size.
    """
    joined = rows.join(config.select(source, "columns"), source, "left")
    values = F.transform("columns", lambda name: tx.strip(F.element_at(F.col(fields), name)))
    parts = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    text = F.when(F.col("columns").isNull(), F.col(plain)).when(F.size(parts) > 0, F.array_join(parts, separator))
    return joined.withColumn("text", text).where("text IS NOT NULL").drop("columns")


def pick_text_column(df: DataFrame, first_row=None) -> str:
    """Name of the text column: a known name, else the first holding a longer string, else the first."""
    for name in TEXT_COLUMNS:
        if name in df.columns:
            return name
    row = first_row if first_row is not None else df.first()
    if row is not None:
        for name in df.columns:
            if isinstance(row[name], str) and len(row[name]) > 10:
                return name
    return df.columns[0]


def corpus_text(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """The chosen column as stripped text, blank rows dropped."""
    return df.select(*keep, tx.strip(F.coalesce(F.col(column).cast("string"), F.lit(""))).alias("text")).where("text <> ''")


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows in the given order (a top-k, not a full sort); all when ``n`` is 0."""
    return df.orderBy(order).limit(n) if n > 0 else df


def preview(df: DataFrame, text: str, *keep: str, max_lines: int = PREVIEW_LINES) -> DataFrame:
    total = tx.newline_count(text).cast("bigint") + 1
    return df.select(
        *keep,
        F.substring_index(text, "\n", max_lines).alias("preview"),
        total.alias("total_lines"),
        F.least(total, F.lit(max_lines)).cast("bigint").alias("shown_lines"),
    )


def record_sample(line: Column, keys: Column) -> list[Column]:
    """A record cut for display, and its sorted column names."""
    return [tx.truncated(line, SAMPLE_CHARS).alias("sample"), F.array_join(F.array_sort(keys), ",").alias("columns")]


def facet_filter(
    catalog: DataFrame,
    vendor: str = "",
    size: str = "",
    access: str = "",
    search: str = "",
    columns: dict[str, str] | None = None,
) -> DataFrame:
    """Catalogue rows passing every facet that is set.

    ``size`` is one of the bands 3, 8, 14 (at most) and 72 (above 14),
    ``access`` is open or gated, ``search`` is looked for in name and id,
    ignoring case. ``columns`` names the catalogue's columns.
    """
    c = {"vendor": "vendor", "params": "params", "gated": "gated", "name": "name", "id": "id", **(columns or {})}
    kept = catalog
    if vendor:
        kept = kept.where(F.col(c["vendor"]) == vendor)
    if size == "72":
        kept = kept.where(F.col(c["params"]) > 14)
    elif size:
        kept = kept.where(F.col(c["params"]) <= int(size))
    if access == "open":
        kept = kept.where(~F.col(c["gated"]))
    elif access == "gated":
        kept = kept.where(F.col(c["gated"]))
    if search:
        needle = F.lit(search.lower())
        kept = kept.where(
            F.contains(F.lower(c["name"]), needle) | F.contains(F.lower(F.col(c["id"]).cast("string")), needle)
        )
    return kept


def valid_conversations(df: DataFrame, conv: str) -> DataFrame:
    """Rows whose conversation is a list of at least two turns."""
    return df.where(F.size(conv) >= 2)
