"""Whole jobs: training corpora from files, examples from conversations, and bulk imports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import templates as tp, text as tx
from ..operators import bpe, convert, extract, formats as fm, packing, sft
from ..sources import files

# A file's chunks are numbered below this, so file and chunk make one order key.
_FILE_STRIDE = 1 << 32


@dataclass
class Corpus:
    """Blocks of token ids and the one-row description of how they came about."""

    blocks: DataFrame
    meta: DataFrame


def encode_files(
    records: DataFrame,
    tokenizer: bpe.Tokenizer,
    source: str = "source",
    order: str = "rec_ord",
    text: str = "text",
    chunk_chars: int = packing.CHUNK_CHARS,
    gap=packing.RECORD_SEPARATOR,
) -> DataFrame:
    """Records joined per file, cut into chunks, and encoded: ``(source, chunk, text, ids)``."""
    chunks = packing.chunk_text(records, [source], order, text, chunk_chars, gap)
    return bpe.encode_chunks(tokenizer, chunks)


def build_corpus(
    records: DataFrame,
    file_order: DataFrame,
    tokenizer: bpe.Tokenizer,
    seq_len: int,
    path: str,
    source: str = "source",
    order: str = "rec_ord",
    text: str = "text",
    chunk_chars: int = packing.CHUNK_CHARS,
    gap=packing.RECORD_SEPARATOR,
) -> Corpus:
    """Pretraining blocks over all files in list order.

    ``file_order`` is ``(source, file_ord)``; ``gap`` is put between the records
    of a file, as a text or a column. The encoded chunks are written to
    ``path`` once, so the costly encoding is not repeated by the two passes of
    packing (where each chunk starts, then the blocks).
    """
    encoded = encode_files(records, tokenizer, source, order, text, chunk_chars, gap).join(file_order, source)
    keyed = encoded.select(
        (F.col("file_ord") * _FILE_STRIDE + F.col("chunk")).alias("ord"), F.length("text").alias("chars"), "ids"
    )
    keyed.write.mode("overwrite").parquet(path)
    stored = records.sparkSession.read.parquet(path)
    meta = packing.processing_meta(stored, F.col("chars"), F.size("ids"), seq_len, tokenizer.size)
    return Corpus(packing.pack(stored, "ord", "ids", seq_len), meta)


def build_examples(
    conversations: DataFrame, conv: str, conv_id: str, tokenizer: bpe.Tokenizer, template: str, seq_len: int
) -> tuple[DataFrame, DataFrame, bpe.Tokenizer]:
    """Padded token and mask blocks of conversations, their meta row, and the tokenizer with the template's tokens."""
    grown, _ = tokenizer.with_special(tp.TEMPLATE_TOKENS[template])
    usable = extract.valid_conversations(conversations, conv)
    rendered = usable.select(conv_id, tp.rendered_turns(F.col(conv), template).alias("parts"))
    blocks = sft.pad_and_truncate(bpe.sft_examples(grown, rendered, "parts", conv_id), seq_len)
    return blocks, sft.processing_meta(blocks, template, seq_len, grown.size, tokenizer.size), grown


def read_records(spark: SparkSession, path: str, columns: list[str] | None = None, separator: str = "\n") -> DataFrame:
    """Records of one file as ``(source, rec_ord, text, gap)``, by its extension.

    Structured files give the chosen columns joined, a blank line apart.
    Without columns, or for plain text, the file is taken as it is: its lines
    are the records, a newline apart, so a large file stays split.
    """
    lowered = path.lower()
    if columns and lowered.endswith((".jsonl", ".json")):
        rows = files.read_jsonl(spark, path) if lowered.endswith(".jsonl") else files.read_json(spark, path)
        values = F.from_json("line", ", ".join(f"`{c}` string" for c in columns), tx.ANY_LENGTH)

        def if_text(c: str):
            value = F.try_variant_get(tx.parsed_json(F.col("line")), f'$["{c}"]', "variant")
            return F.when(F.schema_of_variant(value) == "STRING", values[c]).alias(c)

        parts = rows.select("source", F.col("line_no").alias("rec_ord"), *[if_text(c) for c in columns])
        records = extract.extract_columns(parts, columns, separator, keep_blank=True)
    elif columns and lowered.endswith((".csv", ".tsv")):
        rows = files.read_delimited(spark, path, numbered=True).select("source", "rec_ord", *columns)
        records = extract.extract_columns(rows, columns, separator)
    else:
        lines = files.read_lines(spark, path, closing_line=True)
        return lines.select("source", F.col("line_no").alias("rec_ord"), F.col("line").alias("text"), F.lit("\n").alias("gap"))
    return records.select("source", "rec_ord", "text", F.lit(packing.RECORD_SEPARATOR).alias("gap"))


def read_corpus(
    spark: SparkSession, paths: list[str], column_config: dict[str, list[str]] | None = None, separator: str = "\n"
) -> tuple[DataFrame, DataFrame]:
    """Records of the selected files and their list order ``(source, file_ord)``.

    ``column_config`` names the columns to take per file name.
    """
    config = column_config or {}
    parts = [read_records(spark, p, config.get(p.rsplit("/", 1)[-1]), separator) for p in paths]
    keyed = [part.withColumn("file_ord", F.lit(n)) for n, part in enumerate(parts)]
    records = keyed[0]
    for part in keyed[1:]:
        records = records.unionByName(part)
    return records.drop("file_ord"), records.groupBy("source").agg(F.min("file_ord").cast("bigint").alias("file_ord"))


def import_rows(rows: DataFrame, line: str, first_line: str | None = None) -> DataFrame:
    """Imported records in a standard format: ``(format, line)``.

    The first record decides the format of all, as an import of one data set
    does; standard formats are kept, dialogs and known field pairs are mapped.
    """
    first = first_line if first_line is not None else rows.select(line).first()[0]
    spark = rows.sparkSession
    probe = convert.parse_records(spark.createDataFrame([(first,)], f"{line} string"), line)

    def holds_objects(name: str):
        return F.get(F.col(f"rec.{name}"), F.lit(0)).isNotNull()

    dialog = F.coalesce(*[F.when(F.size(convert.dialog_values(F.col(line), n)) > 0, F.lit(n)) for n in fm.DIALOG_KEYS])
    keys = F.col("keys")
    decided = probe.select(
        fm.detect_bulk(keys, holds_objects("conversations"), holds_objects("messages"), dialog.isNotNull()).alias("format"),
        dialog.alias("dialog"),
        convert.text_route(F.col("rec.text")).alias("route"),
    ).first()
    fmt = decided["format"]
    parsed = convert.parse_records(rows, line)
    if fmt == "dialog":
        turns = parsed.select(convert.dialog_to_sharegpt(convert.dialog_values(F.col(line), decided["dialog"])).alias("conversations"))
        shaped = turns.where(F.size("conversations") > 0).select(F.to_json(F.struct("conversations")).alias("line"))
        return shaped.select(F.lit("sharegpt").alias("format"), "line")
    if fmt == "mapped":
        mapped = convert.fields_to_alpaca(keys, F.col("rec"))
        return parsed.select(F.lit("alpaca").alias("format"), F.to_json(mapped).alias("line"))
    if fmt == "text" and decided["route"] == "alpaca":
        bare = F.struct(
            F.coalesce("rec.text", F.lit("")).alias("instruction"), F.lit("").alias("input"), F.lit("").alias("output")
        )
        return parsed.select(F.lit("alpaca").alias("format"), F.to_json(bare).alias("line"))
    name = "raw" if fmt == "text" else fmt
    return rows.select(F.lit(name).alias("format"), F.col(line).alias("line"))
