"""Writers: JSON lines, text corpora, and packed token shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Vocabularies below this size fit 16-bit ids.
SHORT_VOCABULARY = 65536
# Consecutive blocks that one task writes behind one another.
RANGE_BLOCKS = 4096


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, nulls kept, other scripts written as they are."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_corpus(df: DataFrame, text: str, path: str, mode: str = "errorifexists") -> None:
    """Records of text, a blank line after each."""
    df.select(F.col(text).alias("value")).write.mode(mode).option("lineSep", "\n\n").text(path)


def token_dtype(vocab_size) -> Column | str:
    """``H`` (16 bits) for a small vocabulary, else ``I`` (32 bits)."""
    if isinstance(vocab_size, int):
        return "H" if vocab_size < SHORT_VOCABULARY else "I"
    return F.when(vocab_size < SHORT_VOCABULARY, F.lit("H")).otherwise(F.lit("I"))


def _dealt(blocks: DataFrame) -> DataFrame:
    """Ranges of numbers dealt to tasks by hash, in order inside a task: nothing is sampled, so blocks are computed once."""
    return blocks.repartition(F.expr(f"seq_id div {RANGE_BLOCKS}")).sortWithinPartitions("seq_id")


def write_packed(blocks: DataFrame, path: str, meta: DataFrame, mode: str = "errorifexists") -> None:
    """Canonical form: blocks as Parquet, each file in sequence order, the meta row as JSON beside them."""
    _dealt(blocks).write.mode(mode).parquet(f"{path}/blocks")
    meta.write.mode(mode).option("ignoreNullFields", "false").json(f"{path}/meta")


def read_processed_meta(spark, pattern: str) -> DataFrame:
    """Meta rows of processed data sets, named by the folder they lie in."""
    rows = spark.read.json(pattern)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/meta/[^/]*$", 1)
    return rows.select("*", name.alias("name")).orderBy("name")


def pack_bytes(blocks: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Blocks as byte strings ``(first_seq, n_sequences, <column>...)``, in sequence order.

    ``columns`` maps an array column to its element type: H, I (little-endian
    16 and 32 bits) or B (8 bits). Every run of consecutive numbers in an Arrow
    batch gives one row, so a row's blocks are exactly those from ``first_seq``
    on, also where numbers are missing, and memory stays at a batch.
    """
    numpy_types = {"H": "<u2", "I": "<u4", "B": "u1"}
    names = list(columns)
    types = [numpy_types[columns[n]] for n in names]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            numbers = batch.column("seq_id").to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.flatnonzero(np.diff(numbers) != 1) + 1))
            ends = np.append(starts[1:], len(numbers))
            payloads = []
            for name, kind in zip(names, types):
                runs = (batch.column(name).slice(a, b - a).flatten() for a, b in zip(starts.tolist(), ends.tolist()))
                payloads.append(pa.array([r.to_numpy(zero_copy_only=False).astype(kind).tobytes() for r in runs], pa.binary()))
            labels = [pa.array(numbers[starts], pa.int64()), pa.array(ends - starts, pa.int64())]
            yield pa.RecordBatch.from_arrays([*labels, *payloads], names=["first_seq", "n_sequences", *names])

    schema = "first_seq bigint, n_sequences bigint, " + ", ".join(f"{n} binary" for n in names)
    return _dealt(blocks.select("seq_id", *names)).mapInArrow(encode, schema)


def as_array(values: list[int], kind: str) -> np.ndarray:
    """Read-back helper for exported shards."""
    return np.array(values, dtype={"H": "<u2", "I": "<u4", "B": "u1"}[kind])
