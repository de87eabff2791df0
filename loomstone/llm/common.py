"""Helpers shared by the operators: scratch tables, Arrow batches and hashed words.

Words are the maximal runs of bytes other than space, \\t, \\n, \\v, \\f and \\r, with A-Z in
lower case. Hashing works on the UTF-8 buffers of Arrow batches with numpy, in
slices of bounded size, so neither a long text nor a large batch needs more than
a few arrays of slice length besides one entry per word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import ensure_checkpoint_dir

SLICE_BYTES = 128 << 10
CHUNK_BYTES = 8 << 20


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables below the shared checkpoint folder, removed by ``drop`` once nothing reads them."""

    def __init__(self, spark, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` and go on from its files: lineage ends there, and executors may be lost."""
        path = f"{self.root}/{name}"
        df.write.options(**options).mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for path in [f"{self.root}/{n}" for n in names] or [self.root]:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def remainder(doc_id, divisor: int):
    """crc32 of the id as text modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % divisor


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each hold about ``limit`` bytes at most (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = text_buffer(batch.column(batch.schema.get_field_index(text)))[1][1:]
        first = 0
        while first < batch.num_rows:
            begun = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, begun + limit, side="right")))
            yield batch.slice(first, last - first)
            first = last


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and where each begins (one entry more); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if buffers[1] is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    places = np.frombuffer(buffers[1], np.int64 if wide else np.int32)
    places = places[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[places[0] : places[-1]], places - places[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """The first ``n`` numbers of the splitmix64 stream of ``seed``."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = stream(1, 256)
_BYTE[65:91] = _BYTE[97:123]


class Words(NamedTuple):
    """Words of a chunk in order: byte range, index of the text, hash."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def split_words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """Words of all texts in ``data``, hashed with A-Z in lower case to 64 bits."""
    starts, ends, hashes = [], [], []
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    at = 0
    while at < len(data):
        to = min(len(data), at + SLICE_BYTES)
        if to < len(data):
            gap = np.flatnonzero(space[data[at:to]])
            if len(gap):
                to = at + int(gap[-1]) + 1
            else:  # no gap in the slice: up to the next one, or to the end of the text
                end = int(offsets[np.searchsorted(offsets, to, side="left")])
                gap = np.flatnonzero(space[data[to:end]])
                to = to + int(gap[0]) + 1 if len(gap) else end
        piece = data[at:to]
        word = ~space[piece]
        first = np.zeros(len(piece) + 1, bool)
        first[firsts[(firsts >= at) & (firsts < to)] - at] = True
        first[-1] = True
        before = np.concatenate(([False], word[:-1]))
        begins = np.flatnonzero(word & (~before | first[:-1]))
        if len(begins):
            after = np.concatenate((word[1:], [False]))
            stops = np.flatnonzero(word & (~after | first[1:])) + 1
            inside = np.flatnonzero(word)
            size = stops - begins
            row = np.repeat(np.cumsum(size) - size, size)
            place = (np.arange(len(inside)) - row).astype(np.int32)
            values = _BYTE[piece[inside]] * _places(int(size.max()))[place]
            hashes.append(mix(np.add.reduceat(values, np.cumsum(size) - size) + size.astype(np.uint64)))
            starts.append(begins + at)
            ends.append(stops + at)
        at = to
    if not starts:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64))
    start = np.concatenate(starts)
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(start, np.concatenate(ends), doc, np.concatenate(hashes))


_PLACES = [stream(2, 64) | np.uint64(1)]


def _places(n: int) -> np.ndarray:
    """Odd multipliers of the byte positions in a word."""
    if len(_PLACES[0]) < n:
        _PLACES[0] = stream(2, 2 * n) | np.uint64(1)
    return _PLACES[0]


def bounded_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` rows with the smallest digest of ``key``: repeatable, and a heap per task."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)
