"""Counts over texts, a whole Arrow batch at a time: code points are classed through one table, then summed.

Everything a profile needs is additive, so a batch gives a few rows per key (one per counter, line length, character
or word it holds) and Spark adds them up: one reading of the texts, whatever is asked.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx

# Work arrays take about 80 times as much.
SLICE_BYTES = 1 << 19
# One bit per class; the last two are set by position.
CJK, LETTER, DIGIT, SPACE, PUNCTUATION, NEWLINE, WORD, LINE = (1 << i for i in range(8))
# No letter, number or white space lies beyond; what does counts as punctuation.
TABLE_SIZE = 0x40000
COUNTERS = {
    "cjk": CJK, "ascii_letters": LETTER, "digits": DIGIT, "punctuation": PUNCTUATION, "spaces": SPACE,
    "newlines": NEWLINE, "words": WORD, "non_blank_lines": LINE,
}
MEASURES = ["chars", "lines", *COUNTERS]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.zeros(TABLE_SIZE, np.uint8)
    for point in range(TABLE_SIZE - 1):
        char = chr(point)
        if unicodedata.category(char)[0] not in "LN":
            table[point] = PUNCTUATION
        elif char.isdigit():
            table[point] = DIGIT
    table[-1] = PUNCTUATION
    table[[ord(c) for c in tx.WHITESPACE]] = SPACE
    table[ord("\n")] |= NEWLINE
    table[0x4E00:0xA000] |= CJK
    for first in "Aa":
        table[ord(first) : ord(first) + 26] |= LETTER
    return table


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts (the first column) hold about ``SLICE_BYTES``; one text stays whole."""
    for batch in batches:
        if batch.num_rows:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = np.flatnonzero(np.diff(ends // SLICE_BYTES)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                yield batch.slice(a, b - a)


def _decoded(column: pa.Array) -> tuple[str, np.ndarray]:
    """All texts of a column behind one another, and the code points of each; bytes that are no UTF-8 are replaced."""
    values = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    held = memoryview(values.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    try:
        text = str(held, "utf-8")
    except UnicodeDecodeError:
        texts = [value.decode("utf-8", "replace") for value in values.to_pylist()]
        return "".join(texts), np.array([len(t) for t in texts], np.int64)
    # A code point begins at every byte that continues none.
    begins = np.concatenate(([0], np.cumsum((np.frombuffer(held, np.uint8) & 0xC0) != 0x80, dtype=np.int64)))
    return text, np.diff(begins[offsets - offsets[0]])


class _Texts:
    """The texts of a slice with the class bits of every code point."""

    def __init__(self, column: pa.Array):
        self.text, self.lengths = _decoded(column)
        self.points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.ends = np.cumsum(self.lengths)
        self.owner = np.repeat(np.arange(len(self.lengths)), self.lengths)
        bits = _classes()[np.minimum(self.points, TABLE_SIZE - 1)]
        space = (bits & SPACE) > 0
        begins = np.zeros(len(bits) + 1, bool)
        begins[(self.ends - self.lengths)[self.lengths > 0]] = True
        begins = begins[:-1]
        before = np.empty_like(space)
        before[:1], before[1:] = True, space[:-1]
        bits[~space & (before | begins)] |= WORD
        # A line begins with a text and behind each newline; its first character that is no space counts it.
        line_begins = begins.copy()
        line_begins[1:] |= (bits[:-1] & NEWLINE) > 0
        filled = np.flatnonzero(~space)
        line = np.cumsum(line_begins)[filled]
        bits[filled[np.diff(line, prepend=0) > 0]] |= LINE
        self.bits = bits

    def measures(self) -> dict[str, np.ndarray]:
        rows = len(self.lengths)
        cells = np.bincount(self.owner << 8 | self.bits, minlength=rows << 8).reshape(rows, 256)
        found = {name: cells[:, (np.arange(256) & bit) > 0].sum(axis=1) for name, bit in COUNTERS.items()}
        open_end = np.zeros(rows, np.int64)
        held = self.lengths > 0
        open_end[held] = (self.bits[self.ends[held] - 1] & NEWLINE) == 0
        return {"chars": self.lengths, "lines": found["newlines"] + open_end, **found}

    def line_lengths(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and length of every non-blank line."""
        newline = (self.bits & NEWLINE) > 0
        last = np.zeros(len(self.bits), bool)
        last[self.ends[self.lengths > 0] - 1] = True
        ends = np.flatnonzero(newline | last)
        starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        counted = np.concatenate(([0], np.cumsum((self.bits & LINE) > 0)))
        filled = counted[ends + 1] > counted[starts]
        return self.owner[starts[filled]], (ends - starts + ~newline[ends])[filled]


def measured(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep`` columns and the ``MEASURES`` of every row's text; null for a null text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            column = batch.column(0)
            empty = column.is_null().to_numpy(zero_copy_only=False)
            found = _Texts(column).measures()
            columns = [pa.array(found[name], pa.int64(), mask=empty) for name in MEASURES]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=[*keep, *MEASURES])

    schema = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keep) + ", ".join(f"{m} bigint" for m in MEASURES)
    return df.select(F.col(text).alias("_text"), *keep).mapInArrow(measure, schema)


def tally(df: DataFrame, text: str, key: str | None = None, *, kinds: tuple[str, ...], word_pattern: str = tx.WORD_PATTERN) -> DataFrame:
    """Counts ``n`` per key of the ``kinds`` asked for, from one reading of the texts: ``(key, kind, item, length, n)``.

    ``measure``: ``item`` names one of ``MEASURES``, null counts where a key has null texts only. ``line``: non-blank lines by
    ``length``. ``char`` and ``word``: occurrences of ``item``, words in lower case. A null key is a key of its own.
    """
    pattern = re.compile(word_pattern)
    keys = [] if key is None else [key]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = _Texts(batch.column(0))
            if keys:
                coded = batch.column(1).dictionary_encode(null_encoding="encode")
                owner, groups = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
            else:
                owner, groups = np.zeros(batch.num_rows, np.int64), 1
            for kind in kinds:
                length = item = None
                if kind == "measure":
                    found = texts.measures()
                    known = np.bincount(owner[batch.column(0).is_valid().to_numpy(zero_copy_only=False)], minlength=groups) > 0
                    # Sums of whole numbers below 2 ** 53 are exact.
                    sums = np.concatenate([np.bincount(owner, weights=found[name], minlength=groups) for name in MEASURES])
                    group = np.tile(np.arange(groups), len(MEASURES))
                    item = pa.array(np.repeat(MEASURES, groups), pa.string())
                    n = pa.array(sums.astype(np.int64), pa.int64(), mask=~known[group])
                elif kind == "line":
                    of, lengths = texts.line_lengths()
                    cells, n = np.unique(owner[of] << 40 | lengths, return_counts=True)
                    group, length, n = cells >> 40, pa.array(cells & (1 << 40) - 1, pa.int64()), pa.array(n, pa.int64())
                elif kind == "char":
                    cells, n = np.unique(owner[texts.owner] << 21 | texts.points, return_counts=True)
                    item = pa.array([chr(c) for c in (cells & 0x1FFFFF).tolist()], pa.string())
                    group, n = cells >> 21, pa.array(n, pa.int64())
                else:
                    group, words, n = _words(texts, owner, pattern)
                    item, n = pa.array(words, pa.string()), pa.array(n, pa.int64())
                rows = len(n)
                owners = [coded.dictionary.take(pa.array(group))] if keys else []
                yield pa.RecordBatch.from_arrays(
                    [
                        *owners,
                        pa.array([kind] * rows, pa.string()),
                        pa.nulls(rows, pa.string()) if item is None else item,
                        pa.nulls(rows, pa.int64()) if length is None else length,
                        n,
                    ],
                    names=[*keys, "kind", "item", "length", "n"],
                )

    declared = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    partial = df.select(F.col(text).alias("_text"), *keys).mapInArrow(count, f"{declared}kind string, item string, length bigint, n bigint")
    return partial.groupBy(*keys, "kind", "item", "length").agg(F.sum("n").alias("n"))


def _words(texts: _Texts, owner: np.ndarray, pattern: re.Pattern) -> tuple[np.ndarray, list[str], list[int]]:
    """Words of each key with their counts; texts of one key are joined by line ends, which no word holds."""
    ends = texts.ends.tolist()
    parts: dict[int, list[str]] = {}
    for group, a, b in zip(owner.tolist(), [0, *ends], ends):
        parts.setdefault(group, []).append(texts.text[a:b])
    counts = {group: Counter(pattern.findall("\n".join(found).lower())) for group, found in parts.items()}
    groups = np.repeat(np.array(list(counts), np.int64), [len(c) for c in counts.values()])
    return groups, [w for c in counts.values() for w in c], [n for c in counts.values() for n in c.values()]
