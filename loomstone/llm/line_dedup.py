"""Removal of repeated lines by probing a sharded minimal perfect hash.

Lines become 128-bit hashes once, in the JVM. Hashes found in enough documents are dealt to shards; each shard is a minimal
perfect hash (bit levels: a key takes the first level on which it is alone) that indexes three arrays: fingerprints, which tell a stranger, document
counts, and the document that keeps the line. Documents send their hashes, packed, to the shards and get back the numbers of
the lines to drop; texts are never grouped by line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, mix

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_DOCS = 20, 3
#: Keys of a shard at most (on average), and those of a small index that is dealt to all cores.
SHARD_KEYS, LEAST_KEYS = 16384, 256
#: Probes of a packed row; packed rows that one copy of a shard answers.
PACK, PACKS_PER_COPY = 512, 256
_WAITING = 1 << 18
GAMMA, LEVELS = 2, 48


# ---- minimal perfect hash ----------------------------------------------------------------


def _slots(key: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(key + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)).astype(np.int64)


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return first ^ mix(second + np.uint64(0x9E3779B97F4A7C15))


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct 128-bit keys; any number for other keys.

    A level is a row of bits, twice as many as keys are left; keys alone on their bit set it and are numbered by their rank, the others
    go to the next level. Keys left after the last level (their 64-bit mixtures coincide) are kept as they are.
    """

    def __init__(self, levels: list[np.ndarray], left: np.ndarray):
        self.levels, self.left = levels, left
        counts = [int(bits.sum()) for bits in levels]
        self.first = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        self.ranks = [np.cumsum(bits, dtype=np.int64) - 1 for bits in levels]
        self.rest = {tuple(k): int(self.first[-1]) + i for i, k in enumerate(left.tolist())}

    @classmethod
    def build(cls, first: np.ndarray, second: np.ndarray) -> PerfectHash:
        key, pairs, levels = _joined(first, second), np.stack((first, second), axis=1), []
        while len(key) and len(levels) < LEVELS:
            size = max(8, GAMMA * len(key))
            slot = _slots(key, len(levels), size)
            alone = np.bincount(slot, minlength=size) == 1
            levels.append(alone)
            stays = ~alone[slot]
            key, pairs = key[stays], pairs[stays]
        return cls(levels, pairs)

    def number(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Number of each key; -1 for a key that no level knows."""
        key, out, open_ = _joined(first, second), np.full(len(first), -1, np.int64), np.arange(len(first))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            slot = _slots(key[open_], level, len(bits))
            hit = bits[slot]
            out[open_[hit]] = self.first[level] + self.ranks[level][slot[hit]]
            open_ = open_[~hit]
        if self.rest:
            for i in open_:
                out[i] = self.rest.get((int(first[i]), int(second[i])), -1)
        return out

    def dump(self) -> dict:
        return {
            "sizes": [len(bits) for bits in self.levels], "bits": np.packbits(np.concatenate(self.levels)).tobytes() if self.levels else b"",
            "rest": np.ascontiguousarray(self.left, np.uint64).tobytes(),
        }

    @classmethod
    def load(cls, row: dict) -> PerfectHash:
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8)).astype(bool)
        cuts = np.cumsum([0, *row["sizes"]])
        return cls([bits[a:b] for a, b in zip(cuts, cuts[1:])], np.frombuffer(row["rest"], np.uint64).reshape(-1, 2))


# ---- index ------------------------------------------------------------------------


_INDEX = "shard bigint, sizes array<int>, bits binary, rest binary, prints binary, counts binary, keepers binary"


def _build(table: pa.Table) -> pa.Table:
    first, second = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
    perfect = PerfectHash.build(first, second)
    place = perfect.number(first, second)
    prints, counts, keepers = np.empty(len(first), np.uint64), np.empty(len(first), np.int32), np.empty(len(first), np.int64)
    prints[place] = second
    counts[place] = np.minimum(table.column("n_docs").to_numpy(), np.iinfo(np.int32).max)
    keepers[place] = table.column("keeper").to_numpy()
    row = {"shard": table.column("shard")[0].as_py(), **perfect.dump(), "prints": prints.tobytes(), "counts": counts.tobytes(), "keepers": keepers.tobytes()}
    kinds = [pa.int64(), pa.list_(pa.int32()), *[pa.binary()] * 5]
    return pa.Table.from_pylist([row], schema=pa.schema([(f.split()[0], k) for f, k in zip(_INDEX.split(", "), kinds)]))


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, text_hash, line, h1, h2) of every line whose key is long enough, for documents with an id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("doc"), F.xxhash64(text).alias("text_hash"), F.split(text, "\n", -1).alias("lines"))
    lines = known.select("doc", "text_hash", F.posexplode("lines").alias("line", "content"))
    # A line shorter than that has a shorter key, and need not be looked at.
    keys = lines.where(F.length("content") >= min_chars).select("doc", "text_hash", "line", F.translate(F.trim("content", F.lit(SPACES)), UPPER, LOWER).alias("key"))
    return keys.where(F.length("key") >= min_chars).select("doc", "text_hash", "line", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def build_index(lines: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS) -> tuple[DataFrame, int]:
    """Shards of the distinct line hashes that at least ``min_docs`` documents hold, and how many shards there are."""
    spark = lines.sparkSession
    held = lines.select("h1", "h2", "doc").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keeper"))
    distinct = scratch.keep(held.where(F.col("n_docs") >= min_docs), "keys")
    keys = distinct.count()
    shards = max(1, -(-keys // SHARD_KEYS), min(2 * spark.sparkContext.defaultParallelism, -(-keys // LEAST_KEYS)))
    dealt = distinct.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("bigint"))
    return scratch.keep(dealt.groupBy("shard").applyInArrow(_build, _INDEX), "index"), shards


# ---- probing ------------------------------------------------------------------------


_PACKS = "shard bigint, h1 binary, h2 binary, doc binary, text_hash binary, line binary"
_REFS = (("h1", np.int64), ("h2", np.int64), ("doc", np.int64), ("text_hash", np.int64), ("line", np.int32))


def _pack(shards: int):
    """Line hashes of a task by shard, in rows of at most ``PACK``; few wait at a time."""

    def run(batches):
        waiting: list[tuple] = []

        def out(flush: bool):
            columns = [np.concatenate(c) for c in zip(*waiting)] if waiting else [np.zeros(0, np.int64)] * (len(_REFS) + 1)
            by = np.argsort(columns[0], kind="stable")
            columns = [c[by] for c in columns]
            begins = np.flatnonzero(np.concatenate(([True], np.diff(columns[0]) != 0))) if len(by) else []
            rows = []
            for a, b in zip(begins, [*begins[1:], len(by)]):
                for at in range(a, b, PACK):
                    cut = slice(at, min(b, at + PACK))
                    rows.append([int(columns[0][a]), *(np.ascontiguousarray(c[cut], kind).tobytes() for c, (_, kind) in zip(columns[1:], _REFS))])
            names = [f.split()[0] for f in _PACKS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows))], names=names) if rows else None

        count = 0
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c, _ in _REFS]
            waiting.append((columns[0] % np.int64(shards), *columns))  # numpy's remainder is never negative
            count += batch.num_rows
            if count >= _WAITING:
                made = out(True)
                waiting, count = [], 0
                yield made
        made = out(True)
        if made:
            yield made

    return run


def _probe(min_docs: int):
    """Sorted index shards and the packs that follow each, to the lines that go."""

    def run(batches):
        perfect = prints = counts = keepers = held = None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["kind"] == 0:
                    perfect, held = PerfectHash.load(r), r["shard"]
                    prints, counts, keepers = np.frombuffer(r["prints"], np.uint64), np.frombuffer(r["counts"], np.int32), np.frombuffer(r["keepers"], np.int64)
                    continue
                if r["shard"] != held:
                    continue  # no line of this shard repeats
                h1, h2, doc, text_hash, line = (np.frombuffer(r[c], kind) for c, kind in _REFS)
                h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
                place = perfect.number(h1, h2)
                known = np.flatnonzero(place >= 0)
                known = known[prints[place[known]] == h2[known]]
                goes = known[(counts[place[known]] >= min_docs) & (keepers[place[known]] != doc[known])]
                if len(goes):
                    yield pa.RecordBatch.from_arrays([pa.array(doc[goes]), pa.array(text_hash[goes]), pa.array(line[goes])], names=["doc", "text_hash", "line"])

    return run


def lines_to_drop(lines: DataFrame, index: DataFrame, shards: int, scratch: Scratch, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc, text_hash, gone): the numbers of the lines that each document loses.

    A shard that many packs ask is answered by as many copies of it, so a very common line does not make one long task.
    """
    packs = scratch.keep(lines.mapInArrow(_pack(shards), _PACKS), "packs")
    asked = packs.groupBy("shard").agg(F.count("*").alias("n")).select("shard", F.expr(f"1 + (n - 1) div {PACKS_PER_COPY}").alias("copies"))
    copy = F.pmod(F.xxhash64("h1", "doc"), "copies")
    names = [f.split()[0] for f in f"{_PACKS}, {_INDEX}".split(", ")]
    names = list(dict.fromkeys(names))

    def filled(df: DataFrame, kind: int, number) -> DataFrame:
        missing = {c: F.lit(None).cast("array<int>" if c == "sizes" else "binary") for c in names if c not in df.columns}
        return df.withColumn("copy", number).withColumns({"kind": F.lit(kind), **missing}).select("shard", "copy", "kind", *[c for c in names if c != "shard"])

    arrays = filled(index.join(asked, "shard").withColumn("number", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))), 0, F.col("number").cast("bigint"))
    probes = filled(packs.join(asked, "shard"), 1, copy.cast("bigint"))
    met = arrays.unionAll(probes).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    gone = met.mapInArrow(_probe(min_docs), "doc bigint, text_hash bigint, line int")
    return gone.groupBy("doc", "text_hash").agg(F.collect_set("line").alias("gone"))


def drop_repeated_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Documents without the lines that others repeat: (id, text, n_lines, n_dropped), a row for every input row.

    Text is split at \\n; a null or empty text is one empty line. A line's key is the line without white space (space, \\t to \\r) at
    both ends, A-Z in lower case. Keys of at least ``min_chars`` code points that occur in at least ``min_docs`` documents lose all their lines but those in
    the document of the largest id that holds them. Documents are told apart by id: rows of one id are one document, and all of them lose or keep a line.
    Rows without an id neither count nor lose lines. Repeated lines inside a document count once and stay or go together.
    Hashes are 128 bits, so two different keys are taken for one with a chance of 1e-18 at ten thousand million lines.
    """
    lines = scratch.keep(hashed_lines(docs, id_col, text_col, min_chars), "lines")
    index, shards = build_index(lines, scratch, min_docs)
    gone = lines_to_drop(lines, index, shards, scratch, min_docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    every = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    every = every.select("id", F.col("id").cast("bigint").alias("doc"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    met = every.join(gone, ["doc", "text_hash"], "left")
    split = F.split("text", "\n", -1)
    stays = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    return met.select(
        F.col("id").alias(id_col),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stays, lambda i: F.get(split, i)), "\n")).alias(text_col),
        F.size(split).cast("bigint").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint").alias("n_dropped"),
    )
