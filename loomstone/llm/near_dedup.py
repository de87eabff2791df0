"""Near duplicates by b-bit MinHash.

A text's set is its distinct five-word shingles (64-bit hashes). Rows with equal
sets are one *class* from the start. Bands of the class's minima give candidate
buckets; of every minimum only ``B_BITS`` bits are retained, packed into
64-bit words, and the similarity of a candidate pair is estimated from the number of
equal fields, corrected for chance collisions. Pairs whose estimate is not clearly too low are
confirmed on their full sets.

A bucket never emits all its pairs. First each bucket compares its members with two
leaders, those of smallest and largest digest, which are mostly the same in all buckets of a group. What is
still unconnected in a bucket afterwards is compared across components, so no
link between components is lost. The result is one row per document with its component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, chunks, mix, split_words, stream, text_buffer
from .components import components

WORDS = 5
PERCENT = 75
HASHES = 256
BANDS, ROWS = 32, 4
B_BITS = 4
FIELDS = 64 // B_BITS
SIGMAS = 4.5
FINE_HASHES, FINE_BITS = 2048, 2
TILE_ROWS = 1024

_JOIN = stream(11, WORDS) | np.uint64(1)
_A = (stream(12, HASHES) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (stream(13, HASHES) >> np.uint64(32)).astype(np.uint32)
_FINE_A = (stream(16, FINE_HASHES) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_FINE_B = (stream(17, FINE_HASHES) >> np.uint64(32)).astype(np.uint32)
_BAND = stream(14, ROWS) | np.uint64(1)
_ORDER = stream(15, BANDS)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS):
    """For each text its sorted distinct shingle hashes; a text with fewer words is one shingle."""
    found = split_words(data, offsets)
    n = len(offsets) - 1
    bounds = np.searchsorted(found.doc, np.arange(n + 1))
    whole = np.zeros(max(0, len(found.hash) - words + 1), np.uint64)
    for j in range(words):
        whole += found.hash[j : j + len(whole)] * _JOIN[j]
    whole = mix(whole)
    for i in range(n):
        first, last = bounds[i], bounds[i + 1]
        if last - first >= words:
            yield np.unique(whole[first : last - words + 1])
        elif last > first:
            part = found.hash[first:last]
            yield mix(np.array([(part * _JOIN[: len(part)]).sum() + np.uint64(len(part))], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def minima(shingles: np.ndarray, a: np.ndarray = _A, b: np.ndarray = _B) -> np.ndarray:
    """Minima of the hash functions a * x + b over the shingles, 32 bits each."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    step = max(1, (1 << 16) // len(a))
    for at in range(0, len(low), step):
        np.minimum(best, (low[None, at : at + step] * a[:, None] + b[:, None]).min(axis=1), out=best)
    return best


def pack(minimum: np.ndarray, bits: int = B_BITS) -> np.ndarray:
    """Low bits of the (scrambled) minima, packed into 64-bit words."""
    low = mix(minimum.astype(np.uint64)) & np.uint64((1 << bits) - 1)
    shift = np.arange(64 // bits, dtype=np.uint64) * np.uint64(bits)
    return (low.reshape(-1, 64 // bits) << shift).sum(axis=1, dtype=np.uint64)


def band_keys(minimum: np.ndarray) -> np.ndarray:
    rows = minimum[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS)
    return mix((mix(rows) * _BAND).sum(axis=1, dtype=np.uint64) + _ORDER)


def _describe(batches):
    schema = pa.schema(
        [("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))]
    )
    for batch in chunks(batches, "text"):
        data, offsets = text_buffer(batch.column(1))
        size, digest, bands, sketch = [], [], [], []
        for shingles in shingle_sets(data, offsets):
            size.append(len(shingles))
            digest.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
            if len(shingles):
                minimum = minima(shingles)
                bands.append(band_keys(minimum).view(np.int64))
                sketch.append(pack(minimum).view(np.int64))
            else:
                bands.append(None)
                sketch.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, schema.field(3).type), pa.array(sketch, schema.field(4).type)],
            schema=schema,
        )


def _full_sets(batches):
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    for batch in chunks(batches, "text", 2 << 20):
        sets = list(shingle_sets(*text_buffer(batch.column(1))))
        places = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        values = pa.array(np.concatenate(sets).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(places, values)], schema=schema)


def least_equal_fields(percent: int = PERCENT, hashes: int = HASHES, bits: int = B_BITS) -> int:
    """Equal fields that a pair at the threshold has but for ``SIGMAS`` standard deviations.

    A field of a pair of similarity J is equal with probability J + (1 - J) / 2**bits, which is the
    collision correction solved for the count.
    """
    chance = 1 / (1 << bits)
    p = percent / 100 + (1 - percent / 100) * chance
    return int(hashes * p - SIGMAS * (hashes * p * (1 - p)) ** 0.5)


def estimate(equal):
    """Collision-corrected similarity (Column) from the number of equal fields."""
    chance = 1 / (1 << B_BITS)
    return F.greatest(F.lit(0.0), (equal / HASHES - chance) / (1 - chance))


def equal_fields(a: str, b: str):
    """Number of equal fields of two packed signatures: folds the bits of a field onto one, counts bits."""
    ones = sum(1 << (B_BITS * i) for i in range(FIELDS))
    ones = ones - (1 << 64) if ones >> 63 else ones

    def differing(x):
        for by in (B_BITS // 2, B_BITS // 4):
            x = x.bitwiseOR(F.shiftrightunsigned(x, by))
        return F.bit_count(x.bitwiseAND(F.lit(ones)))

    total = F.lit(0)
    for i in range(HASHES // FIELDS):
        total = total + differing(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return F.lit(HASHES) - total


def _fine(batches):
    """Long signatures of sets: 2-bit fields of many more minima."""
    for batch in batches:
        lists = batch.column(1)
        packed = [pack(minima(v.values.to_numpy().view(np.uint64), _FINE_A, _FINE_B), FINE_BITS).tobytes() for v in lists]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["node", "fine"])


def _across(percent: int):
    least = least_equal_fields(percent, FINE_HASHES, FINE_BITS)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    odd = np.uint64(0x5555555555555555)

    def run(table: pa.Table) -> pa.Table:
        """Likely pairs of one tile of a bucket: of two blocks, or within one, whose components differ."""
        one = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        node, comp, n, own = (table.column(c).to_numpy() for c in ("node", "comp", "n", "own"))
        fine = np.frombuffer(b"".join(table.column("fine").to_pylist()), np.uint64).reshape(len(node), -1)
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        key = table.column("key")[0].as_py()
        here = np.flatnonzero(own == table.column("i")[0].as_py())
        there = here if one else np.flatnonzero(own != table.column("i")[0].as_py())
        left, right = [], []
        for x in here:
            near = there[(comp[there] != comp[x]) & (np.minimum(n[there], n[x]) * 100 >= np.maximum(n[there], n[x]) * percent)]
            if one:
                near = near[node[near] > node[x]]
            if not len(near):
                continue
            differ = fine[near] ^ fine[x]
            same = FINE_HASHES - np.bitwise_count((differ | (differ >> np.uint64(1))) & odd).sum(axis=1, dtype=np.int64)
            near = near[same >= least]
            if len(near):  # a pair is put out by the first bucket that both are in
                shared = bands[near] == bands[x]
                near = near[bands[x][shared.argmax(axis=1)] == key]
                left.append(np.full(len(near), node[x]))
                right.append(node[near])
        if not left:
            return schema.empty_table()
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.Table.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=schema)

    return run


def _near_size(a: str, b: str, percent: int):
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked where 100 * intersection >= ``percent`` * union of their sets; a component's id
    is its smallest document id, and ``kept`` marks the document carrying it. A text without words (or
    null) has an empty set, links with nothing and is kept. Rows with the same id count as one
    document. A row with a null id links with nothing: its component is null and it is kept. An
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    described = scratch.keep(
        rows.mapInArrow(_describe, "id bigint, n bigint, digest binary, bands array<bigint>, sketch array<bigint>"), "rows"
    )
    classes = scratch.keep(
        described.where("id IS NOT NULL AND n > 0")
        .groupBy("digest")
        .agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "classes",
    )
    keyed = classes.select(F.explode("bands").alias("key"), "node")
    shared = keyed.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("key")
    buckets = scratch.keep(keyed.join(shared, "key"), "buckets")
    sketches = classes.select("node", "n", "sketch")
    met = buckets.select("node").distinct()
    wanted = rows.join(classes.join(met, "node", "left_semi").select(F.col("node").alias("id"), "digest"), "id", "left_semi")
    sets = scratch.keep(
        wanted.select(F.col("id").alias("node"), "text").distinct().mapInArrow(_full_sets, "node bigint, shingles array<bigint>"), "sets"
    )

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        linked = (
            pairs.join(left, "a").join(right, "b")
            .select("a", "b", both.alias("same"), (F.size("sa") + F.size("sb") - both).alias("union"))
            .where(F.col("same") * 100 >= F.col("union") * percent)
            .select("a", "b")
        )
        return scratch.keep(linked, name)

    least = least_equal_fields(percent)
    labels = None

    def labelled() -> DataFrame:
        if labels is None:
            return buckets.withColumn("comp", F.col("node"))
        return buckets.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def merged(links: DataFrame, name: str) -> DataFrame:
        """Labels after joining the components that the new links connect."""
        if labels is None:
            return components(links, scratch, name)
        of = labels.select("node", "comp")
        ends = (
            links.join(of.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left")
            .join(of.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
            .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        )
        moved = components(ends, scratch, name).select(F.col("node").alias("old"), F.col("comp").alias("new"))
        known = of.unionAll(links.select(F.explode(F.array("a", "b")).alias("node")).select("node", F.col("node").alias("comp")))
        known = known.groupBy("node").agg(F.min("comp").alias("comp"))
        return scratch.keep(
            known.join(moved, known.comp == moved.old, "left").select("node", F.coalesce("new", "comp").alias("comp")),
            f"{name}-labels",
        )

    def sketched(pairs: DataFrame) -> DataFrame:
        a = sketches.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
        b = sketches.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
        likely = _near_size("na", "nb", percent) & (equal_fields("ka", "kb") >= least)
        return pairs.join(a, "a").join(b, "b").where(likely).select("a", "b")

    order = F.xxhash64("node")
    leaders = buckets.groupBy("key").agg(F.min(F.struct(order, "node")).alias("x"), F.max(F.struct(order, "node")).alias("y"))
    leaders = leaders.select("key", F.explode(F.array("x.node", "y.node")).alias("lead"))
    pairs = buckets.join(leaders, "key").where("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))
    links = confirmed(scratch.keep(sketched(pairs.distinct()), "pairs-leaders"), "links-leaders")
    if links.limit(1).count():
        labels = merged(links, "comp-leaders")
    here = labelled()
    unlinked = (
        here.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("rows")).where("x <> y")
        .select("key", F.ceil(F.col("rows") / TILE_ROWS).cast("int").alias("blocks"))
    )
    here = scratch.keep(here.join(unlinked, "key"), "open")
    fine = sets.join(here.select("node").distinct(), "node", "left_semi").mapInArrow(_fine, "node bigint, fine binary")
    described_open = scratch.keep(fine.join(classes.select("node", "n", "bands"), "node"), "fine")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    tiles = here.join(described_open, "node").withColumn("own", block)
    tiles = tiles.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp", "n", "fine", "bands"
    )
    across = tiles.groupBy("key", "i", "j").applyInArrow(_across(percent), "a bigint, b bigint")
    links = confirmed(scratch.keep(across.distinct(), "pairs-across"), "links-across")
    if links.limit(1).count():
        labels = merged(links, "comp-across")
    node = classes.select("digest", "node")
    if labels is not None:
        node = node.join(labels, "node", "left").withColumn("node", F.coalesce("comp", "node"))
    place = scratch.keep(node.select("digest", F.col("node").alias("comp")), "place")
    out = scratch.keep(
        described.select("id", "n", "digest").join(place, "digest", "left").select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.when(F.col("id").isNotNull(), F.coalesce("comp", "id")).alias("component_id"),
        ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))),
        "result",
    )
    scratch.drop("rows", "classes", "buckets", "sets", "open", "fine", "place")
    return out
