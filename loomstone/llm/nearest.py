"""Nearest neighbours by inner product as a block matrix join.

Vectors are packed into blocks with an int8 copy, its scale and the norm of what rounding lost. A tile is
a block of queries against a block of rows: the int8 product and the two error norms bound every
inner product from both sides; only rows whose upper bound reaches the k-th best lower bound are
recomputed in double precision and pushed through a heap per query. The bounds are never too tight, so the result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import Scratch

K = 20
BLOCK = 4096
STRIPE = 512
_PACKED = "block string, dim int, ids binary, vectors binary, small binary, scale binary, lost binary"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scale of each row, norm of each row's rounding error."""
    scale = np.abs(x).max(axis=1) / 127
    scale = np.where(scale > 0, scale, np.finfo(float).tiny)
    small = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    return small, scale, np.linalg.norm(x - small * scale[:, None], axis=1)


def _pack(batches):
    part = TaskContext.get().partitionId()
    made = 0
    waiting: dict[int, list] = {}

    def emit(dim: int, rows: list):
        nonlocal made
        made += 1
        x = np.stack([r[1] for r in rows])
        small, scale, lost = quantise(x)
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{part}-{made}"]), pa.array([dim], pa.int32())]
            + [pa.array([a.tobytes()], pa.binary()) for a in (np.array([r[0] for r in rows], np.int64), x, small, scale, lost)],
            names=[f.split()[0] for f in _PACKED.split(", ")],
        )

    for batch in batches:
        for key, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
            rows = waiting.setdefault(len(x), [])
            rows.append((key, x))
            if len(rows) == BLOCK:
                yield emit(len(x), waiting.pop(len(x)))
    for dim, rows in waiting.items():
        yield emit(dim, rows)


def tile(q, x, k: int, heaps: dict) -> None:
    """Push the candidates of one tile into the heaps of its queries; ``q`` and ``x`` are unpacked blocks."""
    q_id, q_full, q_small, q_scale, q_lost = q
    x_id, x_full, x_small, x_scale, x_lost = x
    x_flat = x_small.astype(np.float32).T
    x_norm = np.linalg.norm(x_small * x_scale[:, None], axis=1)
    q_norm = np.linalg.norm(q_full, axis=1)
    exact_int8 = x_full.shape[1] * 127 * 127 < 1 << 24
    for at in range(0, len(q_id), STRIPE):
        rows = slice(at, at + STRIPE)
        left = q_small[rows].astype(np.float32) if exact_int8 else q_small[rows].astype(np.float64)
        near = (left @ (x_flat if exact_int8 else x_flat.astype(np.float64))).astype(np.float64)
        near *= q_scale[rows, None]
        near *= x_scale
        slack = q_norm[rows, None] * x_lost + q_lost[rows, None] * x_norm
        slack += 1e-9 * (1e-300 + q_norm[rows, None] * (x_norm + x_lost))
        own = q_id[rows, None] == x_id
        lower = np.where(own, -np.inf, near - slack)
        if lower.shape[1] > k:
            least = np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k]
        else:
            least = np.full(len(lower), -np.inf)
        for i in range(len(lower)):
            heap = heaps[int(q_id[at + i])]
            bar = least[i] if len(heap) < k else max(least[i], heap[0][0])
            picked = np.flatnonzero((near[i] + slack[i] >= bar) & ~own[i])
            score = np.einsum("ij,ij->i", np.broadcast_to(q_full[at + i], (len(picked), q_full.shape[1])), x_full[picked])
            if len(picked) > 4 * k:
                best = np.lexsort((x_id[picked], -score))[:k]
                picked, score = picked[best], score[best]
            for s, key in zip(score.tolist(), x_id[picked].tolist()):
                if len(heap) < k:
                    heapq.heappush(heap, (s, -key))
                else:
                    heapq.heappushpop(heap, (s, -key))


def _unpack(row: dict, side: str):
    dim = row["dim"]
    ids = np.frombuffer(row[f"{side}_ids"], np.int64)
    full = np.frombuffer(row[f"{side}_vectors"], np.float64).reshape(-1, dim)
    small = np.frombuffer(row[f"{side}_small"], np.int8).reshape(-1, dim)
    return ids, full, small, np.frombuffer(row[f"{side}_scale"], np.float64), np.frombuffer(row[f"{side}_lost"], np.float64)


def _tiles(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def flush(heaps):
        found = [(q, -key, s) for q, heap in heaps.items() for s, key in heap]
        columns = list(zip(*found)) if found else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        held, heaps = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["q_block"] != held:
                    if heaps:
                        yield flush(heaps)
                    held, q = row["q_block"], _unpack(row, "q")
                    heaps = {int(key): [] for key in q[0]}
                tile(q, _unpack(row, "x"), k, heaps)
        if heaps:
            yield flush(heaps)

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part: id not null, all components finite, not all zero."""
    x = F.col("vector")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(
        F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0)
    )


def nearest(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of largest inner product for every row whose id satisfies ``is_query`` (a function of the id column).

    Columns query_id, rank (from 1), vec_id, score; ties go to the smaller id, fewer candidates give fewer rows. Rows
    with a null id, and vectors that are null, empty, zero or hold null or non-finite components, take no part; only vectors of
    the same length are compared. A query's own row is every row with its id; an id repeated
    among the queries is asked once, with its smallest vector; repeated candidates count each. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "nearest")
    rows = scratch.keep(usable(vectors, id_col, vector_col), "rows")
    asked = rows.where(is_query(F.col("id"))).groupBy("id").agg(F.min("vector").alias("vector"))

    def packed(df: DataFrame, name: str) -> DataFrame:
        parts = max(1, -(-df.count() // BLOCK))
        return scratch.keep(df.repartition(parts, "id").mapInArrow(_pack, _PACKED), name)

    queries, blocks = packed(asked, "queries"), packed(rows, "blocks")

    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.select("dim", *[F.col(c).alias(f"{mark}_{c}") for c in df.columns if c != "dim"])

    grid = queries.select("dim", F.col("block").alias("q_block")).join(blocks.select("dim", F.col("block").alias("x_block")), "dim")
    tiles = grid.join(side(queries, "q"), ["dim", "q_block"]).join(side(blocks, "x"), ["dim", "x_block"])
    tiles = tiles.select("dim", "q_block", *[f"{s}_{c}" for s in "qx" for c in ("ids", "vectors", "small", "scale", "lost")])
    found = tiles.sortWithinPartitions("q_block").mapInArrow(_tiles(k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
