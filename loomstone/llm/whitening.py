"""Whitening by the exact characteristic polynomial of an integer scatter matrix.

Vectors become integers; their scatter ``A = n * sum(x x') - S S'`` (n squared times the covariance) is summed
exactly by Spark. Its characteristic polynomial is reduced modulo many primes, one task per few primes, by Hessenberg form and put
together by Chinese remainders. All its roots are real, so the sign changes of a shifted copy count the roots above a
point exactly; that isolates the largest roots to a hundred and more bits. Each component is the null space of
``A - root``, found by inverse iteration in fixed point integers. Only matrices of the vectors' length reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

COMPONENTS = 8
SCALE, SHIFT = 1024.0, 100_000
#: Bits to which roots are known below the trace, and further bits of the vectors.
ROOT_BITS, GUARD_BITS = 192, 64
#: Entries are cut into limbs of so many bits; products of a block of rows are then exact in doubles.
LIMB, BLOCK_ROWS = 20, 4096
BLOCKS_PER_SUM = 1024
BOUND = 1 << 62
PRIMES_PER_TASK = 16


# ---- integer vectors ------------------------------------------------------------------


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows whose vector is there, not empty, and finite in every entry."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(id_col).alias("id"), x.alias("vector")).where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)


def _blocks(batch: pa.RecordBatch):
    """(places of the rows, integer vectors less the shift) for every length in a batch, in blocks of rows."""
    lists = batch.column(batch.schema.get_field_index("vector"))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.cumsum(sizes) - sizes
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(flat * SCALE), -float(BOUND), float(BOUND)).astype(np.int64)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        step = max(1, min(BLOCK_ROWS, (4 << 20) // int(dim)))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            yield some, whole[begins[some][:, None] + np.arange(dim)]


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Signed limbs, the lowest first, as doubles: their sum of limb * 2**(LIMB * place) is ``x``."""
    out = []
    while True:
        if np.abs(x).max(initial=0) < 1 << LIMB:
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB


def _sum_products(batches):
    """Sums of products of (1, x) by length, power of two and place; each is exact."""
    held: dict[tuple[int, int], list] = {}

    def put_out(dim, power, total):
        i, j = np.triu_indices(dim + 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(i), v, np.int32)) for v in (dim, power)] + [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])],
            names=["dim", "power", "i", "j", "value"],
        )

    for batch in batches:
        for _, x in _blocks(batch):
            dim = x.shape[1]
            limbs = [np.hstack((np.full((len(x), 1), float(place == 0)), limb)) for place, limb in enumerate(_limbs(x))]
            for a, left in enumerate(limbs):
                for b, right in enumerate(limbs):
                    power = LIMB * (a + b)
                    total = held.setdefault((dim, power), [np.zeros((dim + 1, dim + 1), np.int64), 0])
                    total[0] += (left.T @ right).astype(np.int64)
                    total[1] += 1
                    if total[1] == BLOCKS_PER_SUM:
                        yield put_out(dim, power, held.pop((dim, power))[0])
    for (dim, power), (total, _) in held.items():
        yield put_out(dim, power, total)


# ---- characteristic polynomial --------------------------------------------------------------


def primes_below(limit: int, product: int) -> list[int]:
    """The largest odd primes below ``limit`` (at most 2**31) whose product exceeds ``product``."""

    def is_prime(n: int) -> bool:
        odd, twos = n - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):  # enough below 3,215,031,751
            x = pow(base, odd, n)
            if x in (1, n - 1):
                continue
            if all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
                return False
        return True

    found, total, at = [], 1, limit - 1 - limit % 2
    while total <= product:
        if is_prime(at):
            found.append(at)
            total *= at
        at -= 2
    return found


def characteristic_residues(matrix: np.ndarray, primes: list[int]) -> np.ndarray:
    """Coefficients (constant first) of det(x - matrix) modulo each prime; a row per prime."""
    d = len(matrix)
    p = np.array(primes, np.int64)
    h = np.stack([(matrix % prime).astype(np.int64) for prime in primes])
    every, q = np.arange(len(p)), p[:, None, None]
    for m in range(1, d - 1):
        below = h[:, m:, m - 1]
        pick = m + np.argmax(below != 0, axis=1)
        h[every, m], h[every, pick] = h[every, pick], h[every, m]
        h[every, :, m], h[every, :, pick] = h[every, :, pick], h[every, :, m]
        pivot = h[:, m, m - 1]
        inverse = np.array([pow(int(x), -1, int(n)) if x else 0 for x, n in zip(pivot, p)], np.int64)
        factor = h[:, m + 1 :, m - 1] * inverse[:, None] % p[:, None]
        h[:, m + 1 :] = (h[:, m + 1 :] - factor[:, :, None] * h[:, m, None, :] % q) % q
        h[:, :, m] = (h[:, :, m] + (h[:, :, m + 1 :] * factor[:, None, :] % q).sum(axis=2)) % p[:, None]
    poly = np.zeros((d + 1, len(p), d + 1), np.int64)  # of the leading submatrices
    poly[0, :, 0] = 1
    for k in range(1, d + 1):
        out = np.zeros((len(p), d + 1), np.int64)
        out[:, 1:] = poly[k - 1, :, :-1]
        out = (out - h[:, k - 1, k - 1, None] * poly[k - 1]) % p[:, None]
        chain = np.ones(len(p), np.int64)
        for i in range(1, k):
            chain = chain * h[:, k - i, k - i - 1] % p
            out = (out - (h[:, k - i - 1, k - 1] * chain % p)[:, None] * poly[k - i - 1]) % p[:, None]
        poly[k] = out
    return poly[d]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Integer coefficients (constant first) of det(x - matrix), for a matrix of Python integers without negative eigenvalues.

    The primes are dealt to tasks; a coefficient is bounded by that of a matrix with all eigenvalues equal to their mean.
    """
    d = len(matrix)
    mean = sum(int(matrix[i, i]) for i in range(d)) // d + 1
    bound = max(math.comb(d, k) * mean**k for k in range(d + 1))
    primes = primes_below(1 << 31, 2 * bound)
    rows = [[int(v) for v in row] for row in matrix]

    def residues(batches):
        whole = np.array(rows, dtype=object)
        for batch in batches:
            some = batch.column(0).to_pylist()
            for at in range(0, len(some), PRIMES_PER_TASK):
                mine = some[at : at + PRIMES_PER_TASK]
                yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int64()), pa.array(list(characteristic_residues(whole, mine)), pa.list_(pa.int64()))], names=["prime", "rest"])

    parts = -(-len(primes) // PRIMES_PER_TASK)
    dealt = spark.createDataFrame([(p,) for p in primes], "prime bigint").repartition(parts)
    found = {r.prime: r.rest for r in dealt.mapInArrow(residues, "prime bigint, rest array<bigint>").collect()}
    whole, value = 1, [0] * (d + 1)
    for prime in primes:
        step = pow(whole % prime, -1, prime)
        value = [v + whole * ((r - v) * step % prime) for v, r in zip(value, found[prime])]
        whole *= prime
    return [v - whole if 2 * v > whole else v for v in value]


# ---- roots and null spaces ------------------------------------------------------------


def roots_above(poly: list[int], at: int) -> int:
    """How many roots, all of them real, lie above ``at``, counted with multiplicity."""
    c = list(poly)
    if at:
        for i in range(len(c) - 1):
            for k in range(len(c) - 2, i - 1, -1):
                c[k] += at * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: list[int], at: int) -> int:
    value = 0
    for c in reversed(poly):
        value = value * at + c
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], most: int, limit: int) -> list[tuple[int, int]]:
    """(root, multiplicity) of the largest positive roots of a polynomial with only real ones, all at most ``limit``.

    Roots are rounded up to integers; roots between the same two integers are one of higher multiplicity. Roots beyond the ``most``
    largest are left out.
    """
    found: list[tuple[int, int]] = []
    todo = [(0, limit, roots_above(poly, 0), 0)]
    while todo:
        low, high, above_low, above_high = todo.pop()
        inside = above_low - above_high
        if not inside or above_high >= most:
            continue
        if high - low == 1:
            found.append((high, min(inside, most - above_high)))
        elif inside == 1:
            over = -1 if above_high % 2 else 1
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (low, middle) if _sign(poly, middle) in (0, over) else (middle, high)
            found.append((high, 1))
        else:
            middle = (low + high) // 2
            above = roots_above(poly, middle)
            todo += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return sorted(found, reverse=True)


def null_space(matrix: np.ndarray, size: int, bits: int, rounds: int = 3) -> np.ndarray:
    """Orthonormal vectors, times 2**bits, that the nearly singular integer ``matrix`` takes nearest to zero."""
    d = len(matrix)
    m, order, factors = matrix.copy(), [], []
    for k in range(d):
        pick = k + max(range(d - k), key=lambda i: abs(m[k + i, k]))
        order.append(pick)
        if pick != k:
            m[[k, pick]] = m[[pick, k]]
        if not m[k, k]:
            m[k, k] = 1
        factor = (m[k + 1 :, k] << bits) // m[k, k]
        factors.append(factor)
        m[k + 1 :, k + 1 :] -= (factor[:, None] * m[k, None, k + 1 :]) >> bits
    start = np.random.default_rng(1).integers(-(1 << 30), 1 << 30, (size, d))
    basis = [np.array([int(v) << bits for v in row], dtype=object) for row in start]
    for _ in range(rounds):
        done: list[np.ndarray] = []
        for v in basis:
            y = v.copy()
            for k in range(d):
                y[k], y[order[k]] = y[order[k]], y[k]
                y[k + 1 :] -= (factors[k] * y[k]) >> bits
            y <<= bits
            for k in range(d - 1, -1, -1):
                y[k] = (y[k] - int((m[k, k + 1 :] * y[k + 1 :]).sum() if k + 1 < d else 0)) // m[k, k]
            for _ in range(2):
                y = (y << bits) // max(1, math.isqrt(int((y * y).sum())))
                for other in done:
                    y = y - ((other * int((other * y).sum())) >> 2 * bits)
            done.append((y << bits) // max(1, math.isqrt(int((y * y).sum()))))
        basis = done
    return np.array([v * (1 if v[max(range(d), key=lambda i: abs(v[i]))] > 0 else -1) for v in basis], dtype=object)


@dataclass(frozen=True)
class Whitener:
    """Fit of the vectors of one length: count, sums of the shifted integers, components, roots and their share."""

    n: int
    sums: list[int]
    directions: np.ndarray  # a column per component, over the root of its eigenvalue times n squared
    vectors: np.ndarray  # unit rows
    explained: list[float]


def _fit_matrix(spark: SparkSession, n: int, sums: list[int], scatter: np.ndarray, components: int) -> Whitener:
    d = len(sums)
    trace = sum(int(scatter[i, i]) for i in range(d))
    vectors: list[np.ndarray] = []
    scales: list[float] = []
    shares: list[float] = []
    if trace:
        poly = characteristic_polynomial(spark, scatter)
        unit = max(0, ROOT_BITS - trace.bit_length())
        fine = [c << unit * (d - k) for k, c in enumerate(poly)]
        bits = ROOT_BITS + GUARD_BITS
        for root, times in largest_roots(fine, components, (trace << unit) + 1):
            shifted = np.array([[int(v) << unit for v in row] for row in scatter], dtype=object)
            for i in range(d):
                shifted[i, i] -= root
            for v in null_space(shifted, times, bits):
                vectors.append(np.array([math.ldexp(float(int(x)), -bits) for x in v]))
                scales.append(math.sqrt(root / (1 << unit)))
                shares.append(root / (trace << unit))
    unit_rows = np.array(vectors).reshape(-1, d)
    return Whitener(n, sums, (unit_rows / np.array(scales).reshape(-1, 1)).T, unit_rows, shares)


def fit(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> dict[int, Whitener]:
    """A whitener for every length of vector, from all usable rows; fewer components than asked for if the rank is lower."""
    products = usable(vectors, id_col, vector_col).mapInArrow(_sum_products, "dim int, power int, i int, j int, value bigint")
    totals = products.groupBy("dim", "power", "i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    moments: dict[int, np.ndarray] = {}
    for r in totals.collect():
        if r.dim not in moments:
            moments[r.dim] = np.zeros((r.dim + 1, r.dim + 1), dtype=object)
        moments[r.dim][r.i, r.j] += int(r.value) << r.power
    fits = {}
    for dim, m in moments.items():
        m = m + np.triu(m, 1).T
        n, sums = int(m[0, 0]), [int(v) for v in m[0, 1:]]
        scatter = n * m[1:, 1:] - np.outer(np.array(sums, dtype=object), np.array(sums, dtype=object))
        fits[dim] = _fit_matrix(vectors.sparkSession, n, sums, scatter, components)
    return fits


# ---- projection -----------------------------------------------------------------------


def _deviations(x: np.ndarray, w: Whitener) -> np.ndarray:
    """``n * x - S`` of a block, as 64-bit integers where they fit."""
    most = int(np.abs(x).max(initial=0)) * w.n + max(map(abs, w.sums))
    if most < 1 << 62:
        return x * np.int64(w.n) - np.array(w.sums, np.int64)
    return x.astype(object) * w.n - np.array(w.sums, dtype=object)


def _squares(d: np.ndarray) -> list[int]:
    if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    d = d.astype(object)
    return [int(v) for v in (d * d).sum(axis=1)]


def _project(d: np.ndarray, w: Whitener) -> np.ndarray:
    return d.astype(np.float64) @ w.directions


def _spread_of(fits: dict[int, Whitener]):
    """Sums of the whitened values and of their products, per task, each centred on the task's mean first."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for _, x in _blocks(batch):
                w = fits[x.shape[1]]
                y = _project(_deviations(x, w), w)
                n, mean = len(y), y.mean(axis=0)
                inner = (y - mean).T @ (y - mean)
                if x.shape[1] in held:
                    n0, mean0, inner0 = held[x.shape[1]]
                    away = mean - mean0
                    inner += inner0 + np.outer(away, away) * (n0 * n / (n0 + n))
                    mean, n = mean0 + away * (n / (n0 + n)), n0 + n
                held[x.shape[1]] = [n, mean, inner]
        for dim, (n, mean, inner) in held.items():
            rows = [(dim, -1, j, n * m) for j, m in enumerate(mean.tolist())]
            whole = inner + n * np.outer(mean, mean)
            rows += [(dim, i, j, float(whole[i, j])) for i in range(len(mean)) for j in range(i, len(mean))]
            yield pa.RecordBatch.from_pylist([dict(zip(("dim", "i", "j", "value"), r)) for r in rows], schema=pa.schema([("dim", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("value", pa.float64())]))

    return run


def identity_errors(vectors: DataFrame, fits: dict[int, Whitener], id_col: str = "vec_id", vector_col: str = "embedding") -> dict[int, float]:
    """The largest absolute entry of (covariance of the whitened values - identity) for every length."""
    sums = usable(vectors, id_col, vector_col).mapInArrow(_spread_of(fits), "dim int, i int, j int, value double")
    found = {(r.dim, r.i, r.j): r.value for r in sums.groupBy("dim", "i", "j").agg(F.sum("value").alias("value")).collect()}
    errors = {}
    for dim, w in fits.items():
        k = len(w.explained)
        mean = [found.get((dim, -1, j), 0.0) / w.n for j in range(k)]
        errors[dim] = max((abs(found[dim, i, j] / w.n - mean[i] * mean[j] - (i == j)) for i in range(k) for j in range(i, k)), default=0.0)
    return errors


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened components of every usable vector: a row per vector and component, numbered from 1 by falling eigenvalue.

    Columns: the id, component, n (vectors fitted), deviation (sum of ``(n * x - S)**2``; null if beyond 64 bits, then its digits
    are in deviation_digits), whitened, explained (the component's share of the variance), identity_error.

    An entry c becomes ``x = floor(1024 * c) + 100000``; beyond 2**62 (|c| above 4e15) it is held at that bound. Rows whose vector is null, empty or
    holds null or non-finite entries are left out; a null id is kept. Vectors of another length are a table of their own, with
    their own n and components. Only components of positive variance are given, so equal vectors, or one vector, have
    none and give no rows; nor does an empty table. Equal eigenvalues share an orthonormal basis of their space. Repeated rows count each.
    """
    fits = fit(vectors, components, id_col, vector_col)
    errors = identity_errors(vectors, fits, id_col, vector_col)
    rows = usable(vectors, id_col, vector_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id"))
            for places, x in _blocks(batch):
                w = fits[x.shape[1]]
                k = len(w.explained)
                d = _deviations(x, w)
                y, squares = _project(d, w), _squares(d)
                fits_long = [v < 1 << 63 for v in squares]
                count = len(places) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(places, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(places))),
                        pa.array(np.full(count, w.n, np.int64)),
                        pa.array([v if ok else None for v, ok in zip(squares, fits_long)], pa.int64()).take(pa.array(np.repeat(np.arange(len(places)), k))),
                        pa.array(y.ravel()),
                        pa.array(np.tile(np.array(w.explained, np.float64), len(places))),
                        pa.array(np.full(count, errors[x.shape[1]])),
                        pa.array([None if ok else str(v) for v, ok in zip(squares, fits_long)], pa.string()).take(pa.array(np.repeat(np.arange(len(places)), k))),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"],
                )

    out = rows.mapInArrow(run, f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_digits string")
    return out.withColumnRenamed("id", id_col)
