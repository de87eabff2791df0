"""Severity of toxic language by cumulative-link ordinal regression.

P(grade >= k) = sigmoid(w.x - theta_k): all thresholds share the weights w over sparse
text features, only the cut points theta_1 < theta_2 < ... differ, and the expected severity is
the sum of those probabilities. Features are words and word beginnings (4, 5 and 6 bytes) with
log(1 + count); the vocabulary is chosen by the association of document frequency with the
grades, counted by Spark over the labelled sample.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, chunks

SAMPLE = 6000
VOCABULARY = 4096
PREFIXES = (4, 5, 6)
LEAST_DOCS = 3
GRADES = 4
TOXIC_FROM = 0.3

# A-Z to lower case, other ASCII marks and controls to a space.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)
)


def features(text: bytes) -> Counter:
    """Words and marked word beginnings of a text with their counts."""
    words = Counter(text.translate(_PLAIN).split())
    out = Counter(words)
    for word, n in words.items():
        for size in PREFIXES:
            if len(word) >= size:
                out[word[:size] + b"*"] += n
    return out


class Ordinal:
    """Vocabulary, shared weights and cut points."""

    def __init__(self, vocabulary: list[bytes], grades: int):
        self.index = {w: i for i, w in enumerate(vocabulary)}
        self.weights = np.zeros(len(vocabulary))
        self.cuts = np.arange(1, grades, dtype=float)
        self.lengths = sorted({len(w) - 1 for w in vocabulary if w.endswith(b"*")})

    def row(self, text: bytes) -> tuple[list[int], list[float]]:
        """Indexes and values of the known features of a text, by index."""
        index, found = self.index, {}
        for word, n in Counter(text.translate(_PLAIN).split()).items():
            i = index.get(word)
            if i is not None:
                found[i] = found.get(i, 0) + n
            for size in self.lengths:
                if len(word) < size:
                    break
                i = index.get(word[:size] + b"*")
                if i is not None:
                    found[i] = found.get(i, 0) + n
        keys = sorted(found)
        return keys, [float(np.log1p(found[k])) for k in keys]

    def at_least(self, linear: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., one column each."""
        return 1 / (1 + np.exp(-np.clip(linear[:, None] - self.cuts, -40, 40)))

    def fit(self, rows: list[int], columns: list[int], values: list[float], grade: np.ndarray, weight: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 2e-4) -> None:
        """Adam on the weighted log likelihood of the grades; cut points stay ordered through log gaps."""
        r, c, v = np.array(rows, int), np.array(columns, int), np.array(values)
        n, k = len(grade), len(self.cuts)
        theta = np.concatenate(([self.cuts[0]], np.zeros(k - 1)))
        p = [self.weights, theta]
        m, s = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
        total = weight.sum()
        for step in range(1, steps + 1):
            gaps = np.exp(p[1][1:])
            cuts = np.concatenate(([p[1][0]], p[1][0] + np.cumsum(gaps)))
            linear = np.bincount(r, v * p[0][c], n)
            upper = np.column_stack([np.ones(n), 1 / (1 + np.exp(-np.clip(linear[:, None] - cuts, -40, 40))), np.zeros(n)])
            here, above = upper[np.arange(n), grade], upper[np.arange(n), grade + 1]
            like = np.maximum(here - above, 1e-12)
            # d like / d(linear - cut): slope of the two sides
            a, b = here * (1 - here) / like, above * (1 - above) / like
            g_linear = -weight * (a - b) / total
            g_cut = np.zeros(k + 2)
            np.add.at(g_cut, grade, weight * a / total)
            np.add.at(g_cut, grade + 1, -weight * b / total)
            g_cut = g_cut[1 : k + 1]
            tail = np.cumsum(g_cut[::-1])[::-1]
            grads = [np.bincount(c, g_linear[r] * v, len(p[0])) + decay * p[0], np.concatenate(([tail[0]], tail[1:] * gaps))]
            for i, g in enumerate(grads):
                m[i] += 0.1 * (g - m[i])
                s[i] += 0.01 * (g * g - s[i])
                p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.99**step)) + 1e-9)
        self.weights = p[0]
        self.cuts = np.concatenate(([p[1][0]], p[1][0] + np.cumsum(np.exp(p[1][1:]))))


def _document_frequencies(batches):
    schema = pa.schema([("feature", pa.binary()), ("grade", pa.int32()), ("n", pa.int64())])
    for batch in chunks(batches, "text"):
        counts: Counter = Counter()
        for grade, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts.update((f, grade) for f in features((text.as_py() or "").encode()))
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.binary()), pa.array([k[1] for k in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())], schema=schema
        )


def choose_vocabulary(rows: DataFrame, totals: dict[int, int], size: int = VOCABULARY) -> list[bytes]:
    """The ``size`` features whose document frequency tells grade 0 from higher grades best (log-likelihood ratio)."""
    low, high = float(totals.get(0, 0)), float(sum(n for g, n in totals.items() if g > 0))
    df = rows.mapInArrow(_document_frequencies, "feature binary, grade int, n bigint").groupBy("feature").agg(
        F.sum(F.when(F.col("grade") > 0, F.col("n")).otherwise(0)).alias("b"), F.sum(F.when(F.col("grade") == 0, F.col("n")).otherwise(0)).alias("a")
    )
    df = df.where(F.col("a") + F.col("b") >= LEAST_DOCS)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    p = (F.col("a") + F.col("b")) / (low + high)
    ratio = part(F.col("a"), p * low) + part(F.col("b"), p * high) + part(low - F.col("a"), (1 - p) * low) + part(high - F.col("b"), (1 - p) * high)
    best = df.withColumn("ratio", ratio).orderBy(F.desc("ratio"), "feature").limit(size)
    return [bytes(r.feature) for r in best.select("feature").collect()]


def graded_by_density(model: Ordinal, rows, toxic: np.ndarray, words: np.ndarray, high: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Grades for rows that are only marked toxic or not: 0, or by the density of telling features.

    Rows marked toxic are ordered by the share of features that stand far more often in toxic rows
    (``high``, by feature) and cut into ``grades`` - 1 equal parts, 1 the mildest.
    """
    density = np.array([sum(np.expm1(v) for i, v in zip(*r) if high[i]) for r in rows]) / np.maximum(1, words)
    cut = np.quantile(density[toxic > 0], np.arange(1, grades - 1) / (grades - 1)) if (toxic > 0).any() else []
    return np.where(toxic > 0, 1 + np.searchsorted(cut, density, side="left"), 0).astype(int)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade",
    grades: int = GRADES, sample: int = SAMPLE, vocabulary: int = VOCABULARY,
) -> Ordinal | None:
    """Model learned from at most ``sample`` labelled rows of grade 0 and as many of higher grades.

    ``grade_col`` holds 0, 1, 2, ...; where it holds 0 and 1 only and ``grades`` asks for more, the higher
    grades are split by density of telling features. Rows are those with the smallest digests of their ids and
    are weighted back to the classes' shares among all labels. Null grades and ids are left out, repeated rows
    count once. None when a class is missing.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("grade")).where("id IS NOT NULL AND grade >= 0").distinct()
    sizes = {r[0]: r[1] for r in known.groupBy((F.col("grade") > 0).alias("high")).count().collect()}
    if len(sizes) < 2:
        return None
    picked = bounded_sample(known.where("grade = 0"), "id", sample).unionAll(bounded_sample(known.where("grade > 0"), "id", sample))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(picked), "id").select("grade", "text", "id")
    taken = {r[0]: r[1] for r in rows.groupBy("grade").count().collect()}
    if not taken.get(0) or sum(taken.values()) == taken[0]:
        return None
    model = Ordinal(choose_vocabulary(rows, taken, vocabulary), grades)
    index = docs.sparkSession.sparkContext.broadcast(model)

    def describe(batches):
        schema = pa.schema([("grade", pa.int32()), ("words", pa.int64()), ("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float64())), ("id", pa.string())])
        for batch in chunks(batches, "text"):
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            found = [index.value.row(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int32()), pa.array([len(t.translate(_PLAIN).split()) for t in texts], pa.int64()),
                 pa.array([f[0] for f in found], schema.field(2).type), pa.array([f[1] for f in found], schema.field(3).type), batch.column(2).cast(pa.string())],
                schema=schema,
            )

    got = rows.mapInArrow(describe, "grade int, words bigint, at array<int>, value array<double>, id string").toArrow().sort_by([("id", "ascending"), ("grade", "ascending"), ("words", "ascending")])
    sparse = list(zip(got.column(2).to_pylist(), got.column(3).to_pylist()))
    grade = got.column(0).to_numpy().astype(int)
    if grade.max() == 1 and grades > 2:
        inside = [np.zeros(len(model.index)), np.zeros(len(model.index))]
        for (at, _), g in zip(sparse, grade):
            inside[g][at] += 1
        high = inside[1] / max(1, (grade == 1).sum()) > 4 * (inside[0] + 0.5) / max(1, (grade == 0).sum())
        grade = graded_by_density(model, sparse, grade, got.column(1).to_numpy(), high, grades)
    grade = np.minimum(grade, grades - 1)
    weight = np.where(grade > 0, sizes[True] / (grade > 0).sum(), sizes[False] / (grade == 0).sum())
    owner = [i for i, (at, _) in enumerate(sparse) for _ in at]
    model.fit(owner, [i for at, _ in sparse for i in at], [v for _, vs in sparse for v in vs], grade, weight)
    return model


def _scores(model):
    kind = pa.list_(pa.float64())

    def run(batches):
        known = model.value
        for batch in chunks(batches, "text"):
            if known is None:
                p = np.zeros((batch.num_rows, 1))
            else:
                linear = np.zeros(batch.num_rows)
                for i, text in enumerate(batch.column(1)):
                    at, value = known.row((text.as_py() or "").encode())
                    linear[i] = known.weights[at] @ value if at else 0.0
                p = known.at_least(linear)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(p), kind)], names=["id", "at_least"])

    return run


def severity(docs: DataFrame, model: Ordinal | None, id_col: str = "doc_id", text_col: str = "text", toxic_from: float = TOXIC_FROM) -> DataFrame:
    """One row per row of ``docs``: id, ``expected_severity``, ``severity`` (most grades that are likelier than not), ``p_toxic``, ``toxic`` (from ``toxic_from`` on).

    A null or empty text has no features: its severity is that of the cut points alone, in
    practice 0. Repeated rows score alike; a null id stays null; without a model everything is 0 and not
    toxic. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = rows.mapInArrow(_scores(sent), f"id {dict(rows.dtypes)['id']}, at_least array<double>")
    return scored.select(
        F.col("id").alias(id_col),
        F.aggregate("at_least", F.lit(0.0), lambda a, p: a + p).alias("expected_severity"),
        F.size(F.filter("at_least", lambda p: p >= 0.5)).alias("severity"),
        F.col("at_least")[0].alias("p_toxic"),
        (F.col("at_least")[0] >= toxic_from).alias("toxic"),
    )
