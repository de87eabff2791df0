"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded as style
measures (byte classes, word lengths, repetition) and a random projection of its
hashed words. From document labels a small network learns an embedding of passages,
gated attention weights over them and a classifier of the weighted passage
representation; a few bad passages can thus decide a long document. The network is fitted with numpy on a bounded
sample of labelled rows; scoring streams all whole texts through Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_sample, chunks, mix, split_words, stream, text_buffer

PASSAGE = 64
SAMPLE = 8000
SAMPLE_PASSAGES = 128
HIDDEN, GATE, PROJECTED = 24, 16, 16
THRESHOLD = 0.3

# Byte classes: lower, upper, digit, space, newline, sentence marks, quotes and brackets, other ASCII marks, non-ASCII.
_CLASS = np.full(256, 8, np.uint8)
_CLASS[:128] = 7
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 3, 4
_CLASS[[ord(c) for c in ".,;:?-"]] = 5
_CLASS[[ord(c) for c in "\"'()[]"]] = 6
CLASSES = 9
_BUCKETS = 1 << 13
_PROJECT = np.where((stream(21, _BUCKETS * PROJECTED) >> np.uint64(40)) & np.uint64(1), 1.0, -1.0).astype(np.float32).reshape(_BUCKETS, PROJECTED)
FEATURES = CLASSES + 9 + PROJECTED


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage vectors of all texts and, per text, the index of its first passage (one entry more).

    A text without words has one passage of zeros.
    """
    n = len(offsets) - 1
    words = split_words(data, offsets)
    count = np.bincount(words.doc, minlength=n)
    begun = np.concatenate(([0], np.cumsum(count)))
    size = np.maximum(1, -(-count // PASSAGE))
    first = np.concatenate(([0], np.cumsum(size)))
    total = int(first[-1])
    out = np.zeros((total, FEATURES), np.float32)
    if len(words.hash) == 0:
        return out, first
    passage = first[words.doc] + (np.arange(len(words.doc)) - begun[words.doc]) // PASSAGE
    heads = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
    owner = passage[heads]
    number = np.diff(np.concatenate((heads, [len(passage)]))).astype(np.float32)
    length = (words.end - words.start).astype(np.float32)
    # bytes from the passage's first word to the next passage's first word of the same text
    left = words.start[heads]
    right = np.concatenate((left[1:], [0]))
    last = np.concatenate((words.doc[heads][1:] != words.doc[heads][:-1], [True]))
    right[last] = offsets[words.doc[heads][last] + 1]
    edges = np.empty(2 * len(left), np.int64)
    edges[0::2], edges[1::2] = left, right
    classes = _CLASS[data]
    room = (right - left).astype(np.float32)
    for c in range(CLASSES):
        marks = np.flatnonzero(classes == c)
        at = np.searchsorted(marks, edges)
        out[owner, c] = (at[1::2] - at[0::2]) / room
    same = passage[1:] == passage[:-1]
    again = np.concatenate(([False], same & (words.hash[1:] == words.hash[:-1])))
    pair = mix(words.hash + np.concatenate(([np.uint64(0)], words.hash[:-1])) * np.uint64(3))

    def distinct(values: np.ndarray) -> np.ndarray:
        key = np.sort(mix(values + passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) << np.uint64(24) | (passage.astype(np.uint64) & np.uint64(0xFFFFFF)))
        fresh = key[np.concatenate(([True], key[1:] != key[:-1]))]
        return np.bincount((fresh & np.uint64(0xFFFFFF)).astype(np.int64), minlength=total)[owner].astype(np.float32)

    def mean(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, heads).astype(np.float32) / number

    end = _CLASS[data[words.end - 1]]
    at = CLASSES
    average = mean(length)
    for k, values in enumerate(
        (
            average / 10, np.sqrt(np.maximum(0, mean(length * length) - average * average)) / 10, mean((length > 14).astype(np.float32)),
            distinct(words.hash) / number, distinct(pair) / number, mean(again.astype(np.float32)), mean((end == 5).astype(np.float32)),
            mean((end == 7).astype(np.float32)), np.minimum(1, number / PASSAGE),
        )
    ):
        out[owner, at + k] = values
    place = (words.hash >> np.uint64(51)).astype(np.int64)
    for k in range(PROJECTED):
        out[owner, at + 9 + k] = np.add.reduceat(_PROJECT[:, k][place], heads) / np.sqrt(number)
    return out, first


class Network:
    """Embedding, gated attention and classifier; ``fit`` by Adam on the log loss of documents."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        shapes = {"w": (FEATURES, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: (rng.normal(0, s[0] ** -0.5, s) if len(s) > 1 or k in "ac" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
        self.mean, self.scale = mean, scale

    def forward(self, x: np.ndarray, first: np.ndarray):
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (t * s) @ p["a"]
        size = np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), size))
        weight = e / np.repeat(np.add.reduceat(e, first[:-1]), size)
        z = np.add.reduceat(weight[:, None] * h, first[:-1])
        return x, h, t, s, weight, z, z @ p["c"] + p["d"][0]

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        logit = self.forward(x, first)[-1].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    def gradient(self, x, first, y) -> dict:
        p = self.p
        x, h, t, s, weight, z, logit = self.forward(x, first)
        size = np.diff(first)
        g = ((1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) / len(y)).astype(np.float32)
        gz = np.repeat(g[:, None] * p["c"], size, axis=0)
        ga = (gz * h).sum(1)
        ge = weight * (ga - np.repeat(np.add.reduceat(weight * ga, first[:-1]), size))
        gt, gs = ge[:, None] * p["a"] * s * (1 - t * t), ge[:, None] * p["a"] * t * s * (1 - s)
        gh = (gz * weight[:, None] + gt @ p["v"].T + gs @ p["u"].T) * (1 - h * h)
        return {"w": x.T @ gh, "b": gh.sum(0), "v": h.T @ gt, "u": h.T @ gs, "a": (ge[:, None] * t * s).sum(0), "c": z.T @ g, "d": np.array([g.sum()])}

    def fit(self, x, first, y, epochs: int = 12, batch: int = 64, rate: float = 3e-3, decay: float = 1e-3, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                pick = order[at : at + batch]
                rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in pick])
                begin = np.concatenate(([0], np.cumsum(first[pick + 1] - first[pick])))
                step += 1
                pace = rate * (1 - epoch / epochs)
                for k, g in self.gradient(x[rows], begin, y[pick]).items():
                    m[k] += 0.1 * (g - m[k])
                    v2[k] += 0.001 * (g * g - v2[k])
                    move = (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
                    self.p[k] -= (pace * (move + (decay * self.p[k] if self.p[k].ndim > 1 else 0))).astype(np.float32)


def _sample_rows(batches):
    schema = pa.schema([("label", pa.int32()), ("vectors", pa.binary())])
    for batch in chunks(batches, "text"):
        x, first = encode(*text_buffer(batch.column(1)))
        packed = []
        for a, b in zip(first, first[1:]):
            step = np.arange(b - a) if b - a <= SAMPLE_PASSAGES else np.linspace(0, b - a - 1, SAMPLE_PASSAGES).astype(np.int64)
            packed.append(x[a + step].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(packed, pa.binary())], schema=schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", sample: int = SAMPLE) -> Network | None:
    """Network learned from at most ``sample`` labelled rows (``id_col``, ``label_col`` 0 or 1).

    The rows with the smallest digests of their ids are taken; of a long document at
    most ``SAMPLE_PASSAGES`` evenly spaced passages. Labels other than 0 and 1, and null ids, are left out; a repeated row
    counts once. None when the rows hold fewer than two classes.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    known = bounded_sample(known.where("id IS NOT NULL AND label IN (0, 1)").distinct(), "id", sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(known), "id").select("label", "text").mapInArrow(_sample_rows, "label int, vectors binary").toArrow()
    y = rows.column(0).to_numpy().astype(np.float32)
    if len(set(y.tolist())) < 2:
        return None
    packed = [np.frombuffer(v.as_py(), np.float32).reshape(-1, FEATURES) for v in rows.column(1)]
    order = sorted(range(len(y)), key=lambda i: (packed[i].tobytes()[:64], y[i]))
    x = np.concatenate([packed[i] for i in order])
    first = np.concatenate(([0], np.cumsum([len(packed[i]) for i in order])))
    network = Network(x.mean(0), x.std(0) + 0.02)
    network.fit(x, first, y[order])
    return network


def _scores(network):
    def run(batches):
        for batch in chunks(batches, "text"):
            x, first = encode(*text_buffer(batch.column(batch.schema.get_field_index("text"))))
            score = network.value.score(x, first) if network.value is not None else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["id", "score"])

    return run


def score(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, ``score`` of label 1, ``predicted`` (1 from ``threshold`` on).

    Null and empty texts are one passage of zeros and scored as such; repeated rows
    score alike; a null id stays null. Without a network every score is 0.5. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]
    scored = rows.mapInArrow(_scores(sent), f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
