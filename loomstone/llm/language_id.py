"""Language identification in two levels.

Level one tells families of languages apart by one-versus-rest linear support vector machines; level two
separates the languages of the chosen family by one-versus-one machines. All machines
are linear in the frequencies of hashed letter sequences of one to four bytes, so a
text of any length is scored by summing table entries, with numpy over Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import SLICE_BYTES, chunks, text_buffer

PER_LANGUAGE = 300
ORDERS = (1, 2, 3, 4)
BITS = 14
UNKNOWN = "und"

# Families by language code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
    "celtic": "br cy ga gd",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_MULTIPLY = np.uint32(0x9E3779B1)

# Letters in lower case (bytes from 0x80 on count as letters), everything else as a space.
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = _LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def family(lang: str) -> str:
    return _FAMILY.get(lang.split("-")[0].lower(), lang)


def grams(data: np.ndarray, first: np.ndarray):
    """For each order the hashed sequence ending at every byte, and which bytes count.

    ``first`` are the starts of texts: sequences that would begin before one do not count,
    nor do those ending at a gap after a gap.
    """
    letters = _LETTER[data]
    code = letters.astype(np.uint32)
    here = letters != 32
    counts = here | np.concatenate(([False], here[:-1]))
    packed = code.copy()
    for order in ORDERS:
        if order > 1:
            packed[order - 1 :] |= code[: len(code) - order + 1] << np.uint32(8 * (order - 1))
            reach = first[:, None] + np.arange(order - 1)
            counts = counts.copy()
            counts[np.minimum(reach.ravel(), len(counts) - 1)] = False if len(counts) else False
        hashed = ((packed * _MULTIPLY) >> np.uint32(32 - BITS)).astype(np.int32)
        yield order, hashed + ((order - 1) << BITS), counts


class Machines:
    """Weights of all machines, one column each: families first, then pairs of languages."""

    def __init__(self, languages: list[str]):
        self.languages = sorted(languages)
        self.families = sorted({family(x) for x in self.languages})
        self.members = {f: [x for x in self.languages if family(x) == f] for f in self.families}
        self.pairs = [(a, b) for f in self.families for i, a in enumerate(self.members[f]) for b in self.members[f][i + 1 :]]
        k = (len(self.families) if len(self.families) > 1 else 0) + len(self.pairs)
        self.weights = np.zeros((k, len(ORDERS) << BITS), np.float32)
        self.bias = np.zeros(k)

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Margin of every text on every machine: weights averaged over the counted sequences, plus bias."""
        n = len(offsets) - 1
        total, number = np.zeros((n, len(self.bias))), np.zeros(n)
        keep = max(ORDERS) - 1
        for at in range(0, len(data), SLICE_BYTES):
            # the slice with the bytes before it that its first sequences need
            low, high = max(0, at - keep), min(len(data), at + SLICE_BYTES)
            here = offsets[:-1]
            first = here[(here >= low) & (here < high)] - low
            owner = np.searchsorted(offsets, np.arange(at, high, 1 << 30), side="right") - 1
            docs = np.arange(owner[0], np.searchsorted(offsets, high - 1, side="right"))
            heads = np.maximum(offsets[docs], at) - at
            solid = offsets[docs + 1] > np.maximum(offsets[docs], at)
            docs, heads = docs[solid], heads[solid]
            for order, hashed, counts in grams(data[low:high], first):
                hashed, counts = hashed[at - low :], counts[at - low :]
                number[docs] += np.add.reduceat(counts.astype(np.int64), heads)
                for k in range(len(self.bias)):
                    values = self.weights[k][hashed].astype(np.float64)
                    values *= counts
                    total[docs, k] += np.add.reduceat(values, heads)
        return total / np.maximum(1, number)[:, None] + self.bias

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(margins)
        own = len(self.families) if len(self.families) > 1 else 0
        odds = np.exp(2 * np.clip(margins[:, :own], -20, 20)) if own else np.ones((n, 1))
        odds = odds / odds.sum(axis=1, keepdims=True)
        chosen = odds.argmax(axis=1)
        langs, scores = [""] * n, np.zeros(n)
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(chosen == f)
            members = self.members[name]
            votes, share = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for k, (a, b) in enumerate(self.pairs):
                if a not in members:
                    continue
                p = 1 / (1 + np.exp(-3 * np.clip(margins[rows, own + k], -12, 12)))
                for lang, q in ((a, p), (b, 1 - p)):
                    votes[:, members.index(lang)] += q > 0.5
                    share[:, members.index(lang)] += q / max(1, len(members) - 1)
            best = (votes + share / 2).argmax(axis=1)
            for i, row in enumerate(rows):
                langs[row] = members[best[i]]
            scores[rows] = odds[rows, f] * (share[np.arange(len(rows)), best] if len(members) > 1 else 1.0)
        return langs, scores


def _separate(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, steps: int = 150, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear machine by the squared hinge loss, both sides weighing alike; full-batch Adam."""
    size = len(ORDERS) << BITS
    at = np.concatenate([r[0] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    value = np.concatenate([r[1] for r in rows]).astype(np.float64)
    used, at = np.unique(at, return_inverse=True)
    weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    w, bias = np.zeros(len(used)), 0.0
    m, s = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        margin = sign * (np.bincount(owner, value * w[at], len(rows)) + bias)
        slack = np.maximum(0, 1 - margin)
        g = -2 * weight * slack * sign
        grad = np.concatenate((np.bincount(at, g[owner] * value, len(used)) + decay * w / 100, [g.sum()]))
        m += 0.1 * (grad - m)
        s += 0.01 * (grad * grad - s)
        move = 1.0 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-12)
        w -= move[:-1]
        bias -= 0.02 * move[-1]
    out = np.zeros(size, np.float32)
    out[used] = w
    return out, float(bias)


def _frequencies(batches):
    schema = pa.schema([("lang", pa.string()), ("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])
    for batch in chunks(batches, "text"):
        at, value = [], []
        for text in batch.column(1):
            data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
            total = np.zeros(len(ORDERS) << BITS)
            if len(data):
                for _, hashed, counts in grams(data, np.zeros(1, np.int64)):
                    total += np.bincount(hashed[counts], minlength=len(total))
            found = np.flatnonzero(total)
            at.append(found.astype(np.int32))
            value.append((total[found] / max(1.0, total.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, schema.field(1).type), pa.array(value, schema.field(2).type)], schema=schema)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Machines | None:
    """Machines learned from at most ``per_language`` documents of every language, those of smallest digest.

    Digests are even, so of a language's ``n`` documents only those with a digest in the lowest
    ``(2 * per_language + 100) / n`` are ranked: a language of any size costs its rank some hundreds of rows.
    Rows with null text, language or id are left out. None when no language is left.
    """
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.length(text_col).alias("n")).where("n > 0 AND lang IS NOT NULL AND id IS NOT NULL")
    ids = known.select("id", "lang").distinct()
    # one row a learned language, each of which has its own weights in the model
    sizes = F.broadcast(ids.groupBy("lang").agg(F.count("*").alias("size")))
    share = F.xxhash64("id").cast("double") / 2.0**64 + 0.5
    lowest = ids.join(sizes, "lang").where(share * F.col("size") <= 2 * per_language + 100)
    picked = lowest.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= per_language)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("own")).where("text IS NOT NULL")
    rows = texts.join(picked.select("id", "lang"), "id").where("own = lang").select("lang", "text")
    got = rows.mapInArrow(_frequencies, "lang string, at array<int>, value array<float>").toArrow()
    langs = got.column(0).to_pylist()
    if not langs:
        return None
    sparse = [(at.values.to_numpy(), value.values.to_numpy()) for at, value in zip(got.column(1), got.column(2))]
    order = sorted(range(len(langs)), key=lambda i: (langs[i], len(sparse[i][0]), sparse[i][1].tobytes()[:256]))
    langs, sparse = [langs[i] for i in order], [sparse[i] for i in order]
    machines = Machines(sorted(set(langs)))
    kinds = np.array([family(x) for x in langs])
    k = 0
    if len(machines.families) > 1:
        for name in machines.families:
            machines.weights[k], machines.bias[k] = _separate(sparse, np.where(kinds == name, 1.0, -1.0))
            k += 1
    names = np.array(langs)
    for a, b in machines.pairs:
        mine = np.flatnonzero((names == a) | (names == b))
        machines.weights[k], machines.bias[k] = _separate([sparse[i] for i in mine], np.where(names[mine] == a, 1.0, -1.0))
        k += 1
    return machines


def _has_letter(data: np.ndarray) -> bool:
    if (_LETTER[data[:4096]] != 32).any() and (_LETTER[data[:4096]] < 128).any() and ((_LETTER[data[:4096]] >= 97) & (_LETTER[data[:4096]] < 123)).any():
        return True
    return any(c.isalpha() for c in data.tobytes().decode("utf-8", "replace"))


def _predictions(machines):
    def run(batches):
        known = machines.value
        for batch in chunks(batches, "text"):
            data, offsets = text_buffer(batch.column(1))
            lettered = [known is not None and b > a and _has_letter(data[a:b]) for a, b in zip(offsets, offsets[1:])]
            langs, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if any(lettered):
                guess, sure = known.predict(known.margins(data, offsets))
                langs = [g if ok else UNKNOWN for g, ok in zip(guess, lettered)]
                scores = np.where(lettered, sure, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, machines: Machines | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``lang_pred`` (a learned language), ``score`` (family's share times the language's).

    A null or empty text, or one without any letter, gives ``und`` with score 0, as does every text when no
    language was learned. Repeated rows are predicted alike; a null id stays null; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machines)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.mapInArrow(_predictions(sent), f"id {dict(rows.dtypes)['id']}, lang_pred string, score double")
    return found.withColumnRenamed("id", id_col)
