"""Language-model scores by deleted interpolation.

P(w | v) = l2 c(v,w)/c(v) + l1 c(w)/N + l0 1/(V+1), where the weights l depend on the
bucket (power of two) of the context's frequency c(v) and are learned by expectation-maximisation
on counts of a fold that the n-gram counts leave out.

All n-grams are counted over all training documents without a row per token. A *batch* of documents keeps
its tokens as numbers of its own vocabulary; it asks for the counts of its distinct words and word
pairs, dealt by hash over ``parts``, each part adds up what all batches sent and answers every batch in the order it
asked. What crosses the network is six bytes for each distinct n-gram of a batch and a small count back.

A task holds one batch or one part at a time. Per token it keeps numbers of four bytes, and eight only
where n-grams are hashed and put in order; texts are split, and estimates taken, piece by piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, chunks, mix, split_words, stream, text_buffer

BATCH_BYTES = 4 << 20
SPLIT_BYTES = 512 << 10
PIECE = 1 << 16
ASKED_ROWS = 64
PARTS_A_TASK = 2
ROW_A_PAGE = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}
PART_KEYS = 1 << 19
FOLDS = 10
ROUNDS = 60
LEAST_WEIGHT = 1e-6
BUCKETS = 40
STEPS_PER_OCTAVE = 4
NEVER = -(1 << 20)
HELD = "held-"

TRAIN, FOLD, SCORED = 0, 1, 2
_END, _START = stream(31, 2)
_PREV, _NEXT, _WORD = stream(32, 3) | np.uint64(1)

_BATCH = "batch string, ids binary, missing binary, role binary, words binary, vocabulary binary, tokens binary, learned bigint, fold bigint, n bigint"


def _planes(x: np.ndarray) -> bytes:
    """Small numbers by byte planes, entropy coded."""
    return pa.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _from_planes(b: bytes, n: int) -> np.ndarray:
    planes = pa.decompress(b, decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _counts_out(x: np.ndarray) -> bytes:
    """One byte each where they fit, else four."""
    return x.astype(np.uint8 if not len(x) or x.max() < 256 else np.uint32).tobytes()


def _counts_in(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, np.uint8 if len(b) == n else np.uint32).astype(np.int64)


def _pieces(ends: np.ndarray):
    """Ranges of documents that together end after about ``PIECE`` tokens (one document at least)."""
    first = 0
    while first < len(ends):
        begun = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, begun + PIECE, side="right")))
        yield first, last
        first = last


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and which of them each key is."""
    order = np.argsort(keys)
    ranked = keys[order]
    fresh = np.ones(len(keys), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=fresh[1:])
    ranked = ranked[fresh]
    which = np.empty(len(keys), np.int32)
    which[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    return ranked, which


def _mixed(keys: np.ndarray) -> np.ndarray:
    """``keys`` mixed in place, piece by piece."""
    for at in range(0, len(keys), PIECE):
        keys[at : at + PIECE] = mix(keys[at : at + PIECE])
    return keys


def _hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts in order, and how many words each text has."""
    hashes, counts = [], []
    for piece in chunks([batch], "text", SPLIT_BYTES):
        words = split_words(*text_buffer(piece.column(2)))
        counts.append(np.bincount(words.doc, minlength=piece.num_rows))
        hashes.append(np.insert(words.hash, np.cumsum(counts[-1]), _END))
    return np.concatenate(hashes), np.concatenate(counts)


def _grouped(batches):
    """Documents gathered to batches of about ``BATCH_BYTES``; those of the fold are kept apart from the others."""
    waiting: dict[bool, list] = {True: [], False: []}
    size = {True: 0, False: 0}
    for chunk in chunks(batches, "text", BATCH_BYTES):
        fold = pc.equal(chunk.column(1), FOLD)
        for held, rows in ((True, chunk.filter(fold)), (False, chunk.filter(pc.invert(fold)))):
            if rows.num_rows:
                waiting[held].append(rows)
                size[held] += rows.nbytes
            if size[held] >= BATCH_BYTES:
                yield held, pa.Table.from_batches(waiting[held]).combine_chunks().to_batches()[0]
                waiting[held], size[held] = [], 0
    for held, rows in waiting.items():
        if rows:
            yield held, pa.Table.from_batches(rows).combine_chunks().to_batches()[0]


def _batches(batches):
    """Documents (id, role, text) to one row per batch."""
    part, made = TaskContext.get().partitionId(), 0
    names = [f.split()[0] for f in _BATCH.split(", ")]
    for held, batch in _grouped(batches):
        made += 1
        hashes, count = _hashes(batch)
        known, inverse = _distinct(hashes)
        rank = np.argsort(-np.bincount(inverse), kind="stable")
        place = np.empty(len(rank), np.uint32)
        place[rank] = np.arange(len(rank))
        ids = batch.column(0)
        role = batch.column(1).to_numpy().astype(np.uint8)
        learned, fold = (int((count + 1)[mask].sum()) for mask in (role != SCORED, role == FOLD))
        values = [
            f"{HELD if held else ''}{part}-{made}", ids.fill_null(0).to_numpy().astype(np.int64).tobytes(), ids.is_null().to_numpy(zero_copy_only=False).tobytes(), role.tobytes(),
            count.astype(np.int64).tobytes(), known[rank].tobytes(), _planes(place[inverse]), learned, fold, int(len(hashes)),
        ]
        yield pa.RecordBatch.from_arrays([pa.array([v]) if not isinstance(v, bytes) else pa.array([v], pa.binary()) for v in values], names=names)


class Batch:
    """Tokens of a batch, its distinct n-grams in order, and which of them each token is."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.missing = np.frombuffer(row["missing"], bool)
        self.role = np.frombuffer(row["role"], np.uint8)
        self.words = np.frombuffer(row["words"], np.int64)
        vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        self.token = _from_planes(row["tokens"], row["n"]).view(np.int32)
        self.ends = np.cumsum(self.words + 1)
        hashes = np.concatenate((vocabulary, [_START]))
        self.uni = mix(hashes * _WORD)
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[self.ends - (self.words + 1)] = len(vocabulary)
        pair = (hashes * _PREV)[self.context]
        pair += (hashes * _NEXT)[self.token]
        self.bi, self.pair = _distinct(_mixed(pair))

    def of(self, role: int) -> np.ndarray:
        """Which tokens are of documents of ``role``."""
        return np.repeat(self.role == role, self.words + 1)

    def counts(self, role: int) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of the distinct words and pairs in documents of ``role``; START counts documents."""
        mine = self.of(role)
        uni = np.bincount(self.token[mine], minlength=len(self.uni))
        uni[-1] = int((self.role == role).sum())
        return uni, np.bincount(self.pair[mine], minlength=len(self.bi))

    def deal(self, parts: int):
        """For each part, the positions of the words and of the pairs that it counts."""
        for keys in (self.uni, self.bi):
            part = ((keys & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            yield order, np.searchsorted(part[order], np.arange(parts + 1))


def _short(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _long(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


_ASK = pa.schema([("part", pa.int32()), ("batch", pa.string()), ("n_uni", pa.int64()), ("keys", pa.binary()), ("train", pa.binary()), ("fold", pa.binary())])


def _asked(row: dict, parts: int):
    """What one batch asks of the parts, some of them at a time."""
    batch = Batch(row)
    counts = [batch.counts(TRAIN), batch.counts(FOLD)]
    (uo, ub), (bo, bb) = batch.deal(parts)
    for begun in range(0, parts, ASKED_ROWS):
        out: dict[str, list] = {f.name: [] for f in _ASK}
        for p in range(begun, min(parts, begun + ASKED_ROWS)):
            u, b = uo[ub[p] : ub[p + 1]], bo[bb[p] : bb[p + 1]]
            if len(u) + len(b) == 0:
                continue
            out["part"].append(p)
            out["batch"].append(row["batch"])
            out["n_uni"].append(len(u))
            out["keys"].append(_short(np.concatenate((batch.uni[u], batch.bi[b]))))
            for name, (uni, bi) in zip(("train", "fold"), counts):
                out[name].append(_counts_out(np.concatenate((uni[u], bi[b]))))
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _ASK], schema=_ASK)


def _ask(parts: int):
    def run(batches):
        for rows in batches:
            for i in range(rows.num_rows):
                yield from _asked(rows.slice(i, 1).to_pylist()[0], parts)

    return run


_ANSWER = pa.schema([("part", pa.int32()), ("batch", pa.string()), ("train", pa.binary()), ("fold", pa.binary()), ("distinct", pa.int64())])


def _answer(table: pa.Table) -> pa.Table:
    """Totals of one part's n-grams, back to every batch in the order it asked."""
    rows = table.to_pylist()
    sizes = [len(r["keys"]) // 6 for r in rows]
    keys = np.concatenate([_long(r["keys"]) for r in rows])
    keys |= np.concatenate([np.arange(s) >= r["n_uni"] for s, r in zip(sizes, rows)])
    known, inverse = _distinct(keys)
    totals = {}
    for name in ("train", "fold"):
        sent = np.concatenate([_counts_in(r[name], s) for s, r in zip(sizes, rows)])
        totals[name] = np.bincount(inverse, sent, len(known)).astype(np.int64)
    learned = totals["train"] + totals["fold"]
    start = int(mix(np.array([_START], np.uint64) * _WORD)[0] >> np.uint64(16)) << 16
    words = (known & np.uint64(1)) == 0
    distinct = int(((learned > 0) & words & (known != np.uint64(start))).sum())
    ends = np.cumsum(sizes)
    back = {name: [_counts_out(total[inverse[e - s : e]]) for s, e in zip(sizes, ends)] for name, total in totals.items()}
    return pa.Table.from_arrays(
        [pa.array([r["part"] for r in rows], pa.int32()), pa.array([r["batch"] for r in rows]), pa.array(back["train"], pa.binary()),
         pa.array(back["fold"], pa.binary()), pa.array([distinct] * len(rows), pa.int64())],
        schema=_ANSWER,
    )


def _received(left: pa.Table, right: pa.Table, parts: int):
    """The batch with its counts: (words, pairs) of the retained part, and of the fold."""
    batch = Batch(left.to_pylist()[0])
    (uo, ub), (bo, bb) = batch.deal(parts)
    got = {name: (np.zeros(len(batch.uni), np.int64), np.zeros(len(batch.bi), np.int64)) for name in ("train", "fold")}
    for r in right.to_pylist():
        p = r["part"]
        u, b = uo[ub[p] : ub[p + 1]], bo[bb[p] : bb[p + 1]]
        for name, (uni, bi) in got.items():
            values = _counts_in(r[name], len(u) + len(b))
            uni[u], bi[b] = values[: len(u)], values[len(u) :]
    return batch, got["train"], got["fold"]


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.ceil(np.log2(context + 1.0))).astype(np.int64)


_BIN = pa.schema([("bucket", pa.int32()), ("two", pa.int32()), ("one", pa.int32()), ("n", pa.int64())])


def _held_out_bins(parts: int, retained: int):
    """Counts of fold tokens by bucket and by the logarithms of their two estimates, in steps."""

    def steps(x):
        with np.errstate(divide="ignore"):
            return np.where(x > 0, np.rint(STEPS_PER_OCTAVE * np.log2(np.maximum(x, 1e-300))), NEVER).astype(np.int64)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _BIN.empty_table()
        batch, (uni, bi), _ = _received(left, right, parts)
        mine = np.flatnonzero(batch.of(FOLD))
        found, n = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        for at in range(0, len(mine), PIECE):
            piece = mine[at : at + PIECE]
            context = uni[batch.context[piece]]
            two = steps(bi[batch.pair[piece]] / np.maximum(1, context))
            one = steps(uni[batch.token[piece]] / max(1, retained))
            more, often = np.unique(np.column_stack((_bucket(context), two, one)), axis=0, return_counts=True)
            found, inverse = np.unique(np.concatenate((found, more)), axis=0, return_inverse=True)
            n = np.bincount(inverse.ravel(), np.concatenate((n, often)), len(found)).astype(np.int64)
        return pa.Table.from_arrays([*[pa.array(found[:, i].astype(np.int32)) for i in range(3)], pa.array(n.astype(np.int64))], schema=_BIN)

    return run


def learn_weights(bins, vocabulary: int, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (pair, word, uniform) by bucket, by expectation-maximisation on held-out counts.

    ``bins`` holds (bucket, two, one, n); a bucket without held-out tokens takes the weights of all together.
    """
    table = np.array([(b, t, o, n) for b, t, o, n in bins], float).reshape(-1, 4)
    uniform = 1.0 / (vocabulary + 1)

    def run(rows):
        p = np.column_stack([np.where(rows[:, i] <= NEVER, 0.0, 2.0 ** (rows[:, i] / STEPS_PER_OCTAVE)) for i in (1, 2)] + [np.full(len(rows), uniform)])
        l = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = p * l
            share /= share.sum(axis=1, keepdims=True)
            l = (share * rows[:, 3:]).sum(axis=0)
            l = np.maximum(l / l.sum(), LEAST_WEIGHT)
            l /= l.sum()
        return l

    common = run(table) if len(table) else np.full(3, 1 / 3)
    out = np.tile(common, (BUCKETS, 1))
    for b in np.unique(table[:, 0]).astype(int) if len(table) else ():
        out[b] = run(table[table[:, 0] == b])
    return out


_SCORE = "doc_id bigint, role int, n_tokens bigint, n_known bigint, base_score double, score double"
_SCORES = pa.schema([("doc_id", pa.int64()), ("role", pa.int32()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scores(parts: int, total: int, vocabulary: int, weights: np.ndarray):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _SCORES.empty_table()
        batch, (uni, bi), (uni_fold, bi_fold) = _received(left, right, parts)
        uni += uni_fold
        bi += bi_fold
        sums = []
        for first, last in _pieces(batch.ends):
            begins = batch.ends[first:last] - (batch.words[first:last] + 1)
            here = slice(begins[0], batch.ends[last - 1])
            c, context = uni[batch.token[here]], uni[batch.context[here]]
            l = weights[_bucket(context)]
            p = l[:, 0] * (bi[batch.pair[here]] / np.maximum(1, context)) + l[:, 1] * (c / max(1, total)) + l[:, 2] / (vocabulary + 1)
            base = np.log10((c + 1) / (total + vocabulary + 1))
            sums.append([np.add.reduceat(x, begins - begins[0]) for x in ((c > 0).astype(np.int64), base, np.log10(p))])
        return pa.Table.from_arrays(
            [pa.array(batch.ids, mask=batch.missing), pa.array(batch.role.astype(np.int32)), pa.array(batch.words + 1), *[pa.array(np.concatenate(s)) for s in zip(*sums)]],
            schema=_SCORES,
        )

    return run


def score(docs: DataFrame, learns, holds, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, n_known, train_tokens, base_score, score.

    ``learns`` and ``holds`` are conditions (Columns over ``docs``): which documents are learned from, and which of those form the
    held-out fold for the mixture weights. Tokens are the words and one end; a null or empty text
    is the end alone. ``base_score`` is the sum of log10((c + 1) / (N + V + 1)), ``score`` the model's log10 probability.
    A document whose condition is null is scored but not learned from; repeated rows count
    and are scored each; a null id stays null. Without documents to learn from, the uniform part alone
    gives probability. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "language-model")
    role = F.when(F.coalesce(learns, F.lit(False)), F.when(F.coalesce(holds, F.lit(False)), FOLD).otherwise(TRAIN)).otherwise(SCORED)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), role.cast("int").alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kept = scratch.keep(rows.mapInArrow(_batches, _BATCH), "batches", **ROW_A_PAGE)
    tokens, total, held, batches = kept.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "learned", "fold")], F.count("batch")).first()
    parts = max(1, -(-tokens // PART_KEYS))
    asked = kept.mapInArrow(_ask(parts), "part int, batch string, n_uni bigint, keys binary, train binary, fold binary")
    answers = asked.repartition(-(-parts // PARTS_A_TASK), "part").groupBy("part").applyInArrow(_answer, "part int, batch string, train binary, fold binary, distinct bigint")
    answers = scratch.keep(answers, "answers")
    vocabulary = answers.groupBy("part").agg(F.max("distinct").alias("v")).agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0]

    def together(run, schema, which=F.lit(True)):
        left, right = (side.where(which).repartition(max(1, batches), "batch").groupBy("batch") for side in (kept, answers))
        return left.cogroup(right).applyInArrow(run, schema)

    bins = together(_held_out_bins(parts, total - held), "bucket int, two int, one int, n bigint", F.col("batch").startswith(HELD))
    bins = bins.groupBy("bucket", "two", "one").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights(sorted((tuple(r) for r in bins)), vocabulary)
    found = scratch.keep(together(_scores(parts, total, vocabulary, weights), _SCORE), "scores")
    scratch.drop("batches", "answers")
    return found.select(
        F.col("doc_id").alias(id_col), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
