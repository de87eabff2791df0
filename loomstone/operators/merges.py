"""Byte-pair merges learned from a distributed table of words, a hundred or so a round, as if one by one.

The words (symbol ids and how often each occurs) and the counts of adjacent pairs are two partitioned tables. A round's job
applies the merges chosen last, sends the changes of pair counts of those words only that held a merged pair, adds them to
the counts, and brings the driver two bounded lists: the most frequent pairs, and the contexts of the leading ones. A context is a
longest run of symbols in a word of which all adjacent pairs are leading ones; equal runs are summed.

All occurrences of leading pairs lie in contexts, so merging there, best pair after best pair, follows their counts exactly, with those of
the pairs made from them. The round ends when the best is no longer ahead of the first pair that is not a leading one. Such pairs
only become fewer, and what a merge makes of them counts at most as often and has a newer, larger id, so none can come before.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed

# Bits of a symbol in the key of a pair.
BITS = 21
_MASK = (1 << BITS) - 1
# Rows that may come back from a round, and leading pairs in the first one; later ones have as many as fill about a third of the rows.
ROWS, LEADING = 60_000, 64
# The least count listed, as a share of the count of the last leading pair: the next round's leaders are among them.
DEPTH = 0.4
# Rounds after which the merged words and counts are written and lineage is cut.
ROUNDS_PER_TABLE = 10
# Symbols a task holds at a time, few enough to stay near the cache in pass after pass.
CHUNK_SYMBOLS = 500_000

Merge = tuple[int, int, int]  # left, right, new id
Pair = tuple[int, int]
Place = tuple[int, int, int]  # minus count, left, right: the order in which pairs are merged


# ---- planning ------------------------------------------------------------------------


@dataclass
class Survey:
    """Exact counts of the listed pairs, best first, and the contexts of the leading pairs with their counts."""

    pairs: list[tuple[int, int, int]]  # count, left, right
    contexts: list[tuple[list[int], int]]
    leading: set[Pair]
    end: Place | None  # pairs that are not listed come no earlier; none if they can't be merged

    def limit(self) -> Place | None:
        """Place of the first pair that is not a leading one."""
        return next(((-count, left, right) for count, left, right in self.pairs if (left, right) not in self.leading), self.end)


class Contexts:
    """Merging within contexts, with the counts of their pairs."""

    def __init__(self, survey: Survey):
        self.runs = [run for run, _ in survey.contexts]
        self.times = [n for _, n in survey.contexts]
        self.counts: Counter[Pair] = Counter()
        self.where: defaultdict[Pair, set[int]] = defaultdict(set)
        for i, run in enumerate(self.runs):
            for pair in zip(run, run[1:]):
                self.counts[pair] += self.times[i]
                self.where[pair].add(i)
        self.heap = [(-count, *pair) for pair, count in self.counts.items()]
        heapq.heapify(self.heap)

    def best(self) -> Place | None:
        while self.heap and self.counts.get(self.heap[0][1:], 0) != -self.heap[0][0]:
            heapq.heappop(self.heap)
        return self.heap[0] if self.heap else None

    def merge(self, left: int, right: int, new: int) -> None:
        counts, changed = self.counts, set()
        for i in self.where.pop((left, right)):
            run, n, out, k = self.runs[i], self.times[i], [], 0
            last = len(run) - 1
            while k <= last:
                if k < last and run[k] == left and run[k + 1] == right:
                    out.append(new)
                    k += 2
                else:
                    out.append(run[k])
                    k += 1
            if len(out) == len(run):
                continue
            for pair in zip(run, run[1:]):
                counts[pair] -= n
                changed.add(pair)
            for pair in zip(out, out[1:]):
                counts[pair] += n
                changed.add(pair)
                self.where[pair].add(i)
            self.runs[i] = out
        for pair in changed:
            if counts[pair] > 0:
                heapq.heappush(self.heap, (-counts[pair], *pair))
            else:
                del counts[pair]
                self.where.pop(pair, None)


def guesses(merges: list[Merge], counts: list[int], rest: dict[Pair, int]) -> dict[Pair, int]:
    """Pairs that the merges may have made of pairs that were not leading ones, and how often at most."""
    before, after = defaultdict(list), defaultdict(list)
    for (left, right), n in rest.items():
        before[right].append((left, n))
        after[left].append((right, n))
    made: dict[Pair, int] = {}
    for (left, right, new), count in zip(merges, counts):
        made |= {(x, new): min(n, count) for x, n in before[left]}
        made |= {(new, y): min(n, count) for y, n in after[right]}
    return made


def plan(survey: Survey, names: dict[int, str], vocab: dict[str, int], room: int, least: int) -> tuple[list[Merge], dict[Pair, int], dict[Pair, int], bool]:
    """The next merges that are certain, counts of the pairs known then, guesses of others, and whether none can follow.

    ``names`` and ``vocab`` get the new symbols. A pair whose joined name already exists adds no new id, and its symbol
    has neighbours outside the contexts, so it ends the plan.
    """
    contexts, limit, merges, counts, done = Contexts(survey), survey.limit(), [], [], room <= 0
    while not done:
        place = contexts.best()
        if place is None or (limit is not None and place >= limit):
            done = limit is None
            break
        if -place[0] < least:
            done = True
            break
        left, right = place[1:]
        name = names[left] + names[right]
        exists = name in vocab
        new = vocab.setdefault(name, len(vocab))
        names[new] = name
        merges.append((left, right, new))
        counts.append(-place[0])
        contexts.merge(left, right, new)
        room -= not exists
        done = room <= 0
        if exists:
            break
    rest = {(left, right): count for count, left, right in survey.pairs if (left, right) not in survey.leading}
    return merges, rest | {p: n for p, n in contexts.counts.items() if n > 0}, guesses(merges, counts, rest), done


def passes(merges: list[Merge]) -> list[list[Merge]]:
    """The merges in as few passes as keep those in order that can share a symbol of a word."""
    lefts: dict[int, int] = {}
    rights: dict[int, int] = {}
    made: dict[int, int] = {}
    out: list[list[Merge]] = []
    for left, right, new in merges:
        level = max(rights.get(left, 0), lefts.get(right, 0), made.get(left, 0), made.get(right, 0))
        if new in made or new in lefts or new in rights:  # an older symbol grows: after everything else
            level = len(out)
        lefts[left], rights[right] = max(lefts.get(left, 0), level + 1), max(rights.get(right, 0), level + 1)
        made[new] = level + 1
        if level == len(out):
            out.append([])
        out[level].append((left, right, new))
    return out


# ---- words -----------------------------------------------------------------------------


class Pass:
    """Merges applied at once to concatenated words."""

    def __init__(self, merges: list[Merge], n_symbols: int):
        merges = sorted(merges)
        self.keys = np.array([left << BITS | right for left, right, _ in merges], np.int64)
        self.news = np.array([new for _, _, new in merges], np.int32)
        # What a symbol is in any of the pairs: 1 the left one, 2 the right one.
        self.sides = np.zeros(n_symbols, np.uint8)
        self.sides[[m[0] for m in merges]] |= 1
        self.sides[[m[1] for m in merges]] |= 2

    def hits(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where merged pairs begin, and which of the merges it is."""
        sides = self.sides[symbols]
        at = np.flatnonzero(sides[:-1] & (sides[1:] >> 1))
        at = at[word[at] == word[at + 1]]
        pairs = symbols[at].astype(np.int64) << BITS | symbols[at + 1]
        slot = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        found = self.keys[slot] == pairs
        return at[found], slot[found]

    def apply(self, symbols: np.ndarray, word: np.ndarray, touched: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, slot = self.hits(symbols, word)
        if not len(at):
            return symbols, word
        # Hits side by side are one symbol repeated: every second one is merged, from the left.
        fresh = np.concatenate(([True], np.diff(at) != 1))
        begun = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        kept = (np.arange(len(at)) - begun) % 2 == 0
        at, slot = at[kept], slot[kept]
        symbols = symbols.copy()
        symbols[at] = self.news[slot]
        touched[word[at]] = True
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        return symbols[stays], word[stays]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(counts, symbols, whose symbol it is) of many words at a time."""
    waiting, size = [], 0

    def joined():
        table = pa.Table.from_batches(waiting).combine_chunks()
        lists = table.column("symbols").combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        return table.column("n").to_numpy(), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.repeat(np.arange(len(sizes)), sizes)

    for batch in batches:
        waiting.append(batch)
        size += len(batch.column(batch.schema.get_field_index("symbols")).flatten())
        if size >= CHUNK_SYMBOLS:
            yield joined()
            waiting, size = [], 0
    if size:
        yield joined()


_COUNTED = "key bigint, run binary, count bigint"


def _batch(key: np.ndarray, run: pa.Array, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), run, pa.array(count)], names=["key", "run", "count"])


def _summed(keys: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate(keys)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
    total = np.add.reduceat(np.concatenate(weights)[order], first) if len(key) else np.zeros(0, np.int64)
    used = total != 0
    return key[first][used], total[used]


def _pairs(symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.flatnonzero(word[:-1] == word[1:])
    return symbols[inside].astype(np.int64) << BITS | symbols[inside + 1], word[inside]


def _changes(pending: list[list[Merge]], leading: list[Pair], n_symbols: int):
    """Changes of pair counts by the pending merges, and the contexts of the leading pairs."""

    def contexts(known: Pass, n: np.ndarray, symbols: np.ndarray, word: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        at, _ = known.hits(symbols, word)
        if not len(at):
            return pa.array([], pa.binary()), np.zeros(0, np.int64)
        first = np.concatenate(([True], (np.diff(at) != 1) | (word[at[1:]] != word[at[:-1]])))
        begin, end = at[first], np.concatenate((at[:-1][first[1:]], at[-1:])) + 2
        sizes = end - begin
        places = np.concatenate(([0], np.cumsum(sizes)))
        inside = np.arange(places[-1]) + np.repeat(begin - places[:-1], sizes)
        data = symbols[inside].astype("<i4").tobytes()
        runs = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer((4 * places).astype(np.int32)), pa.py_buffer(data)])
        counted = pa.table({"run": runs, "count": pa.array(n[word[begin]])}).group_by("run").aggregate([("count", "sum")]).combine_chunks()
        return counted.column("run").combine_chunks(), counted.column("count_sum").to_numpy()

    def run(batches):
        steps = [Pass(m, n_symbols) for m in pending]
        anything = Pass([m for step in pending for m in step], n_symbols) if pending else None
        known = Pass([(left, right, 0) for left, right in leading], n_symbols) if leading else None
        for n, symbols, word in _chunks(batches):
            old, old_word, touched = symbols, word, np.zeros(len(n), bool)
            if anything:
                # A word without any of the pairs stays as it is through all passes; the others go behind them.
                may_change = np.zeros(len(n), bool)
                may_change[word[anything.hits(symbols, word)[0]]] = True
                open_to = may_change[word]
                same, same_word = symbols[~open_to], word[~open_to]
                symbols, word = symbols[open_to], word[open_to]
                for step in steps:
                    symbols, word = step.apply(symbols, word, touched)
                symbols, word = np.concatenate((same, symbols)), np.concatenate((same_word, word))
            was, now = touched[old_word], touched[word]
            gone, gone_word = _pairs(old[was], old_word[was])
            come, come_word = _pairs(symbols[now], word[now])
            key, count = _summed([gone, come], [-n[gone_word], n[come_word]])
            yield _batch(key, pa.nulls(len(key), pa.binary()), count)
            if known:
                runs, times = contexts(known, n, symbols, word)
                yield _batch(np.full(len(runs), -1, np.int64), runs, times)

    return run


def _merged(pending: list[list[Merge]], n_symbols: int):
    """Words after the pending merges; those of a single symbol have no pair and are left out."""

    def run(batches):
        steps = [Pass(m, n_symbols) for m in pending]
        for n, symbols, word in _chunks(batches):
            touched = np.zeros(len(n), bool)
            for step in steps:
                symbols, word = step.apply(symbols, word, touched)
            sizes = np.bincount(word, minlength=len(n))
            kept = sizes > 1
            symbols, sizes = symbols[kept[word]], sizes[kept]
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(n[kept]), pa.ListArray.from_arrays(pa.array(ends), pa.array(symbols))], names=["n", "symbols"])

    return run


def _count_all(batches):
    for n, symbols, word in _chunks(batches):
        key, whose = _pairs(symbols, word)
        key, count = _summed([key], [n[whose]])
        yield _batch(key, pa.nulls(len(key), pa.binary()), count)


def _total(parts: DataFrame) -> DataFrame:
    return parts.groupBy("key", "run").agg(F.sum("count").alias("count")).where(F.col("count") > 0)


def _ask(words: DataFrame, counts: DataFrame, pending: list[list[Merge]], leading: list[Pair], floor: int, n_symbols: int, new_from: int, least: int) -> Survey | None:
    """One round's job: contexts, and as many pairs that occur ``floor`` times or more as then may come back; nothing if not even the contexts may.

    ``counts`` are those of symbols before ``new_from``. Their pairs can only have become fewer, but for pairs of older symbols that pending merges made more of.
    """
    grown = sorted({new for step in pending for _, _, new in step if new < new_from})
    left, right = F.shiftright("key", BITS), F.col("key").bitwiseAND(_MASK)
    might = (F.col("count") >= floor) | left.isin(grown) | right.isin(grown) if grown else F.col("count") >= floor
    changes = words.mapInArrow(_changes(pending, leading, n_symbols), _COUNTED)
    total = _total(counts.where(might).unionAll(changes)).where((F.col("key") < 0) | (F.col("count") >= floor))
    found = total.orderBy(F.col("key") >= 0, F.desc("count"), "key").limit(ROWS).toArrow()
    key, count = found.column("key").to_numpy(), found.column("count").to_numpy()
    n = int((key < 0).sum())
    if n == ROWS:
        return None
    runs = [np.frombuffer(r, "<i4").tolist() for r in found.column("run")[:n].to_pylist()]
    pairs = list(zip(count[n:].tolist(), (key[n:] >> BITS).tolist(), (key[n:] & _MASK).tolist()))
    if len(key) == ROWS:
        end = (-pairs[-1][0], pairs[-1][1], pairs[-1][2] + 1)
    else:
        end = None if floor <= least else (1 - floor, -1, -1)
    return Survey(pairs, list(zip(runs, count[:n].tolist())), set(leading), end)


def learn(words: DataFrame, names: dict[int, str], vocab: dict[str, int], vocab_size: int, min_frequency: int) -> list[tuple[str, str]]:
    """Merges in order, as names of their parts, until the vocabulary is full or no pair is frequent enough.

    ``words`` is (n bigint, symbols array<int>), with names and ids of the symbols in ``names`` and ``vocab``, which grow.
    The most frequent pair is merged first, equal counts by the smaller ids.
    """
    if vocab_size >= 1 << BITS:
        raise ValueError(f"vocabularies are below {1 << BITS} symbols")
    least = max(1, min_frequency)
    words, new_from = checkpointed(words), len(vocab)
    counts = checkpointed(_total(words.mapInArrow(_count_all, _COUNTED)))
    merges: list[tuple[str, str]] = []
    # Merges not yet in the written words: settled passes, and those behind them, whose passes are planned together.
    pending: list[list[Merge]] = []
    settled: list[list[Merge]] = []
    waiting: list[Merge] = []
    rounds, width, maybe = 0, LEADING, {}
    known = {(r.key >> BITS, r.key & _MASK): r["count"] for r in counts.orderBy(F.desc("count"), "key").limit(4 * width).collect()}
    while len(vocab) < vocab_size and known:
        leading = heapq.nsmallest(width, known, key=lambda p: (-known[p], p))
        last = known[leading[-1]]
        leading += [p for p, most in maybe.items() if most >= last and p not in known]
        floor = max(least, int(DEPTH * last))
        survey = _ask(words, counts, pending, leading, floor, len(vocab), new_from, least)
        if survey is None:
            width, maybe = max(1, width // 2), {}
            continue
        size = len(vocab)
        planned, known, maybe, done = plan(survey, names, vocab, vocab_size - len(vocab), least)
        merges += [(names[left], names[right]) for left, right, _ in planned]
        waiting += planned
        pending = settled + passes(waiting)
        if planned and planned[-1][2] < size:  # an older symbol grows: what follows comes behind it
            settled, waiting = pending, []
        if done:
            break
        if not known:  # all that was listed is merged: look deeper
            known = {(0, 0): floor - 1}
        width = max(1, int(width * min(2, max(0.5, ROWS / 3 / (1 + len(survey.contexts))))))
        rounds += 1
        if rounds % ROUNDS_PER_TABLE == 0:
            counts = checkpointed(_total(counts.unionAll(words.mapInArrow(_changes(pending, [], len(vocab)), _COUNTED))))
            words, pending, new_from = checkpointed(words.mapInArrow(_merged(pending, len(vocab)), "n bigint, symbols array<int>")), [], len(vocab)
            settled, waiting = [], []
    return merges
