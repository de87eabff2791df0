"""Encoding and decoding of whole Arrow batches with numpy.

A batch is one byte buffer. Character classes give the pre-token edges of all its texts at once; the pre-tokens are dictionary
encoded, the distinct ones that were not met before are merged together, and ids are gathered by their places. No step
looks at texts or tokens one by one, but for special tokens, which are rare.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text handled at a time (work arrays take about 60 times as much and should stay near the cache), and distinct pre-tokens
# remembered by a task; beyond that the memory starts anew.
CHUNK_BYTES = 2 << 20
CACHE_LIMIT = 200_000
# Bytes of text split at a time where pre-tokens are only counted, and chunks that are counted together.
SPLIT_BYTES, COUNTED_CHUNKS = 1 << 20, 8

OTHER, LETTER, NUMBER, SPACE = range(4)


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """Class of every code point."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for run in regex.finditer(pattern, every):
            first, last = ord(every[run.start()]), ord(every[run.end() - 1])
            classes[first : last + 1] = kind
    classes[0xD800:0xE000] = OTHER
    return classes


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[0], starts[0] + 1, ... of all ranges, one range after another."""
    begins = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - begins, sizes)


def byte_ranges(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and where each begins (one entry more); null is empty."""
    texts = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[places[0] : places[-1]], places - places[0]


class Pieces(NamedTuple):
    """Pre-tokens and special tokens of a chunk in order: where each begins (one entry more) and whether it is special."""

    begin: np.ndarray
    special: np.ndarray


def split_pieces(data: np.ndarray, places: np.ndarray, special: re.Pattern | None) -> Pieces:
    """Edges of the pre-tokens of all texts in ``data``; equal to matching the published pattern between special tokens."""
    joined = data.tobytes().decode()
    n = len(joined)
    if not n:
        return Pieces(np.zeros(1, np.int64), np.zeros(0, bool))
    first_byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    classes = character_classes()[points]
    hard = np.zeros(n + 1, bool)
    hard[np.searchsorted(first_byte, places)] = True
    spans, at = [], 0
    while special and (found := special.search(joined, at)):
        begin, end = found.span()
        if hard[begin + 1 : end].any():  # over the edge of a text
            at = begin + 1
            continue
        spans.append((begin, end))
        at = end
    for begin, end in spans:
        hard[begin] = hard[end] = True

    edge = hard[:n].copy()
    edge[0] = True
    edge[1:] |= classes[1:] != classes[:-1]
    runs = np.flatnonzero(edge)
    ends = np.append(runs[1:], n)
    kind = classes[runs]
    start = np.zeros(n + 1, bool)
    start[runs] = True
    # White space before a word: all but its last character are one piece, and a plain space goes to the word.
    before_word = (kind == SPACE) & ~hard[ends]
    start[ends[before_word] - 1] = True
    taken = ends[before_word & (points[ends - 1] == 0x20)]
    start[taken] = False
    # An apostrophe that begins a piece takes s, d, m, t, ll, ve or re from the letters behind it.
    marks = runs[(kind == OTHER) & (points[runs] == 0x27) & (ends == runs + 1) & start[runs] & ~hard[ends]]
    marks = marks[classes[np.minimum(marks + 1, n - 1)] == LETTER]
    if len(marks):
        letters = ends[np.searchsorted(runs, marks + 1)] - marks - 1
        one, two = points[marks + 1], points[np.minimum(marks + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "sdmt"])
        long = np.zeros(len(marks), bool)
        for a, b in ("ll", "ve", "re"):
            long |= (one == ord(a)) & (two == ord(b)) & (letters >= 2)
        size = np.where(short, 1, np.where(long, 2, 0))
        marks, size, letters = marks[size > 0], size[size > 0], letters[size > 0]
        start[marks + 1] = False
        start[(marks + 1 + size)[letters > size]] = True
    for begin, end in spans:
        start[begin + 1 : end] = False
    begins = np.flatnonzero(start[:n])
    is_special = np.zeros(len(begins), bool)
    if spans:
        is_special[np.searchsorted(begins, [b for b, _ in spans])] = True
    return Pieces(np.append(first_byte[begins], len(data)), is_special)


def chunks(places: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes (``CHUNK_BYTES``), one text at least."""
    at = 0
    while at < len(places) - 1:
        to = max(at + 1, int(np.searchsorted(places, places[at] + (limit or CHUNK_BYTES), side="right")) - 1)
        yield at, to
        at = to


def _pieces_of(data: np.ndarray, begin: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(begin, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(begin) - 1, buffers)


def line_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pre-tokens (token, n) of all lines of the first column, counted some chunks at a time; a line keeps its newline."""
    held: list[pa.Array] = []

    def counted() -> pa.RecordBatch:
        coded = pa.concat_arrays(held).dictionary_encode()
        held.clear()
        n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).astype(np.int64)
        return pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.large_string()).cast(pa.string()), pa.array(n)], names=["token", "n"])

    for batch in batches:
        whole, places = byte_ranges(batch.column(0))
        for at, to in chunks(places, SPLIT_BYTES):
            data = whole[places[at] : places[to]]
            lines = np.unique(np.concatenate((places[at : to + 1] - places[at], np.flatnonzero(data == 10) + 1)))
            held.append(_pieces_of(data, split_pieces(data, lines, None).begin))
            if len(held) == COUNTED_CHUNKS:
                yield counted()
    if held:
        yield counted()


class Encoded(NamedTuple):
    """Ids of a chunk, and the pieces they come from: where each begins in the bytes and in the ids (one entry more)."""

    ids: np.ndarray
    begin: np.ndarray
    first_id: np.ndarray

    def counts(self, places: np.ndarray) -> np.ndarray:
        """Ids of each text; texts begin at ``places``."""
        return np.diff(self.first_id[np.searchsorted(self.begin, places)])


class Encoder:
    """Encodes texts inside a task; remembers the ids of pre-tokens it has met."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: list[str], shown: dict[int, str]):
        longest_first = sorted(special, key=len, reverse=True)
        self.pattern = re.compile("|".join(map(re.escape, longest_first))) if longest_first else None
        self.special = {token.encode(): vocab[token] for token in special}
        self.of_byte = np.array([vocab.get(shown[b], -1) for b in range(256)], np.int32)
        self.shift = np.int64(max(vocab.values(), default=0)).item().bit_length() + 1
        known = [(vocab[a] << self.shift | vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)]
        first: dict[int, tuple[int, int]] = {}
        for key, rank, new in known:  # of a pair met twice the first counts
            first.setdefault(key, (rank, new))
        table = sorted((key, rank, new) for key, (rank, new) in first.items())
        self.keys = np.array([t[0] for t in table], np.int64)
        self.ranks = np.array([t[1] for t in table], np.int64)
        self.news = np.array([t[2] for t in table], np.int32)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of pairs in the merge table, its length for those that are not there."""
        none = len(self.keys)
        if not none:
            return np.zeros(len(left), np.int64)
        pairs = left.astype(np.int64) << self.shift | right
        slot = np.minimum(np.searchsorted(self.keys, pairs), none - 1)
        slot[self.keys[slot] != pairs] = none
        return slot

    def _merge(self, symbols: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge every word's best pair, round after round, until no word has one; symbols by word and their number.

        A merge makes new pairs only with its neighbours, so only those are looked up again.
        """
        none = len(self.keys)
        rank_of = np.append(self.ranks, none)
        symbols, done = symbols.copy(), []
        slot = np.full(len(symbols), none, np.int64)
        inside = np.flatnonzero(word[:-1] == word[1:])
        slot[inside] = self._slots(symbols[inside], symbols[inside + 1])
        rank = rank_of[slot]
        while len(symbols):
            begins = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lengths = np.diff(np.append(begins, len(word)))
            best = np.repeat(np.minimum.reduceat(rank, begins), lengths)
            over = best == none
            if over.any():
                done.append((word[over], symbols[over]))
            at = np.flatnonzero((rank == best) & ~over)
            if not len(at):
                break
            fresh = np.concatenate(([True], np.diff(at) != 1))
            begun = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begun) % 2 == 0]
            symbols[at] = self.news[slot[at]]
            changed = np.zeros(len(symbols), bool)
            changed[at] = changed[np.maximum(at - 1, 0)] = True
            stays = ~over
            stays[at + 1] = False
            symbols, word, slot, rank, changed = (c[stays] for c in (symbols, word, slot, rank, changed))
            again = np.flatnonzero(changed)
            slot[again] = none
            paired = again[again < len(word) - 1]
            paired = paired[word[paired] == word[paired + 1]]
            slot[paired] = self._slots(symbols[paired], symbols[paired + 1])
            rank[again] = rank_of[slot[again]]
        if not done:
            return np.zeros(0, np.int32), np.zeros(n_words, np.int64)
        words, flat = (np.concatenate(c) for c in zip(*done))
        order = np.argsort(words, kind="stable")
        return flat[order], np.bincount(words, minlength=n_words)

    def _learn(self, pieces: np.ndarray) -> None:
        """Ids of pre-tokens (bytes) not met before."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.of_byte[data]
        word = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, pieces), np.int64, len(pieces)))
        known = symbols >= 0  # bytes never seen in training have no id and are left out
        flat, sizes = self._merge(symbols[known], word[known], len(pieces))
        base = len(self.place)
        self.place.update(zip(pieces, range(base, base + len(pieces))))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, flat))

    def encode_bytes(self, data: np.ndarray, places: np.ndarray) -> Encoded:
        """Texts that lie one after another in ``data``."""
        pieces = split_pieces(data, places, self.pattern)
        n = len(pieces.begin) - 1
        if not n:
            return Encoded(np.zeros(0, np.int32), pieces.begin, np.zeros(1, np.int64))
        coded = _pieces_of(data, pieces.begin).dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        if len(self.place) + len(distinct) > CACHE_LIMIT:
            self._forget()
        place = np.fromiter(map(self.place.get, distinct, repeat(-1)), np.int64, len(distinct))
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            place[fresh] = len(self.place) + np.arange(len(fresh))
            self._learn(distinct[fresh])
        slot = place[coded.indices.to_numpy()]
        starts, sizes = self.starts[slot], self.sizes[slot]
        sizes[pieces.special] = 1
        ids = self.flat[np.where(np.repeat(pieces.special, sizes), 0, _spread(starts, sizes))] if len(self.flat) else np.zeros(int(sizes.sum()), np.int32)
        first = np.concatenate(([0], np.cumsum(sizes)))
        marked = np.flatnonzero(pieces.special)
        if len(marked):
            of_distinct = np.array([self.special.get(p, -1) for p in distinct], np.int32)
            ids[first[marked]] = of_distinct[coded.indices.to_numpy()[marked]]
        return Encoded(ids, pieces.begin, first)

    def encode_texts(self, column: pa.Array) -> pa.Array:
        """Ids of each text as a list; null gives none."""
        data, places = byte_ranges(column)
        ids, counts = [], []
        for at, to in chunks(places):
            some = self.encode_bytes(data[places[at] : places[to]], places[at : to + 1] - places[at])
            ids.append(some.ids)
            counts.append(some.counts(places[at : to + 1] - places[at]))
        ends = np.concatenate(([0], np.cumsum(np.concatenate(counts)))) if counts else np.zeros(1, np.int64)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))

    def encode(self, text: str) -> list[int]:
        return self.encode_texts(pa.array([text], pa.string()))[0].as_py()

    def examples(self, parts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Ids and loss mask of rendered conversations, lists of (head, body, assistant).

        An assistant turn marks the ids between the encoding of the text before its body and that of the text to its end. Pieces that
        end before a cut are the same in both, so only the piece that reaches a cut is encoded again, up to it.
        """
        flat, n = parts.flatten(), len(parts)
        head, body = (pc.fill_null(flat.field(c), "") for c in ("head", "body"))
        spoken = pc.fill_null(flat.field("assistant"), False).to_numpy(zero_copy_only=False)
        data, edges = byte_ranges(pc.binary_join_element_wise(head, body, ""))
        sizes = pc.fill_null(parts.value_lengths(), 0).to_numpy(zero_copy_only=False)
        places = edges[np.concatenate(([0], np.cumsum(sizes)))]
        whole = self.encode_bytes(data, places)
        counts = whole.counts(places)
        first = np.concatenate(([0], np.cumsum(counts)))

        heads = pc.binary_length(head).to_numpy(zero_copy_only=False)
        turns = np.flatnonzero(spoken)
        cuts = np.concatenate((edges[:-1][turns] + heads[turns], edges[1:][turns]))
        owner = np.tile(np.repeat(np.arange(n), sizes)[turns], 2)
        piece = np.maximum(np.searchsorted(whole.begin[1:], cuts, side="left"), 0)
        opens = cuts == places[owner]
        piece[opens] = 0
        lengths = np.where(opens, 0, cuts - whole.begin[piece])
        stretch = data[_spread(whole.begin[piece], lengths)]
        begins = np.concatenate(([0], np.cumsum(lengths)))
        again = self.encode_bytes(stretch, begins).counts(begins) if len(stretch) else np.zeros(len(cuts), np.int64)
        reached = np.where(opens, first[owner], whole.first_id[piece] + again)
        reached = np.minimum(reached, first[owner + 1])
        start, end = reached[: len(turns)], reached[len(turns) :]
        used = end > start
        change = np.zeros(len(whole.ids) + 1, np.int64)
        np.add.at(change, start[used], 1)
        np.add.at(change, end[used], -1)
        mask = (np.cumsum(change[:-1]) > 0).astype(np.int32)
        offsets = pa.array(first.astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(whole.ids)), pa.ListArray.from_arrays(offsets, pa.array(mask))


def spelled_out(lists: pa.Array, spelling: list[bytes]) -> pa.Array:
    """Bytes of each list of ids joined, as text; bytes that form no character become the replacement character."""
    sizes = np.array([len(s) for s in spelling], np.int64)
    starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(spelling), np.uint8)
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    first = np.concatenate(([0], np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))))
    ends = np.concatenate(([0], np.cumsum(sizes[ids])))[first]
    data = flat[_spread(starts[ids], sizes[ids])] if len(ids) else np.zeros(0, np.uint8)
    joined = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    try:
        return joined.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([b.decode("utf-8", errors="replace") for b in joined.to_pylist()], pa.string())


def named(lists: pa.Array, names: list[str]) -> pa.Array:
    """Names of the ids of each list."""
    first = np.concatenate(([0], np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))))
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(names, pa.string()).take(lists.flatten()))


def text_bytes(column: pa.Array) -> np.ndarray:
    """Bytes of each text; null has none."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def list_bytes(lists: pa.Array) -> np.ndarray:
    """Bytes of each list of ids; null has none."""
    return 4 * pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def part_bytes(parts: pa.Array) -> np.ndarray:
    """Bytes of the texts of each rendered conversation (see ``Encoder.examples``)."""
    flat = parts.flatten()
    ends = np.concatenate(([0], np.cumsum(text_bytes(flat.field("head")).astype(np.int64) + text_bytes(flat.field("body")))))
    return np.diff(ends[np.concatenate(([0], np.cumsum(pc.fill_null(parts.value_lengths(), 0).to_numpy(zero_copy_only=False))))])


def each(batches: Iterator[pa.Array], make, sizes) -> Iterator[pa.Array]:
    """What ``make`` gives for the rows of every batch, in slices of about ``CHUNK_BYTES`` by their ``sizes``: a batch may hold far more than its work arrays should."""
    for batch in batches:
        rows = batch.combine_chunks() if isinstance(batch, pa.ChunkedArray) else batch
        places = np.concatenate(([0], np.cumsum(sizes(rows), dtype=np.int64)))
        for at, to in chunks(places):
            yield make(rows.slice(at, to - at))
