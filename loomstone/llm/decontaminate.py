"""Benchmark passages in documents, by pigeonhole edit matching.

A test item of m characters may differ by ``budget`` edits. Cut into budget + 1 pieces, at least one
piece of any such occurrence is untouched, so every occurrence holds an exact
piece hit. One pass with an Aho-Corasick automaton finds the hits; each is
verified with Myers' bit-parallel edit distance around the place it points to.
Text is compared in lower case with runs of white space as one space.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks

RATE = 1 / 16
PASS_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, rate: float = RATE) -> tuple[int, list[tuple[int, str]]]:
    """Error budget and the budget + 1 pieces of ``item`` with their offsets, of near equal length."""
    budget = int(len(item) * rate)
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return budget, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """Bit-parallel automaton of one item; ``best`` gives its least edit distance to a substring."""

    def __init__(self, item: str):
        self.size = len(item)
        self.mask = (1 << self.size) - 1
        self.at: dict[str, int] = {}
        for i, c in enumerate(item):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end) of the first best occurrence in ``text``."""
        mask, top = self.mask, 1 << (self.size - 1)
        up, down, score = mask, 0, self.size
        found = (score, 0)
        for place, c in enumerate(text, 1):
            eq = self.at.get(c, 0)
            x = eq | down
            d0 = ((((x & up) + up) ^ up) | x) & mask
            hp = (down | ~(d0 | up)) & mask
            hn = d0 & up
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
            hp = hp << 1 & mask
            hn = hn << 1 & mask
            up = (hn | ~(d0 | hp)) & mask
            down = d0 & hp
            if score < found[0]:
                found = (score, place)
        return found


class Finder:
    """Occurrences of all items of one pass."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = {}
        where = defaultdict(list)
        for key, text in items:
            budget, parts = pieces(text, rate)
            self.items[key] = (text, budget, Pattern(text))
            for offset, part in parts:
                where[part].append((key, offset))
        self.words = ahocorasick.Automaton()
        for part, uses in where.items():
            self.words.add_word(part, (len(part), uses))
        self.words.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        """item -> (distance, begin of the window verified, end of the match), the best one for each item."""
        best: dict[int, tuple[int, int, int]] = {}
        tried: dict[int, int] = {}
        for last, (size, uses) in self.words.iter(text) if self.items else ():
            for key, offset in uses:
                item, budget, pattern = self.items[key]
                if best.get(key, (1,))[0] == 0:
                    continue
                begin = last + 1 - size - offset
                if text.startswith(item, begin) if begin >= 0 else False:
                    best[key] = (0, begin, begin + len(item))
                    continue
                if tried.get(key, -1) == begin:
                    continue
                tried[key] = begin
                low = max(0, begin - budget)
                distance, end = pattern.best(text[low : begin + len(item) + budget])
                if distance <= budget and distance < best.get(key, (budget + 1,))[0]:
                    best[key] = (distance, low, low + end)
        return best


def _matches(items, rate):
    schema = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("distance", pa.int32()), ("budget", pa.int32()), ("end", pa.int64())])

    def run(batches):
        # By place in the list: an item id may stand for several texts.
        finder = Finder(list(enumerate(text for _, text in items.value)), rate)
        for batch in chunks(batches, "text"):
            out = []
            for key, text in zip(batch.column(0), batch.column(1)):
                best = {}
                for place, (distance, _, end) in sorted(finder.find(normal(text.as_py())).items()):
                    item = items.value[place][0]
                    if item not in best or distance < best[item][0]:
                        best[item] = (distance, finder.items[place][1], end)
                out += [(key.as_py(), item, *values) for item, values in best.items()]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def find_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", rate: float = RATE, pass_chars: int = PASS_CHARS,
) -> DataFrame:
    """One row per document and item that occurs in it: id, item_id, distance, budget, end.

    ``distance`` is the least number of edits of an occurrence, at most ``budget`` (``rate`` of the item's
    length, rounded down; 0 for short items); ``end`` is where it ends in the normalised text. Items are sent to tasks in passes of
    about ``pass_chars`` characters by digest of their id, as many as the items' total size asks
    for, so a larger benchmark makes more passes and not larger tasks. Items with null id or
    without text match nothing, equal items match each under its own id, an id with several texts
    matches as the one with the least distance; repeated
    documents give a row each; null texts match nothing; a document's null id stays null. An empty table on either side
    gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    known = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text_col).alias("text")).where(
        "item IS NOT NULL AND text IS NOT NULL"
    ).distinct()
    total = known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-total // pass_chars))
    found = None
    for turn in range(passes):
        part = known.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == turn) if passes > 1 else known
        texts = sorted((r.item, normal(r.text)) for r in part.toLocalIterator())
        texts = [t for t in texts if t[1]]
        sent = spark.sparkContext.broadcast(texts)
        hit = rows.mapInArrow(_matches(sent, rate), "id bigint, item bigint, distance int, budget int, end bigint")
        found = hit if found is None else found.unionAll(hit)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "distance", "budget", "end")
