"""Conversation repair by weighted CYK parsing over spans of rows.

A repaired conversation is ``(s?(ua)+)?`` in role initials. The repair grammar is in Chomsky normal form: its
nonterminals ``<p,q>`` say that a span takes the conversation from point p to point q (start, after the system turn, after a user turn,
after an assistant turn); ``<p,q> -> <p,m> <m,q>`` joins two spans, ``<p,q> -> row`` keeps, reroles or deletes one row, and
insertions are closed under repetition before and after every row. A cell holds the least (cost, audit) of its nonterminal, the audit being the initials of
the edits. Cells are combined bottom-up by span length: 1, 2, 4, ... rows within a stretch of ``STRETCH`` rows, then stretches within
their conversation, ``FAN_OUT`` at a time. One split of a span is enough, since all points a derivation can pass are nonterminals, so
every split gives the same cell. Equal costs on equal rows never give audits of which one begins the other (what is longer has further
insertions, which cost), so the least audits of two parts make the least audit of the whole.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Scratch

SPACES = " \t\n\x0b\x0c\r"
STRETCH, FAN_OUT = 1024, 64
PREFIX = 64
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
TRUNCATED = 1
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_POINTS = 4
#: Where a role initial leads from each point; what is absent is not allowed.
_STEP = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_ASSISTANT, "u"): _USER, (_USER, "a"): _ASSISTANT}
_ENDS = (_START, _ASSISTANT)

Cells = tuple  # of 16 (cost, audit) or None, by 4 * from + to


def join(left: Cells, right: Cells) -> Cells:
    """Cells of a span from those of its two parts."""
    out = []
    for p in range(_POINTS):
        for q in range(_POINTS):
            best = None
            for m in range(_POINTS):
                a, b = left[_POINTS * p + m], right[_POINTS * m + q]
                if a and b:
                    cell = (a[0] + b[0], a[1] + b[1])
                    if best is None or cell < best:
                        best = cell
            out.append(best)
    return tuple(out)


def _closure() -> Cells:
    """Insertions of any number: joined with itself until nothing changes."""
    cells = [None] * _POINTS**2
    for p in range(_POINTS):
        cells[_POINTS * p + p] = (0, "")
    for (p, role), q in _STEP.items():
        if role in "ua":
            cells[_POINTS * p + q] = (INSERT, "I")
    closed = tuple(cells)
    while (more := join(closed, closed)) != closed:
        closed = more
    return closed


INSERTED = _closure()


@lru_cache(maxsize=4096)
def row_cells(initial: str, must_go: bool, truncated: bool) -> Cells:
    """Cells of one row with the insertions around it."""
    cells: list = [(DELETE, "D") if p == q else None for p in range(_POINTS) for q in range(_POINTS)]
    if not must_go:
        more = TRUNCATED if truncated else 0
        for (p, role), q in _STEP.items():
            edits = [(KEEP + more, "K")] if role == initial else []
            edits += [(REROLE + more, "R")] if role in "ua" else []
            for cell in edits:
                at = _POINTS * p + q
                cells[at] = min(cell, cells[at]) if cells[at] else cell
    return join(join(INSERTED, tuple(cells)), INSERTED)


@lru_cache(maxsize=1 << 16)
def _short_span(rows: tuple) -> Cells:
    """Cells of a span of up to eight rows; such spans repeat a lot."""
    if len(rows) == 1:
        return row_cells(*rows[0])
    half = len(rows) // 2
    return join(_short_span(rows[:half]), _short_span(rows[half:]))


def span_cells(rows: list[tuple[str, bool, bool]]) -> Cells:
    """Cells of a span of rows (initial, must go, truncated), combined bottom-up by span length."""
    level = [_short_span(tuple(rows[i : i + 8])) for i in range(0, len(rows), 8)]
    while len(level) > 1:
        level = [join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def best_repair(cells: Cells) -> tuple[int, str]:
    return min(cells[_POINTS * _START + q] for q in _ENDS if cells[_POINTS * _START + q])


def role_at(place: int, length: int) -> str:
    """Role of an inserted or reroled row at ``place`` among ``length`` repaired rows; an odd length begins with the system turn."""
    return "assistant" if (place - length % 2) % 2 else "user"


# ---- faults and stretches ---------------------------------------------------------------


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) after the damage that crc32(``conv:turn``) modulo 20 names; a null is read as one space.

    0 drops a row, 1 empties its text, 2 takes out its ``.!?``, 3 repeats it, 4 makes it a user turn.
    """
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    named = rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), (F.crc32(key.cast("binary")) % 20).alias("kind"),
        F.coalesce(F.col(role).cast("string"), blank).alias("role"), F.coalesce(F.col(text).cast("string"), blank).alias("text"),
    ).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("time")
    return named.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times).drop("time")


def _number(batches):
    """Rows of a sorted partition with the partition and their place in their conversation there."""
    part, key, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index("key")).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        fresh = np.concatenate(([keys[0] != key], keys[1:] != keys[:-1]))
        begun = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), -1))
        place = np.where(begun >= 0, np.arange(len(keys)) - begun, np.arange(len(keys)) + count)
        key, count = keys[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(keys), part, np.int64)), pa.array(place.astype(np.int64))], names=[*batch.schema.names, "part", "place"]
        )


_DIGEST = (
    "costs array<bigint>, audits array<string>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, "
    "low bigint, high bigint, first_turn bigint, last_turn bigint, turns bigint, stretches array<struct<part:bigint,stretch:bigint,rows:bigint>>"
)
_LEGAL = {"su", "ua", "au"}


def _digest(part: int, stretch: int, rows: list[dict]) -> dict:
    """What is kept of the rows of one stretch, in order."""
    cells = span_cells([(r["initial"], r["blank"] or r["repeat"], r["open"]) for r in rows])
    turns = [r["turn"] for r in rows if r["turn"] is not None]
    initials = [r["initial"] for r in rows]
    return {
        "cells": cells, "blank": sum(r["blank"] for r in rows), "duplicate": sum(r["repeat"] and not r["blank"] for r in rows),
        "truncated": sum(r["open"] and not r["blank"] and not r["repeat"] for r in rows),
        "illegal": sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:])), "first": initials[0], "last": initials[-1],
        "low": min(turns, default=None), "high": max(turns, default=None), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None,
        "turns": len(set(turns)), "stretches": [{"part": part, "stretch": stretch, "rows": len(rows)}],
    }


def _merge(a: dict, b: dict) -> dict:
    """Digest of two neighbouring spans; rows are in order of their turns."""
    known = [d for d in (a, b) if d["turns"]]
    return {
        "cells": join(a["cells"], b["cells"]), **{c: a[c] + b[c] for c in ("blank", "duplicate", "truncated", "stretches")},
        "illegal": a["illegal"] + b["illegal"] + (a["last"] + b["first"] not in _LEGAL), "first": a["first"], "last": b["last"],
        "low": known[0]["low"] if known else None, "high": known[-1]["high"] if known else None,
        "first_turn": known[0]["first_turn"] if known else None, "last_turn": known[-1]["last_turn"] if known else None,
        "turns": a["turns"] + b["turns"] - (len(known) == 2 and a["last_turn"] == b["first_turn"]),
    }


def _row_of(digest: dict) -> dict:
    return {**{k: v for k, v in digest.items() if k != "cells"}, "costs": [c and c[0] for c in digest["cells"]], "audits": [c and c[1] for c in digest["cells"]]}


def _digest_of(row: dict) -> dict:
    return {**row, "cells": tuple(None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"]))}


def _each(schema: str, make):
    """A function for mapInArrow that makes the rows of every input row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = [made for row in batch.slice(at, 512).to_pylist() for made in make(row)]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _map(df: DataFrame, schema: str, make) -> DataFrame:
    arrow = _arrow(df.sparkSession, schema)
    return df.mapInArrow(_each(arrow, make), schema)


def _arrow(spark, schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _tree(stretches: DataFrame, scratch: Scratch, most_stretches: int, parts: int) -> DataFrame:
    """One digest per conversation: neighbouring spans are merged ``FAN_OUT`` at a time, until one is left."""
    fields = [f.split()[0] for f in _DIGEST.replace("struct<part:bigint,stretch:bigint,rows:bigint>", "x").split(", ")]
    schema = f"key string, part bigint, stretch bigint, {_DIGEST}"

    def merged(row):
        spans = [_digest_of(s) for s in sorted(row["spans"], key=lambda s: (s["part"], s["stretch"]))]
        while len(spans) > 1:
            spans = [_merge(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
        return [{"key": row["key"], "part": row["part"], "stretch": row["stretch"], **{k: v for k, v in _row_of(spans[0]).items() if k in fields}}]

    def up(level: DataFrame, part, stretch, name: str) -> DataFrame:
        spans = level.select("key", part.alias("p"), stretch.alias("s"), F.struct("part", "stretch", *fields).alias("span"))
        groups = spans.groupBy("key", "p", "s").agg(F.collect_list("span").alias("spans")).withColumnsRenamed({"p": "part", "s": "stretch"})
        return scratch.keep(_map(groups, schema, merged), name)

    level, round_no = stretches, 0
    while most_stretches > 1:
        level, round_no, most_stretches = up(level, F.col("part"), F.expr(f"stretch div {FAN_OUT}"), f"up-{round_no}"), round_no + 1, -(-most_stretches // FAN_OUT)
    while True:
        level, round_no, parts = up(level, F.expr(f"part div {FAN_OUT}"), F.lit(0).cast("bigint"), f"up-{round_no}"), round_no + 1, -(-parts // FAN_OUT)
        if parts <= 1:
            return level


# ---- the repaired text --------------------------------------------------------------------


def _slices(row: dict):
    """The part of a conversation's audit that belongs to each stretch of its rows, with the insertions before them."""
    cells = _digest_of(row)["cells"]
    audit = best_repair(cells)[1]
    length, at, made = len(audit) - audit.count("D"), 0, 0
    for i, s in enumerate(row["stretches"]):
        begin, left = at, s["rows"]
        while left:
            left -= audit[at] != "I"
            at += 1
        if i + 1 == len(row["stretches"]):
            at = len(audit)
        edits = audit[begin:at]
        yield {"key": row["key"], "part": s["part"], "place": s["stretch"] * STRETCH, "edits": edits, "made": made, "length": length}
        made += len(edits) - edits.count("D")


class _Repair:
    """Hash of one conversation's repaired rows, taken one after another."""

    def __init__(self):
        self.hash, self.any = hashlib.sha256(), False
        self.edits, self.made, self.length = iter(()), 0, 0

    def line(self, role: str, text: str) -> None:
        if self.any:
            self.hash.update(b"\n")
        self.hash.update(f"{role}:".encode())
        self.hash.update(text.encode())
        self.any = True
        self.made += 1

    def stretch(self, edits: str, made: int, length: int) -> None:
        self.finish()
        self.edits, self.made, self.length = iter(edits), made, length

    def row(self, role: str, text: str) -> None:
        for edit in self.edits:
            if edit == "I":
                self.line(role_at(self.made, self.length), "")
                continue
            if edit != "D":
                self.line(role if edit == "K" else role_at(self.made, self.length), text)
            return

    def finish(self) -> None:
        for _ in self.edits:  # only insertions are left
            self.line(role_at(self.made, self.length), "")


def _hash(batches):
    """Sorted rows and audit slices of whole conversations to (key, hash); a row at a time is held."""
    schema = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])
    key, repair = None, None
    for batch in batches:
        done = []
        for at in range(0, batch.num_rows, 256):
            for r in batch.slice(at, 256).to_pylist():
                if r["key"] != key:
                    if repair:
                        repair.finish()
                        done.append({"key": key, "repaired_sha256": repair.hash.hexdigest()})
                    key, repair = r["key"], _Repair()
                if r["edits"] is not None:
                    repair.stretch(r["edits"], r["made"], r["length"])
                else:
                    repair.row(r["role"], r["text"])
        yield pa.RecordBatch.from_pylist(done, schema=schema)
    if repair:
        repair.finish()
        yield pa.RecordBatch.from_pylist([{"key": key, "repaired_sha256": repair.hash.hexdigest()}], schema=schema)


def repair(rows: DataFrame, scratch: Scratch, conversations: DataFrame | None = None) -> DataFrame:
    """Cheapest repair of every conversation of ``rows`` (conv, turn, role, text): one row each.

    Columns conv, gaps, blank, duplicate, truncated, illegal, cost (longs), audit, repaired_sha256. ``conversations`` (conv)
    names conversations to return even if they have no rows: zeros, an empty audit and the hash of the empty string.

    Rows are taken by turn, nulls first, then role, text (by their first 64 characters, then a digest); repeated rows count each, the later
    ones as duplicates. A null conversation is one of its own; null roles and texts are read as one space. A role's initial is its first character, so an empty role has none
    and can only be reroled or deleted. Texts of any length are moved row by row. An empty table gives no rows.

    No task holds a conversation: a range sort cuts long ones, cells are merged as a tree, and first
    occurrences are a grouped minimum. Only the hash, which SHA-256 defines as one pass, streams a conversation's rows through one task.
    """
    spark = rows.sparkSession
    named = rows.select(
        F.col("conv"), F.concat(F.when(F.col("conv").isNull(), "").otherwise("="), F.coalesce(F.col("conv").cast("string"), F.lit(""))).alias("key"),
        F.col("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    inner = F.rtrim("text", F.lit(SPACES))
    seen = named.select(
        "*", F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text")).alias("digest"), F.substring("role", 1, 1).alias("initial"),
        (inner == "").alias("blank"), (~F.right(inner, F.lit(1)).isin(".", "!", "?")).alias("open"),
        F.substring("role", 1, PREFIX).alias("role_begin"), F.substring("text", 1, PREFIX).alias("text_begin"), F.monotonically_increasing_id().alias("copy"),
    )
    order = ["key", "turn", "role_begin", "text_begin", "digest", "copy"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    laid = seen.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("role_begin", "text_begin", "copy")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in laid.schema)
    laid = scratch.keep(laid.mapInArrow(_number, f"{schema}, part bigint, place bigint"), "rows")

    firsts = laid.where("NOT blank").groupBy("key", "digest").agg(F.min(F.struct("part", "place")).alias("at")).select("key", "at.part", "at.place", F.lit(False).alias("again"))
    flagged = laid.select("key", "part", "place", "turn", "initial", "blank", "open").join(firsts, ["key", "part", "place"], "left")
    row = F.struct("place", "turn", "initial", "blank", "open", (F.coalesce("again", F.lit(True)) & ~F.col("blank")).alias("repeat"))
    grouped = flagged.groupBy("key", "part", F.expr(f"place div {STRETCH}").alias("stretch")).agg(F.collect_list(row).alias("rows"))

    def stretch(r):
        digest = _digest(r["part"], r["stretch"], sorted(r["rows"], key=lambda x: x["place"]))
        return [{"key": r["key"], "part": r["part"], "stretch": r["stretch"], **_row_of(digest)}]

    stretches = scratch.keep(_map(grouped, f"key string, part bigint, stretch bigint, {_DIGEST}", stretch), "stretches")
    last = stretches.agg(F.max("stretch")).first()[0]
    whole = _tree(stretches, scratch, 1 + (last or 0), parts)

    audits = _map(whole, "key string, part bigint, place bigint, edits string, made bigint, length bigint", _slices)
    texts = laid.select("key", "part", "place", F.lit(1).alias("kind"), "role", "text", F.lit(None).cast("string").alias("edits"), F.lit(0).cast("bigint").alias("made"), F.lit(0).cast("bigint").alias("length"))
    cuts = audits.select("key", "part", "place", F.lit(0).alias("kind"), F.lit("").alias("role"), F.lit("").alias("text"), "edits", "made", "length")
    hashes = texts.unionByName(cuts).repartition("key").sortWithinPartitions("key", "part", "place", "kind").mapInArrow(_hash, "key string, repaired_sha256 string")

    def verdict(r):
        cost, audit = best_repair(_digest_of(r)["cells"])
        gaps = r["high"] - r["low"] + 1 - r["turns"] if r["turns"] else 0
        return [{"key": r["key"], "gaps": gaps, **{c: r[c] for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit}]

    counts = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
    repaired = _map(whole, f"key string, {counts}, audit string", verdict).join(hashes, "key")
    every = (named.select("conv") if conversations is None else conversations.select("conv")).distinct()
    every = every.select("conv", F.concat(F.when(F.col("conv").isNull(), "").otherwise("="), F.coalesce(F.col("conv").cast("string"), F.lit(""))).alias("key"))
    out = every.join(repaired, "key", "left")
    return out.select(
        "conv", *[F.coalesce(c.split()[0], F.lit(0).cast("bigint")).alias(c.split()[0]) for c in counts.split(", ")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"),
    )
