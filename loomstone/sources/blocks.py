"""Records of large files read by several tasks: delimited text with quoted newlines, and JSON arrays.

A file is read split by split as pieces that end in one separator: a newline for delimited text, a closing brace for JSON.
Whether a piece begins inside quotes depends on everything before it, so a first pass takes every split as a function of the state it
may begin in (a table of two rows: outside, inside) and counts what it would hold either way. These functions, one short row a split, are composed
file by file, which gives each split's true state and the number of its first record. A second pass cuts the records. Only records that cross
the edge of a split are shuffled, to be joined there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import checkpointed

_SPLIT = "source string, block bigint"
# A record or a part of one: its number, whether it is all there, and elements of the array before it (0 for delimited text).
_RECORD = "source string, number bigint, block bigint, whole boolean, before bigint, text string"


_CUT = pa.schema([("source", pa.string()), ("number", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("before", pa.int64()), ("text", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CUT)], schema=_CUT)


def _pieces(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("piece")
    )


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Batches cut where the split changes, with (source, block, and what else is known of the split)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        source, block = batch.column("source").to_numpy(zero_copy_only=False), batch.column("block").to_numpy()
        edges = np.flatnonzero((source[1:] != source[:-1]) | (block[1:] != block[:-1])) + 1
        for begin, end in zip([0, *edges], [*edges, batch.num_rows]):
            part = batch.slice(begin, end - begin)
            yield tuple(part.column(i)[0].as_py() for i, n in enumerate(part.schema.names) if n != "piece"), part


def _known(pieces: DataFrame, splits: DataFrame) -> DataFrame:
    """Pieces with what is known of their split; a row a split is broadcast, which keeps the pieces in order."""
    met = pieces.join(F.broadcast(splits), ["source", "block"], "left")
    lost = F.raise_error(F.lit("a file was split in another way than when its splits were surveyed"))
    return met.withColumn("number", F.coalesce("number", lost.cast("bigint")))


def _joined(records: Callable[[DataFrame], DataFrame], pieces: DataFrame, splits: DataFrame, glue: str) -> DataFrame:
    """(source, number, before, text): whole records, and those whose parts lie in several splits."""
    whole = records(_known(pieces, splits.drop("crossed"))).where("whole").select("source", "number", "before", "text")
    crossed = splits.where("crossed")
    if crossed.isEmpty():
        return whole
    some = pieces.join(F.broadcast(crossed.select("source", "block")), ["source", "block"], "left_semi")
    parts = records(_known(some, splits.drop("crossed"))).where("NOT whole")
    ordered = F.array_sort(F.collect_list(F.struct("block", "text")))
    joined = parts.groupBy("source", "number").agg(F.min("before").alias("before"), F.array_join(F.transform(ordered, lambda p: p["text"]), glue).alias("text"))
    return whole.unionAll(joined)


# ---- delimited text ------------------------------------------------------------------


def open_after(line: str, sep: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line; a quote opens a field only at its beginning."""
    at = 0
    while True:
        if inside:
            quote = line.find('"', at)
            while quote >= 0 and line[quote + 1 : quote + 2] == '"':
                quote = line.find('"', quote + 2)
            if quote < 0:
                return True
            at = line.find(sep, quote + 1)
            if at < 0:
                return False
            at, inside = at + len(sep), False
        if line[at : at + 1] == '"':
            at, inside = at + 1, True
            continue
        at = line.find(sep + '"', at)
        if at < 0:
            return False
        at += len(sep)


def _states(part: pa.RecordBatch, sep: str, inside: bool) -> np.ndarray:
    """Whether each line begins inside quotes, and one entry more for the line after."""
    lines = part.column("piece")
    out = np.empty(len(lines) + 1, bool)
    at = 0
    for i in np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)):
        out[at : i + 1] = inside
        inside, at = open_after(lines[int(i)].as_py(), sep, inside), i + 1
    out[at:] = inside
    return out


def _filled(part: pa.RecordBatch) -> np.ndarray:
    return pc.invert(pc.is_in(part.column("piece"), pa.array(["", "\r"]))).to_numpy(zero_copy_only=False)


def _survey_delimited(sep: str):
    def run(batches):
        split, held = None, None
        for key, part in _runs(batches):
            if key != split:
                if split:
                    yield held
                split, held = key, {"source": key[0], "block": key[1], "ends": [False, True], "records": [0, 0]}
            filled = _filled(part)
            for begin in (0, 1):
                states = _states(part, sep, held["ends"][begin])
                held["ends"][begin] = bool(states[-1])
                held["records"][begin] += int((filled & ~states[:-1]).sum())
        if split:
            yield held

    return lambda batches: (pa.RecordBatch.from_pylist([row], schema=_DELIMITED_SPLIT) for row in run(batches))


_DELIMITED_SPLIT = pa.schema([("source", pa.string()), ("block", pa.int64()), ("ends", pa.list_(pa.bool_())), ("records", pa.list_(pa.int64()))])


def _fold_delimited(splits: pd.DataFrame) -> pd.DataFrame:
    """Splits of one file with the state they begin in and the number of records before."""
    inside, number, rows = False, 0, []
    for r in splits.sort_values("block").itertuples():
        ends = bool(r.ends[int(inside)])
        rows.append((r.source, r.block, inside, number, inside or ends))
        inside, number = ends, number + int(r.records[int(inside)])
    return pd.DataFrame(rows, columns=["source", "block", "inside", "number", "crossed"])


def _surveyed_delimited(pieces: DataFrame, sep: str) -> DataFrame:
    return checkpointed(pieces.mapInArrow(_survey_delimited(sep), f"{_SPLIT}, ends array<boolean>, records array<bigint>"))


def _cut_delimited(sep: str):
    """Records of each split; what is left at either edge is not whole."""

    def run(batches):
        split, inside, number, begun = None, False, 0, []
        first = False  # what is begun came from the split before

        def record(whole: bool) -> tuple:
            return (split[0], number, split[1], whole, 0, "\n".join(begun))

        for key, part in _runs(batches):
            rows = []
            if key[:2] != split:
                if begun:
                    rows.append(record(False))
                split, inside, number = key[:2], key[2], key[3]
                begun, first = [], inside
            states, filled = _states(part, sep, inside), _filled(part)
            lines = part.column("piece").to_pylist()
            for i, line in enumerate(lines):
                if not states[i]:
                    if not filled[i]:
                        continue
                    number += 1
                begun.append(line)
                if not states[i + 1]:
                    rows.append(record(not first))
                    begun, first = [], False
            inside = bool(states[-1])
            if rows:
                yield _batch(rows)
        if begun:
            yield _batch([record(False)])

    return run


def delimited_records(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """(source, number, text) of the records of delimited files, numbered from 1 in each, the header being the first.

    Records end at a newline outside quotes; a quote is doubled inside a quoted field. Blank lines are no records. The closing \\r of a record is dropped.
    """
    pieces = _pieces(spark, path, "\n")
    folded = _surveyed_delimited(pieces, sep).groupBy("source").applyInPandas(_fold_delimited, f"{_SPLIT}, inside boolean, number bigint, crossed boolean")
    splits = checkpointed(folded)
    cut = _joined(lambda p: p.select("source", "block", "inside", "number", "piece").mapInArrow(_cut_delimited(sep), _RECORD), pieces, splits, "\n")
    return cut.select("source", "number", F.regexp_replace("text", r"\r\z", "").alias("text"))


def count_delimited(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """(source, n): records of each file without its header, counted without cutting them."""

    def total(splits: pd.DataFrame) -> pd.DataFrame:
        folded = _fold_delimited(splits)
        last, inside = splits.sort_values("block").iloc[-1], folded["inside"].iloc[-1]
        return pd.DataFrame({"source": [last["source"]], "n": [max(0, folded["number"].iloc[-1] + last["records"][int(inside)] - 1)]})

    return _surveyed_delimited(_pieces(spark, path, "\n"), sep).groupBy("source").applyInPandas(total, "source string, n bigint")


# ---- JSON arrays -----------------------------------------------------------------------

_STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_CLOSING = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\Z)|[\[\]{},]', re.S)
_OPEN, _CLOSE = "[{", "]}"
_BLANK = "\ufeff \t\r\n"


def _outside(piece: str, inside: bool) -> tuple[str, bool]:
    """A piece without its strings, and whether one is open at its end."""
    if inside:
        closing = _CLOSING.match(piece)
        if not closing:
            return "", True
        piece = piece[closing.end() :]
    bare = _STRING.sub("", piece)
    quote = bare.find('"')
    return (bare, False) if quote < 0 else (bare[:quote], True)


def _rise(bare: str) -> int:
    return bare.count("{") + bare.count("[") - bare.count("]")


def _survey_json(batches):
    """What each split does to (inside a string, depth), for both states it may begin in, and its first character."""

    def rows():
        split, held = None, None
        for key, part in _runs(batches):
            if key != split:
                if split:
                    yield held
                split, held = key, {"source": key[0], "block": key[1], "ends": [False, True], "rises": [0, 0], "opens": ""}
            for piece in part.column("piece").to_pylist():
                held["opens"] = held["opens"] or piece.lstrip(_BLANK)[:1]
                for begin in (0, 1):
                    bare, inside = _outside(piece, held["ends"][begin])
                    held["ends"][begin] = inside
                    held["rises"][begin] += _rise(bare) - (not inside)
        if split:
            yield held

    schema = pa.schema([("source", pa.string()), ("block", pa.int64()), ("ends", pa.list_(pa.bool_())), ("rises", pa.list_(pa.int64())), ("opens", pa.string())])
    for row in rows():
        yield pa.RecordBatch.from_pylist([row], schema=schema)


def _fold_json(splits: pd.DataFrame) -> pd.DataFrame:
    """Splits of one file with the state they begin in; a file that is an array must close it, the brace behind its last piece is not there."""
    inside, depth, rows, splits = False, 0, [], splits.sort_values("block")
    array = "".join(splits["opens"])[:1] == "["
    for r in splits.itertuples():
        rows.append((r.source, r.block, inside, depth, array))
        inside, depth = bool(r.ends[int(inside)]), depth + int(r.rises[int(inside)])
    if array and (inside or depth != -1):
        raise ValueError(f"{rows[0][0]}: malformed JSON array")
    return pd.DataFrame(rows, columns=["source", "block", "inside", "depth", "array"])


def _commas(piece: str, inside: bool, depth: int) -> int:
    """Commas between the elements of the outermost array."""
    if inside:
        closing = _CLOSING.match(piece)
        piece = piece[closing.end() :] if closing else ""
    found = 0
    for token in _TOKEN.finditer(piece):
        t = token[0]
        if t in _OPEN:
            depth += 1
        elif t in _CLOSE:
            depth -= 1
        elif t == "," and depth == 1:
            found += 1
    return found


def _walk(batches) -> Iterator[tuple]:
    """(split, piece, inside before, depth before, depth after with its brace, ended a string) of every piece of an array."""
    split, inside, depth = None, False, 0
    for key, part in _runs(batches):
        if key[:2] != split:
            split, inside, depth = key[:2], key[2], key[3]
        for piece in part.column("piece").to_pylist():
            bare, after = _outside(piece, inside)
            then = depth + _rise(bare)
            last = not after and then == 0
            then -= not after and not last
            yield key, piece, inside, depth, then, after, last
            inside, depth = after, then


def _count_json(batches):
    """Commas between elements, objects that end, and whether there is any element, of each split."""
    schema = pa.schema([("source", pa.string()), ("block", pa.int64()), ("commas", pa.int64()), ("objects", pa.int64()), ("any", pa.bool_())])
    held = None
    for key, piece, inside, depth, then, after, last in _walk(batches):
        if held is None or (held["source"], held["block"]) != key[:2]:
            if held:
                yield pa.RecordBatch.from_pylist([held], schema=schema)
            held = {"source": key[0], "block": key[1], "commas": 0, "objects": 0, "any": False}
        if depth <= 1 or depth - piece.count("]") <= 1:
            held["commas"] += _commas(piece, inside, depth)
        held["objects"] += then == 1 and not after and not last
        held["any"] = held["any"] or inside or depth > 1 or bool(piece.strip(_BLANK).removeprefix("[" if not depth else "").strip(" \t\r\n").removesuffix("]" if last else "").strip(" \t\r\n"))
    if held:
        yield pa.RecordBatch.from_pylist([held], schema=schema)


def _number_json(splits: pd.DataFrame) -> pd.DataFrame:
    commas, objects, rows, splits = 0, 0, [], splits.sort_values("block")
    for n, r in enumerate(splits.itertuples()):
        rows.append((r.source, r.block, r.inside, r.depth, commas, objects, len(splits) > 1))
        commas, objects = commas + int(r.commas), objects + int(r.objects)
    return pd.DataFrame(rows, columns=["source", "block", "inside", "depth", "commas", "number", "crossed"])


def _cut_json(batches):
    """Regions of an array: from the end of one object among its elements to the end of the next."""
    split, number, commas, before, begun, first = None, 0, 0, 0, [], False
    rows, size = [], 0
    for key, piece, inside, depth, then, after, last in _walk(batches):
        if key[:2] != split:
            if begun:
                rows.append((split[0], number, split[1], False, before, "".join(begun)))
            split, number, commas, begun, first = key[:2], key[4], key[5], [], key[1] > 0
            before = commas
        begun.append(piece if last else piece + "}")
        size += len(piece)
        if depth <= 1 or depth - piece.count("]") <= 1:
            commas += _commas(piece, inside, depth)
        if then == 1 and not after and not last:
            rows.append((split[0], number, split[1], not first, before, "".join(begun)))
            number, before, begun, first = number + 1, commas, [], False
        if size > 1 << 22 and rows:
            yield _batch(rows)
            rows, size = [], 0
    if begun:
        rows.append((split[0], number, split[1], False, before, "".join(begun)))
    if rows:
        yield _batch(rows)


def _elements(batches):
    """Regions to (source, line_no, line): the object in each, as written."""
    schema = pa.schema([("source", pa.string()), ("line_no", pa.int64()), ("line", pa.string())])
    for batch in batches:
        rows = []
        for source, number, before, text in zip(*(batch.column(c).to_pylist() for c in ("source", "number", "before", "text"))):
            depth = int(number > 0)
            for token in _TOKEN.finditer(text):
                t = token[0]
                if t == "{" and depth == 1:
                    rows.append((source, before + 1, text[token.start() :]))
                    break
                before += t == "," and depth == 1
                depth += (t in _OPEN) - (t in _CLOSE)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _surveyed_json(pieces: DataFrame) -> DataFrame:
    surveyed = checkpointed(pieces.mapInArrow(_survey_json, f"{_SPLIT}, ends array<boolean>, rises array<bigint>, opens string"))
    return checkpointed(surveyed.groupBy("source").applyInPandas(_fold_json, f"{_SPLIT}, inside boolean, depth bigint, array boolean"))


def _counted_json(pieces: DataFrame, splits: DataFrame) -> DataFrame:
    known = pieces.join(F.broadcast(splits.where("array").drop("array")), ["source", "block"]).select("source", "block", "inside", "depth", "piece")
    counts = known.mapInArrow(_count_json, f"{_SPLIT}, commas bigint, objects bigint, any boolean")
    return checkpointed(counts.join(splits, ["source", "block"]))


def json_array_objects(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, list[str]]:
    """(source, line_no, line) of the objects in files that hold one JSON array, and the files that hold something else.

    Objects are given as written, so their keys keep their order; ``line_no`` is the place among all elements. An array that is not closed is an error.
    """
    pieces = _pieces(spark, path, "}")
    splits = _surveyed_json(pieces)
    others = [r.source for r in splits.where("NOT array").select("source").distinct().collect()]
    counted = _counted_json(pieces, splits)
    numbered = checkpointed(counted.groupBy("source").applyInPandas(_number_json, f"{_SPLIT}, inside boolean, depth bigint, commas bigint, number bigint, crossed boolean"))
    arrays = pieces.join(F.broadcast(numbered.select("source").distinct()), "source", "left_semi")

    def regions(known: DataFrame) -> DataFrame:
        return known.select("source", "block", "inside", "depth", "number", "commas", "piece").mapInArrow(_cut_json, _RECORD)

    return _joined(regions, arrays, numbered, "").mapInArrow(_elements, "source string, line_no bigint, line string"), others


def count_json_arrays(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, list[str]]:
    """(source, n) of the elements of each file that holds one JSON array, without parsing a value, and the files that hold something else."""
    pieces = _pieces(spark, path, "}")
    splits = _surveyed_json(pieces)
    others = [r.source for r in splits.where("NOT array").select("source").distinct().collect()]
    counted = _counted_json(pieces, splits)
    return counted.groupBy("source").agg((F.sum("commas") + F.max(F.col("any").cast("int"))).cast("bigint").alias("n")), others
