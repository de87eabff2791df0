"""Linking tool calls with their results in chat messages.

Calls and results are read from messages, joined by conversation and call id, ordered by their
dependencies, validated against the argument schema of their tool, and written as canonical JSON (sorted
keys, no spaces, no escaped letters). Everything but validation and serialisation is joins and aggregates in rounds
that read files of the round before, so no conversation has to fit in a task.
"""

from __future__ import annotations

import json
import re
import sys

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.scan import running
from .common import Scratch

CALLS = "struct<tool_calls: array<struct<id: string, function: struct<name: string, arguments: string>, depends_on: array<string>>>>"
RESULT = "struct<tool_call_id: string, content: string>"
# The JSON reader turns a whole record null at a text above 20,000,000 characters unless told otherwise.
ANY_LENGTH = {"maxStringLen": "2147483647"}


def parse_messages(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Calls (conv, call, position, name, arguments, depends_on) and results (conv, call, at, content).

    Assistant messages hold ``{"tool_calls": [{"id", "function": {"name", "arguments"}, "depends_on"}]}``, tool messages
    ``{"tool_call_id", "content"}``; arguments may be JSON text or an object. Messages that are no such JSON hold no calls.
    A call's position is its turn and its place in the message.
    """
    base = messages.select(
        F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).cast("bigint").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")
    )
    calls = (
        base.where("role = 'assistant'")
        .select("conv", "turn", F.posexplode(F.from_json("text", CALLS, ANY_LENGTH)["tool_calls"]).alias("place", "c"))
        .where("c IS NOT NULL")
        .select(
            "conv", F.col("c.id").alias("call"), F.struct("turn", "place").alias("position"), F.col("c.function.name").alias("name"),
            F.col("c.function.arguments").alias("arguments"), F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"),
        )
    )
    results = base.where("role = 'tool'").withColumn("r", F.from_json("text", RESULT, ANY_LENGTH)).where("r.tool_call_id IS NOT NULL OR r.content IS NOT NULL").select(
        "conv", F.col("r.tool_call_id").alias("call"), F.col("turn").alias("at"), F.col("r.content").alias("content")
    )
    return calls, results


def _chains(single: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, call, target, dist, open): where the chain of a call with one dependency ends, and how many calls before.

    Pointer doubling: every round a call takes over the pointer of the call it points at, so chains of n calls
    take log2(n) rounds. A chain that ends points at a call without, or with several, dependencies; what is
    still open when a round closes none lies on a cycle, or behind one.
    """
    jump, still, step = scratch.keep(single.select("conv", "call", F.col("dep").alias("target"), F.lit(1).cast("bigint").alias("dist")), "chain-0"), None, 0
    while True:
        step += 1
        onward = jump.select("conv", F.col("call").alias("target"), F.col("target").alias("next"), F.col("dist").alias("more"))
        moved = jump.select("conv", "call", "target", "dist").join(onward, ["conv", "target"], "left").select(
            "conv", "call", F.coalesce("next", "target").alias("target"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"), F.col("next").isNotNull().alias("open")
        )
        jump = scratch.keep(moved, f"chain-{step}")
        scratch.drop(f"chain-{step - 1}")
        before, still = still, jump.where("open").count()
        if still in (0, before):
            return jump


def _peel(edges: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, call, level) of the calls with several dependencies, those first whose targets all have levels.

    A round reads the calls still waiting and the levels found last, both from files, so plans stay the same size; levels are gathered in one folder.
    """
    edges = scratch.keep(edges, "edges")
    state = scratch.keep(edges.groupBy("conv", "call").agg(F.count("*").alias("need"), F.lit(0).cast("bigint").alias("best")), "state-0")
    front, found, step = roots, f"{scratch.root}/levels", 0
    while True:
        step += 1
        reached = edges.join(front.select("conv", F.col("call").alias("target"), "level"), ["conv", "target"])
        hits = reached.groupBy("conv", "call").agg(F.count("*").alias("got"), F.max(F.col("level") + F.col("weight")).alias("high"))
        state = scratch.keep(
            state.where("need > 0").join(hits, ["conv", "call"], "left").select(
                "conv", "call", (F.col("need") - F.coalesce("got", F.lit(0))).alias("need"), F.greatest("best", F.coalesce("high", F.lit(0))).alias("best")
            ),
            f"state-{step}",
        )
        scratch.drop(f"state-{step - 1}")
        fresh = state.where("need = 0").select("conv", "call", F.col("best").alias("level"))
        fresh.write.parquet(f"{found}/round={step}")
        front = scratch.spark.read.schema("conv string, call string, level bigint").parquet(f"{found}/round={step}")
        if front.isEmpty():
            return scratch.spark.read.schema("conv string, call string, level bigint").parquet(found).select("conv", "call", "level")


def dependency_levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, call, level, missing): 0 for calls that wait for none, else one more than the highest they wait for.

    Chains of calls with one dependency each are contracted first, in as many rounds as the logarithm of the longest; calls with several
    are then peeled off round by round on what is left, as many rounds as one has such calls behind another. A call on a cycle, or behind
    one, has a null level. Dependencies on unknown calls, and on the call itself when named by mistake, are left out; ``missing`` counts the unknown ones.
    """
    known = calls.select("conv", "call")
    wanted = calls.select("conv", "call", F.explode("depends_on").alias("dep")).where("dep IS NOT NULL AND dep <> call").distinct()
    have = known.select("conv", F.col("call").alias("dep"), F.lit(1).alias("there"))
    wanted = scratch.keep(wanted.join(have, ["conv", "dep"], "left"), "wanted")
    missing = wanted.where("there IS NULL").groupBy("conv", "call").agg(F.count("*").alias("missing"))
    edges = wanted.where("there = 1").select("conv", "call", "dep")
    degree = scratch.keep(edges.groupBy("conv", "call").agg(F.count("*").alias("n"), F.min("dep").alias("dep")), "degree")
    chains = _chains(degree.where("n = 1"), scratch)
    levels = scratch.keep(known.join(degree.select("conv", "call"), ["conv", "call"], "left_anti").withColumn("level", F.lit(0).cast("bigint")), "roots")
    several = degree.where("n > 1").select("conv", "call")
    if not several.isEmpty():
        end = chains.select("conv", F.col("call").alias("dep"), F.when(~F.col("open"), F.col("target")).alias("end"), "dist", F.lit(True).alias("chained"))
        ends = edges.join(several, ["conv", "call"]).join(end, ["conv", "dep"], "left").select(
            "conv", "call", F.when(F.col("chained"), F.col("end")).otherwise(F.col("dep")).alias("target"), (F.coalesce("dist", F.lit(0)) + 1).alias("weight")
        )
        levels = levels.unionAll(_peel(ends, levels, scratch))
    at_end = levels.select("conv", F.col("call").alias("target"), "level")
    chained = chains.where("NOT open").join(at_end, ["conv", "target"]).select("conv", "call", (F.col("level") + F.col("dist")).alias("level"))
    return known.join(levels.unionAll(chained), ["conv", "call"], "left").join(missing, ["conv", "call"], "left").select(
        "conv", "call", F.col("level").cast("int").alias("level"), F.coalesce("missing", F.lit(0)).alias("missing")
    )


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _KINDS.get(kind, ()))


def _same(a, b) -> bool:
    """Equal as JSON values: numbers by value, but true is no 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    return a == b


def _outside(value, schema) -> bool:
    step = schema.get("multipleOf")
    return (
        value < schema.get("minimum", value) or value > schema.get("maximum", value) or "exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]
        or "exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"] or step is not None and bool(value % step)
    )


def violations(value, schema, path: str = "$") -> list[str]:
    """What of a JSON schema ``value`` breaks.

    Keywords: type, enum, const, anyOf, allOf, oneOf, not; properties, required, additionalProperties; items, minItems,
    maxItems; minLength, maxLength, pattern; minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf. ``$ref`` is reported as unsupported; others are
    annotations here. A schema whose keywords have values of a wrong kind raises, see ``checked``.
    """
    if schema is True or not isinstance(schema, dict):
        return [f"{path}: not allowed"] if schema is False else []
    if "$ref" in schema:
        return [f"{path}: $ref is not supported"]
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{path}: not {' or '.join(kinds)}"]
    bad = []
    if "enum" in schema and not any(_same(value, v) for v in schema["enum"]):
        bad.append(f"{path}: not in enum")
    if "const" in schema and not _same(value, schema["const"]):
        bad.append(f"{path}: not const")
    for part in schema.get("allOf", ()):
        bad += violations(value, part, path)
    if "anyOf" in schema and all(violations(value, part, path) for part in schema["anyOf"]):
        bad.append(f"{path}: none of anyOf")
    if "oneOf" in schema and sum(not violations(value, part, path) for part in schema["oneOf"]) != 1:
        bad.append(f"{path}: not one of oneOf")
    if "not" in schema and not violations(value, schema["not"], path):
        bad.append(f"{path}: not allowed")
    if isinstance(value, dict):
        fields = schema.get("properties", {})
        bad += [f"{path}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in fields:
                bad += violations(value[k], fields[k], f"{path}.{k}")
            else:
                bad += violations(value[k], schema.get("additionalProperties", True), f"{path}.{k}")
    elif isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", len(value)):
            bad.append(f"{path}: number of items")
        for i, item in enumerate(value):
            bad += violations(item, schema.get("items", True), f"{path}[{i}]")
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            bad.append(f"{path}: length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            bad.append(f"{path}: pattern")
    elif _is(value, "number") and _outside(value, schema):
        bad.append(f"{path}: range")
    return bad


def checked(value, schema) -> list[str]:
    """``violations``; a schema that is no schema (a broken pattern, a length that is a text) is one."""
    try:
        return violations(value, schema)
    except (re.error, TypeError, ValueError, AttributeError, ZeroDivisionError, RecursionError):
        return ["$: schema is not usable"]


def _plain(value):
    """Whole numbers written one way, whether 1, 1.0 or 1e0."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() else value


def _text(s: str) -> str:
    """Half a surrogate pair, which no text can hold, as its escape."""
    return s.encode("utf-8", "backslashreplace").decode()


def canonical(value) -> str:
    return _text(json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


# Digits of a whole number that are still read.
MOST_DIGITS = 100_000


def _finite(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError("number out of range")
    return value


def _parsed(text):
    """The value of a JSON text and whether it is one; numbers beyond doubles, or of more than MOST_DIGITS digits, are none."""
    try:
        sys.set_int_max_str_digits(MOST_DIGITS)
        return json.loads(text, parse_constant=lambda c: {}[c], parse_float=_finite), True
    except (ValueError, KeyError, TypeError, RecursionError):
        return text, False


def _finish(batches):
    for batch in batches:
        out = {"errors": [], "canonical": []}
        for row in batch.to_pylist():
            arguments, ok = _parsed(row["arguments"])
            errors = []
            if row["call_there"]:
                if not ok:
                    errors = ["$: not JSON"]
                elif row["schema"] is None:
                    errors = ["$: unknown tool"]
                else:
                    schema, fine = _parsed(row["schema"])
                    errors = checked(arguments, schema) if fine else ["$: schema is not JSON"]
            whole = {"arguments": arguments, "depends_on": sorted(row["depends_on"] or []), "id": row["call"], "name": row["name"], "result": row["content"]}
            out["errors"].append(_text("; ".join(errors)))
            out["canonical"].append(canonical(whole))
        keep = [c for c in batch.schema.names if c not in ("call_there", "schema")]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(out["errors"], pa.string()), pa.array(out["canonical"], pa.string())], names=[*keep, "errors", "canonical"])


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per call and per result without a call.

    Columns: conv, call, turn, level, order_no (place in the conversation's topological order, by level, then position), status
    (``linked``, ``no_result``, ``no_call``), n_results, missing, valid, errors, canonical. ``schemas`` maps name to schema (JSON text).
    The first call of an id in a conversation stands for all with that id, its first result is linked and all are
    counted. Calls and results with a null id or conversation cannot be linked and are left out, as are nothing else; null or broken arguments and
    unknown tools are invalid, calls on cycles have a null level and come last. Empty tables give an empty result; the smallest of
    equal schemas' texts counts.
    """
    calls = scratch.keep(
        calls.where("conv IS NOT NULL AND call IS NOT NULL").groupBy("conv", "call")
        .agg(F.min(F.struct("position", "name", "arguments", "depends_on")).alias("c")).select("conv", "call", "c.*"),
        "calls",
    )
    first = (
        results.where("conv IS NOT NULL AND call IS NOT NULL").groupBy("conv", "call")
        .agg(F.min(F.struct("at", "content")).alias("r"), F.count("*").alias("n_results")).select("conv", "call", "r.*", "n_results")
    )
    tools = schemas.where("name IS NOT NULL").groupBy("name").agg(F.min("schema").alias("schema"))
    inner = Scratch(scratch.spark, "call-levels")
    levels = dependency_levels(calls, inner)
    linked = (
        calls.join(levels, ["conv", "call"], "left").withColumn("call_there", F.lit(True))
        .join(first, ["conv", "call"], "full_outer").join(tools, "name", "left")
    )
    linked = linked.select(
        "conv", "call", F.coalesce("position.turn", "at").alias("turn"), F.coalesce("position.place", F.lit(0)).alias("place"), "level",
        F.when(F.col("call_there").isNull(), "no_call").when(F.col("n_results").isNull(), "no_result").otherwise("linked").alias("status"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"), F.coalesce("missing", F.lit(0)).alias("missing"),
        "name", "arguments", "depends_on", "content", F.coalesce("call_there", F.lit(False)).alias("call_there"), "schema",
    )
    schema = "conv string, call string, turn bigint, place int, level int, status string, n_results bigint, missing bigint, name string, arguments string, depends_on array<string>, content string, errors string, canonical string"
    done = scratch.keep(linked.mapInArrow(_finish, schema).drop("arguments", "depends_on", "content"), "linked")
    inner.drop()
    scratch.drop("calls")
    ordered = running(
        done.withColumn("rank_level", F.coalesce("level", F.lit(1 << 30))).withColumn("one", F.lit(1)), ["conv"], ["rank_level", "turn", "place", "call"],
        F.col("rank_level"), {"order_no": ("count", "one")}, levels=0,
    )
    return ordered.select(
        "conv", "call", "turn", "level", "order_no", "status", "n_results", "missing",
        ((F.col("errors") == "") & (F.col("status") != "no_call")).alias("valid"), "errors", "canonical",
    )
