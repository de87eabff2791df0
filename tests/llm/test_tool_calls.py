"""Levels of call chains and graphs against a plain peel, and JSON that must not stop a job."""

import random

from loomstone.llm import tool_calls
from loomstone.llm.common import Scratch

CALLS = "conv string, call string, depends_on array<string>"


def brute_levels(calls):
    known = {(c, k) for c, k, _ in calls}
    waits = {(c, k): {(c, d) for d in deps if d and d != k and (c, d) in known} for c, k, deps in calls}
    levels = {}
    while True:
        free = [k for k, w in waits.items() if k not in levels and all(d in levels for d in w)]
        if not free:
            return {k: levels.get(k) for k in waits}
        levels |= {k: 1 + max((levels[d] for d in waits[k]), default=-1) for k in free}


def levels_of(spark, calls):
    df = spark.createDataFrame(calls, CALLS)
    return {(r.conv, r.call): r.level for r in tool_calls.dependency_levels(df, Scratch(spark, "levels")).collect()}


def test_levels_of_random_graphs_with_chains_and_cycles(spark):
    rng = random.Random(1)
    calls = []
    for conv in range(40):
        n = rng.randint(1, 12)
        for k in range(n):
            others = [f"c{rng.randrange(n)}" for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]
            earlier = [f"c{rng.randrange(k)}" for _ in others if k]
            calls.append((str(conv), f"c{k}", rng.choice([others, earlier, earlier, [*earlier, "gone", None]])))
    assert levels_of(spark, calls) == brute_levels(calls)


def test_a_long_chain_takes_rounds_like_its_logarithm(spark, monkeypatch):
    kept = []
    real = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: kept.append(name) or real(self, df, name))
    calls = [("a", f"c{i}", [f"c{i - 1}"] if i else []) for i in range(1000)] + [("b", "x", ["y"]), ("b", "y", ["x"]), ("b", "z", ["x"])]
    assert levels_of(spark, calls) == {("a", f"c{i}"): i for i in range(1000)} | {("b", k): None for k in "xyz"}
    assert sum(name.startswith("chain") for name in kept) <= 14


def test_chains_between_calls_of_several_dependencies(spark):
    calls = [("a", "s", [])] + [("a", f"l{i}", [f"l{i - 1}" if i else "s"]) for i in range(20)] + [("a", f"r{i}", [f"r{i - 1}" if i else "s"]) for i in range(5)]
    calls += [("a", "join", ["l19", "r4"]), ("a", "after", ["join"]), ("a", "last", ["after", "s", "join"])]
    assert levels_of(spark, calls) == brute_levels(calls)


def linked(spark, arguments, schema):
    calls = spark.createDataFrame([("a", f"c{i}", (1, i), "tool", text, []) for i, text in enumerate(arguments)], "conv string, call string, position struct<turn:bigint,place:int>, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([], "conv string, call string, at bigint, content string")
    rows = tool_calls.link(calls, results, spark.createDataFrame([("tool", schema)], "name string, schema string"), Scratch(spark, "calls")).collect()
    return {r.call: (r.errors, r.canonical) for r in rows}


def test_json_that_is_odd_but_must_not_stop_the_job(spark):
    got = linked(spark, ['{"q":"\\ud800"}', '{"n":1e999}', '{"n":' + "7" * 5000 + "}", '{"n":1.0,"m":1e2}', '{"n":NaN}'], '{"properties":{"q":{"type":"string"}}}')
    assert got["c0"][0] == "" and '"\\ud800"' in got["c0"][1]
    assert got["c1"][0] == "$: not JSON" and "Infinity" not in got["c1"][1]
    assert got["c2"][0] == "" and "7" * 5000 in got["c2"][1]
    assert '{"m":100,"n":1}' in got["c3"][1] and got["c4"][0] == "$: not JSON"
    for schema in ('{"pattern":"("}', '{"properties":{"q":{"minLength":"2"}}}', '{"required":5}', '{"multipleOf":0}', '{"type":7}', '{"properties":[]}'):
        errors = {v[0] for v in linked(spark, ['{"q":"x"}', '"y"', "3"], schema).values()}
        assert errors <= {"", "$: schema is not usable"}


def test_schema_keywords():
    bad = tool_calls.violations
    assert bad(True, {"enum": [1]}) and bad(1, {"const": True}) and not bad(1.0, {"enum": [1]}) and bad([True], {"const": [1]})
    assert not bad(3, {"anyOf": [{"type": "string"}, {"minimum": 3}]}) and bad(2, {"anyOf": [{"type": "string"}, {"minimum": 3}]})
    assert bad(3, {"oneOf": [{"minimum": 1}, {"minimum": 2}]}) and bad(3, {"not": {"type": "integer"}}) and bad("x", {"allOf": [{"minLength": 1}, {"maxLength": 0}]})
    assert bad(3, {"exclusiveMinimum": 3}) and bad(3, {"exclusiveMaximum": 3}) and bad(3, {"multipleOf": 2}) and not bad(4, {"multipleOf": 2})
    assert bad({}, {"$ref": "#/x"}) == ["$: $ref is not supported"]
