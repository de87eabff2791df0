import json
import random

import pytest
from pyspark.sql import Window, functions as F

from loomstone.functions import logs
from loomstone.operators import scan, telemetry as op
from loomstone.streaming import runs


@pytest.mark.parametrize("levels", [0, 1, 2])
@pytest.mark.parametrize("exclusive", [False, True])
@pytest.mark.parametrize("by", [["k"], []])
def test_running_equals_the_plain_window(spark, levels, exclusive, by):
    rng = random.Random(levels)
    rows = [(rng.choice("aaab"), i * 3, rng.choice([None, 1, 5, -2, 7])) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(6)
    aggs = {"s": ("sum", "v"), "c": ("count", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "prev": ("last", "v")}
    got = scan.running(df, by, ["o"], F.expr("o div 50"), aggs, exclusive, levels=levels, fan_out=4)
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("o").rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    plain = df.select(
        "k", "o", "v",
        F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.count("v").over(w).alias("c"), F.min("v").over(w).alias("lo"),
        F.max("v").over(w).alias("hi"), F.last("v", ignorenulls=True).over(w).alias("prev"),
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("k", [1, 10, 1000])
def test_last_k(spark, k):
    df = spark.createDataFrame([("ab"[i % 3 == 0], i) for i in range(300)], "k string, o long")
    got = scan.last_k(df, ["k"], ["o"], F.expr("o div 16"), k)
    w = Window.partitionBy("k").orderBy(F.desc("o"))
    plain = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def events(spark, lines):
    df = spark.createDataFrame([(1, i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(lines)], "run int, seq long, line string")
    return op.parse_lines(df)


def test_lines_and_state(spark):
    lines = [
        {"event": "init", "device": "cuda", "params": 5},
        "{broken",
        "plain",
        {"event": "step", "step": 10, "total": 100, "loss": 2.5, "lr": 0.1, "tok_s": 7.0},
        {"event": "eval", "step": 10, "val_loss": 2.0, "best_val_loss": 2.0},
        {"event": "step", "step": 20, "total": 100, "loss": 1.5, "lr": 0.1, "tok_s": 8.0},
        {"event": "done", "step": 20, "elapsed": 3.0, "path": "p", "final_val_loss": 1.9, "best_val_loss": 1.8, "params": 5},
    ]
    ev = events(spark, lines)
    assert [r.ev is None for r in ev.orderBy("seq").collect()] == [False, True, True, False, False, False, False]
    state = op.latest_state(ev, "run", "seq").first()
    assert (state.current_step, state.loss, state.val_loss, state.device, state.total_params, state.running) == (20, 1.5, 2.0, "cuda", 5, False)
    record = op.run_records(ev, "run", "seq").first()
    assert (record.steps, record.final_loss, record.device, record.checkpoint_path, record.final_val_loss) == (20, 1.5, "cuda", "p", 1.9)


def test_best_and_health(spark):
    ev = events(spark, [{"event": "eval", "step": i, "val_loss": v} for i, v in enumerate([2.0, 1.5, 1.6, 1.2])])
    rows = op.best_validation(ev, "run", "seq").orderBy("seq").collect()
    assert [r.best_val_loss for r in rows] == [2.0, 1.5, 1.5, 1.2] and [r.healthy for r in rows] == [True, True, False, True]


def test_curve_scaling_of_a_flat_curve(spark):
    ev = events(spark, [{"event": "step", "step": 5, "loss": 1.0}, {"event": "step", "step": 5, "loss": 1.0}])
    curves = op.loss_curves(ev, "run", "seq")
    assert curves.count() == 1
    assert tuple(op.scaled_curves(curves, "run").select("x", "y").first()) == (0.0, 0.0)


def text_row(spark, line, column):
    return spark.createDataFrame([(line,)], "line string").select(column.alias("x")).first()["x"]


def test_log_metrics(spark):
    line = "{'loss': 1.25, 'epoch': 1.5}"
    assert text_row(spark, line, logs.logged_loss(F.col("line"))) == 1.25
    assert text_row(spark, line, logs.progress(F.col("line"), 3)) == 47
    assert text_row(spark, "EXPORT_DONE", logs.progress(F.col("line"), 3)) == 100
    assert text_row(spark, "{'loss': 1, 'epoch': 9}", logs.progress(F.col("line"), 3)) == 95


@pytest.mark.parametrize("line,kind", [("CUDA out of memory", "oom"), ("401 Client Error: Unauthorized", "auth"), ("GatedRepoError 401 token", "gated"), ("fine 401", None)])
def test_error_class(spark, line, kind):
    assert text_row(spark, line, logs.error_class(F.col("line"))) == kind


@pytest.mark.parametrize("line,tag", [("STEP: WARN x", "warn"), ("STEP: ERROR", "error"), ("STEP: x", "step"), ("x", ""), ("❌", "error")])
def test_severity(spark, line, tag):
    assert text_row(spark, line, logs.severity(F.col("line"))) == tag


def test_train_meta(spark):
    assert tuple(text_row(spark, 'x TRAIN_META: {"loss": 0.5, "total_steps": 3}', logs.train_meta(F.col("line"))))[:2] == (0.5, 3)


@pytest.mark.parametrize("n,kept", [(500, 500), (501, 300), (701, 500), (702, 300)])
def test_kept_lines_follow_the_sawtooth(spark, n, kept):
    size = 0
    for _ in range(n):
        size += 1
        if size > 500:
            size = 300
    assert size == kept == spark.range(1).select(op.kept_lines(F.lit(n))).first()[0]


def test_checkpoints(spark):
    schema = "run int, ord long, name string, log_history array<struct<loss:double,train_loss:double,epoch:double>>"
    rows = [
        (1, 1, "step_000500.pt", []),
        (1, 2, "step_000500_final.pt", [(1.0, None, 0.5), (None, 2.0, 1.0)]),
        (1, 3, "checkpoint-70", [(0.0, 3.0, 1.5)]),
        (1, 4, "checkpoint-x", [(0.7, None, None)]),
    ]
    manifest = spark.createDataFrame(rows, schema)
    got = {r.name: (r.step, r.is_final, r.loss, r.epoch) for r in op.checkpoints(manifest).collect()}
    assert got == {
        "step_000500.pt": (500, False, None, None), "step_000500_final.pt": (500, True, 2.0, 1.0),
        "checkpoint-70": (70, False, 3.0, 1.5), "checkpoint-x": (0, False, 0.7, None),
    }
    assert op.latest_checkpoint(manifest.where("ord < 3"), "run").first()["name"] == "step_000500_final.pt"


@pytest.mark.parametrize("n,picked", [(10, [0, 2, 4, 6]), (4, [0, 1, 2, 3]), (1, [0]), (5, [0, 1, 2, 3]), (11, [0, 2, 4, 6])])
def test_even_pick(spark, n, picked):
    rows = spark.range(n).select(F.lit(1).alias("run"), F.col("id").alias("ord"))
    assert sorted(r.ord for r in op.evenly_spaced(rows, "run", "ord").collect()) == picked


def test_run_state_stream_in_many_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runs, "COMPACT_EVERY", 2)
    rng = random.Random(4)
    rows = []
    for i in range(300):
        kind = rng.choice(["step", "eval", "init"] + (["done"] if i > 280 else []))
        event = {"event": kind, "step": i, "total": 9, "loss": rng.random(), "val_loss": rng.random(), "device": f"d{i}"}
        rows.append((rng.randrange(5), i, json.dumps(event)))
    schema = "run int, seq long, line string"
    for n in range(0, 300, 50):
        spark.createDataFrame(rows[n : n + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    runs.run_to_versions(runs.run_state_stream(stream, "run", "seq"), out, str(tmp_path / "checkpoint"))
    batch = op.latest_state(op.parse_lines(spark.createDataFrame(rows, schema)), "run", "seq")
    assert sorted(map(tuple, runs.current_states(spark, out, "run").collect())) == sorted(map(tuple, batch.collect()))
    # Six batches: two bases stay, and the changes of the batches after the older one.
    assert sorted(p.name for p in (tmp_path / "out" / "base").iterdir()) == ["batch=3", "batch=5"]
    assert sorted(p.name for p in (tmp_path / "out" / "changes").iterdir()) == ["batch=4", "batch=5"]
