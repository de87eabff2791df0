import datetime
import random
from collections import defaultdict

import pandas as pd
import pytest

from loomstone.operators import metering as op
from loomstone.streaming import admission

DAY = datetime.datetime(2024, 1, 1)
REQUEST = "event_id long, key_id long, model string, ts timestamp_ntz"
KEYS = "key_id long, active boolean, rpm int, daily_limit int, allowed_models array<string>, expires_at timestamp_ntz"


def at(seconds):
    return DAY + datetime.timedelta(seconds=seconds)


def reference(requests, keys, window):
    """The sequential admission of one process."""
    settings = {k[0]: k for k in keys}
    used, times, out = defaultdict(int), defaultdict(list), {}
    for event, key, model, ts in sorted(requests, key=lambda r: (r[3], r[0])):
        k = settings.get(key)
        if key is None:
            out[event] = "missing"
            continue
        if k is None or k[1] is False:
            out[event] = "invalid"
            continue
        _, _, rpm, limit, allowed, expires = k
        if expires and ts > expires:
            out[event] = "expired"
        elif allowed and model and model not in allowed:
            out[event] = "model"
        elif limit and used[key, ts.date()] >= limit:
            out[event] = "quota"
        else:
            times[key] = [t for t in times[key] if t > ts - datetime.timedelta(seconds=window)]
            if rpm and len(times[key]) >= rpm:
                out[event] = "rpm"
                continue
            times[key].append(ts)
            used[key, ts.date()] += 1
            out[event] = "ok"
    return out


def decisions(df):
    return {r.event_id: r.decision for r in df.collect()}


def test_rolling_window(spark):
    requests = [(i, 1, "m", at(t)) for i, t in enumerate([0, 10, 20, 60, 61, 70])]
    keys = [(1, True, 2, 0, [], None)]
    got = decisions(op.decide(spark.createDataFrame(requests, REQUEST), spark.createDataFrame(keys, KEYS)))
    assert [got[i] for i in range(6)] == ["ok", "ok", "rpm", "ok", "rpm", "ok"]


def test_precedence_and_sharing(spark):
    keys = spark.createDataFrame([(1, True, 0, 1, ["a"], at(50)), (2, False, 0, 0, [], None)], KEYS)
    requests = spark.createDataFrame(
        [(1, 1, "a", at(1)), (2, 1, "a", at(2)), (3, 1, "a", at(60)), (4, 1, "b", at(3)), (5, 1, "", at(4)), (6, 2, "a", at(1)), (7, None, "a", at(1))],
        REQUEST,
    )
    assert decisions(op.decide(requests, keys)) == {
        1: "ok", 2: "quota", 3: "expired", 4: "model", 5: "quota", 6: "invalid", 7: "missing",
    }
    assert set(decisions(op.decide(requests, keys, sharing=False)).values()) == {"sharing_off"}


def random_case(seed, n=900):
    rng = random.Random(seed)
    keys = [
        (1, True, 3, 40, [], None),  # holds a third of all requests, limits bind at midnight
        (2, True, 2, 0, [], None),  # saturated: no quiet stretch at all
        (3, True, 0, 5, [], None),
        (4, True, 0, 0, ["a"], at(100_000)),
        (5, False, 1, 1, [], None),
        (6, True, 1, 3, ["a", "b"], None),
    ]
    requests, clock = [], 80_000
    for i in range(n):
        clock += rng.choice([1, 5, 20, 20, 60, 400])
        key = rng.choice([1, 1, 1, 2, 2, 3, 4, 5, 6, 7, None])
        requests.append((i, key, rng.choice(["a", "b", ""]), at(clock)))
    return requests, keys


@pytest.mark.parametrize("seed,window,slot", [(0, 60, None), (1, 300, 3600), (2, 3600, None), (3, 600, 7200), (4, 172_800, None), (6, 90_000, 43_200)])
def test_batch_decisions_are_the_sequential_ones(spark, seed, window, slot):
    requests, keys = random_case(seed)
    df = spark.createDataFrame(requests, REQUEST).repartition(5)
    decided = op.decide(df, spark.createDataFrame(keys, KEYS), True, window, slot)
    assert decisions(decided) == reference(requests, keys, window)


def test_many_requests_in_many_partitions(spark):
    """Key 1 holds a third of the requests and is never quiet."""
    keys = [(k, True, 5, 0, [], None) for k in range(20)]
    requests = [(i, 1 if i % 3 == 0 else i % 20, "", at(0.9 * i + (i * 7919 % 800) / 1000)) for i in range(24_000)]
    expected = reference(requests, keys, 60)
    df = spark.createDataFrame(requests, REQUEST).repartition(8)
    joined = op.join_keys(df, spark.createDataFrame(keys, KEYS))
    assert decisions(op.rate_and_quota(joined)) == expected


def test_windows_longer_than_the_slots(spark):
    requests, keys = random_case(5, 300)
    joined = op.join_keys(spark.createDataFrame(requests, REQUEST).repartition(4), spark.createDataFrame(keys, KEYS))
    rated = joined.where(op.stateless_reason(joined).isNull()).where("rpm > 0")
    got = decisions(op.rate_and_quota(rated, 5_000, 2_400))
    expected = reference(requests, keys, 5_000)
    assert got and got == {event: expected[event] for event in got}


def test_stream_in_many_batches_is_the_batch_result(spark, tmp_path):
    requests, keys = random_case(9, 400)
    folder = tmp_path / "in"
    for n in range(0, 400, 100):
        part = spark.createDataFrame(requests[n : n + 100], REQUEST).coalesce(1)
        part.write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(str(folder))
    decided = admission.admission_stream(stream, spark.createDataFrame(keys, KEYS), window_seconds=300)
    out = str(tmp_path / "out")
    admission.run_to_table(decided, out, str(tmp_path / "checkpoint"))
    assert decisions(spark.read.parquet(out)) == reference(requests, keys, 300)


class KeyState:
    """The state of one key as the stream hands it to the function."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.duration = None, False, False, None

    def update(self, value):
        self.get, self.exists = value, True

    def remove(self):
        self.get, self.exists = None, False

    def setTimeoutDuration(self, ms):  # noqa: N802
        self.duration = ms


def _arrivals(*rows):
    return iter([pd.DataFrame(rows, columns=["event_id", "us", "day", "rpm", "daily_limit"])])


def test_late_rows_are_judged_as_of_the_clock_and_quiet_keys_are_forgotten():
    decide, state = admission._decide_key(60_000_000, 5000), KeyState()
    s = 1_000_000

    def run(*rows):
        got = next(decide((1,), _arrivals(*rows), state))
        return dict(zip(got["event_id"], got["decision"]))

    assert run((1, 100 * s, "d2", 0, 2), (2, 90 * s, "d1", 0, 2)) == {1: "ok", 2: "ok"}  # in order of time: d1, then d2
    assert run((3, 80 * s, "d1", 0, 2)) == {3: "ok"}  # late: counts for d2, whose quota is then met
    assert run((4, 110 * s, "d2", 0, 2)) == {4: "quota"}
    assert state.get[0] == 110 * s and state.duration == 5000
    assert run((5, 200 * s, "d3", 1, 0), (6, 259 * s, "d3", 1, 0)) == {5: "ok", 6: "rpm"}
    assert run((7, 130 * s, "d2", 1, 0)) == {7: "rpm"}  # late: the window of the clock is full
    assert run((8, 260 * s, "d3", 1, 0)) == {8: "ok"}
    state.hasTimedOut = True
    assert list(decide((1,), iter([]), state)) == [] and not state.exists


def test_the_plan_of_many_rounds_does_not_grow(spark):
    def plan_of(seconds):
        rows = [(i, 1, None, at(i * 20)) for i in range(seconds // 20)]  # never quiet: every slot waits for the one before
        keys = spark.createDataFrame([(1, True, 2, 0, [], None)], KEYS)
        requests = spark.createDataFrame(rows, REQUEST)
        decided = op.decide(requests, keys, window_seconds=45, slot_seconds=300)
        assert decisions(decided) == reference(rows, [(1, True, 2, 0, [], None)], 45)
        return decided._jdf.queryExecution().optimizedPlan().toString().count("Relation")

    assert plan_of(600) == plan_of(1500)


def test_retention(spark):
    usage = spark.createDataFrame([(1, "2024-01-01", 2), (1, "2023-12-31", 3)], "key_id int, day string, used long")
    assert [r.day for r in op.retain(usage, "2024-01-31").collect()] == ["2024-01-01"]


def test_dashboard_warnings(spark):
    keys = spark.createDataFrame([(1, True, 0, 10, [], at(3600)), (2, True, 0, 10, ["a"], at(2 * 86_400 + 1)), (3, True, 5, 0, [], at(-1))], KEYS)
    usage = spark.createDataFrame([(1, "2024-01-01", 8), (2, "2024-01-01", 9), (2, "2023-12-31", 1)], "key_id long, day string, used long")
    rows = {r.key_id: r for r in op.dashboard(keys, usage, "2024-01-01 00:00:00").collect()}
    assert (rows[1].quota_pct, rows[1].quota_warning, rows[1].days_left, rows[1].expiry_warning) == (80, False, 1, True)
    assert (rows[2].quota_pct, rows[2].quota_warning, rows[2].total_usage, rows[2].days_left) == (90, True, 10, 3)
    assert (rows[3].quota_pct, rows[3].days_left, rows[3].expiry_warning, rows[3].today_usage) == (None, None, True, 0)
    totals = op.dashboard_totals(op.dashboard(keys, usage, "2024-01-01 00:00:00")).first()
    assert tuple(totals) == (3, 3, 17, 18)
