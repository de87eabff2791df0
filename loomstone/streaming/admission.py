"""Request admission over a stream: the batch decisions, with state carried between micro-batches."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import metering as op

STATE_SCHEMA = "clock bigint, day string, used bigint, times array<bigint>"


def _decide_key(window_us: int, idle_ms: int | None = None):
    """Quota and rolling limit of one key; the state is a clock, a counter and at most ``rpm`` times."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        clock, day, used, times = state.get if state.exists else (None, None, 0, [])
        times = deque(int(t) for t in times)
        # Rows of one micro-batch are put in order; a row older than the key's clock is judged as of the clock.
        arrived = pd.concat(list(batches)).sort_values(["us", "event_id"])
        decisions = []
        for us, today, rpm, limit in zip(arrived["us"].tolist(), arrived["day"], arrived["rpm"].tolist(), arrived["daily_limit"].tolist()):
            if clock is None or us > clock:
                clock = us
                if today != day:
                    day, used = today, 0
            if limit > 0 and used >= limit:
                decisions.append("quota")
                continue
            if rpm > 0:
                while times and times[0] <= clock - window_us:
                    times.popleft()
                if len(times) >= rpm:
                    decisions.append("rpm")
                    continue
                times.append(clock)
            used += 1
            decisions.append("ok")
        state.update((clock, day, used, list(times)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"event_id": arrived["event_id"].to_numpy(), "key_id": key[0], "decision": decisions})

    return decide


def admission_stream(
    requests: DataFrame,
    keys: DataFrame,
    sharing: bool = True,
    window_seconds: int = op.WINDOW_SECONDS,
    idle_seconds: int | None = None,
) -> DataFrame:
    """Stream of ``(event_id, key_id, decision)`` for a stream of requests and a static table of keys.

    Requests refused without history, and those of unlimited keys, never reach
    the state; micro-batches are bounded by the source's rate options.

    A key's clock is the latest time it was seen at and never goes back. Within a micro-batch rows are taken by time;
    a row that comes in a later micro-batch than newer ones of its key is judged as of the clock: it counts
    against the clock's day and window. Rows that arrive in order give the batch decisions. With ``idle_seconds``, a key without
    requests for so long of running time is forgotten, and begins anew when it returns; this is for streams that run on, and
    was not tried in one: a test run over what is available now did not end with it. Without it every key's state stays.
    """
    joined = op.join_keys(requests, keys)
    judged = joined.withColumn("decision", op.stateless_reason(joined, sharing))
    unlimited = F.col("decision").isNull() & (F.col("rpm") == 0) & (F.col("daily_limit") == 0)
    settled = judged.withColumn("decision", F.when(unlimited, "ok").otherwise(F.col("decision")))
    direct = settled.where("decision IS NOT NULL").select("event_id", "key_id", "decision")
    if not sharing:
        return direct
    limited = settled.where("decision IS NULL").select(
        "event_id", "key_id", op.micros("ts").alias("us"), op.day_of("ts").alias("day"), "rpm", "daily_limit"
    )
    key_type = limited.schema["key_id"].dataType.simpleString()
    decided = limited.groupBy("key_id").applyInPandasWithState(
        _decide_key(window_seconds * 1_000_000, None if idle_seconds is None else idle_seconds * 1000),
        outputStructType=f"event_id bigint, key_id {key_type}, decision string",
        stateStructType=STATE_SCHEMA,
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout if idle_seconds is None else GroupStateTimeout.ProcessingTimeTimeout,
    )
    return direct.unionByName(decided)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is available now into a Parquet table, exactly once."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start(path).awaitTermination()
