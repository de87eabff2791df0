"""API requests against keys: admission, quotas, rolling rate limits, and usage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpointed, ensure_checkpoint_dir
from . import scan

WINDOW_SECONDS = 60
RETENTION_DAYS = 30
QUOTA_WARNING = 80
DAY_SECONDS = 86_400
# Buckets in which quotas are counted, and lengths of the slots in which rolling limits are folded.
BUCKET_SECONDS = 60
SLOTS = [3600, 7200, 14_400, 21_600, 43_200]


def micros(ts) -> Column:
    """Microseconds since the epoch of a timestamp, whatever the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def day_of(ts: str) -> Column:
    return F.date_format(F.col(ts).cast("timestamp_ntz"), "yyyy-MM-dd")


def _salted(requests: DataFrame) -> DataFrame:
    """Requests with a salt that is 0 beside a key; requests without one, which match nothing, are spread by it."""
    return requests.withColumn("__salt", F.when(F.col("key_id").isNull(), F.xxhash64("event_id")).otherwise(0))


def join_keys(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests with the settings of their key; all null for a key that is unknown or not active."""
    settings = keys.where(F.coalesce(F.col("active"), F.lit(True))).select(
        "key_id",
        F.lit(True).alias("known"),
        F.coalesce("rpm", F.lit(0)).alias("rpm"),
        F.coalesce("daily_limit", F.lit(0)).alias("daily_limit"),
        F.coalesce("allowed_models", F.array().cast("array<string>")).alias("allowed_models"),
        "expires_at",
        F.lit(0).cast("bigint").alias("__salt"),
    )
    return _salted(requests).join(settings, ["key_id", "__salt"], "left").drop("__salt")


def invalid_key(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests whose key is unknown or revoked (an anti-join)."""
    active = keys.where(F.coalesce(F.col("active"), F.lit(True))).select("key_id", F.lit(0).cast("bigint").alias("__salt"))
    return _salted(requests).join(active, ["key_id", "__salt"], "left_anti").drop("__salt")


def is_expired(ts: Column, expires_at: Column) -> Column:
    """After the expiry; a key without one never expires."""
    return F.coalesce(ts > expires_at, F.lit(False))


def is_model_denied(model: Column, allowed: Column) -> Column:
    """Not on a non-empty list of allowed models; not checked when no model is named."""
    return (F.size(allowed) > 0) & (F.coalesce(model, F.lit("")) != "") & ~F.array_contains(
        allowed, F.coalesce(model, F.lit(""))
    )


def stateless_reason(joined: DataFrame, sharing: bool = True) -> Column:
    """The first reason that needs no history, in the order of the checks; null when none applies."""
    if not sharing:
        return F.lit("sharing_off")
    return (
        F.when(F.coalesce(F.col("key_id").cast("string"), F.lit("")) == "", "missing")
        .when(F.col("known").isNull(), "invalid")
        .when(is_expired(F.col("ts"), F.col("expires_at")), "expired")
        .when(is_model_denied(F.col("model"), F.col("allowed_models")), "model")
    )


def daily_quota(candidates: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Requests limited by the day's quota only: the first ``daily_limit`` of a key and day are admitted.

    Requests are counted through buckets of a minute, so a key may hold any share
    of the table.
    """
    timed = candidates.withColumn("__us", micros("ts")).withColumn("day", day_of("ts"))
    counted = scan.running(
        timed,
        ["key_id", "day"],
        ["__us", "event_id"],
        F.expr(f"__us div {bucket_seconds * 1_000_000}"),
        {"used": ("count", "event_id")},
        exclusive=True,
    )
    admitted = (F.col("daily_limit") == 0) | (F.col("used") < F.col("daily_limit"))
    return counted.withColumn("decision", F.when(admitted, "ok").otherwise("quota")).drop("__us")


def _admit(us: np.ndarray, times: list[int], rpm: int, window_us: int) -> np.ndarray:
    """Which of the sorted requests the rolling limit admits; ``times`` are the admissions still counted.

    A full window refuses everything up to the moment its oldest admission
    leaves, found by binary search, so the cost follows the admissions.
    """
    admitted = np.zeros(len(us), dtype=bool)
    i = 0
    while i < len(us):
        now = int(us[i])
        while times and times[0] <= now - window_us:
            times.pop(0)
        if len(times) >= rpm:
            i += int(np.searchsorted(us[i:], times[0] + window_us))
            continue
        admitted[i] = True
        times.append(now)
        i += 1
    return admitted


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of rows that agree in all columns."""
    n = len(columns[0])
    if n == 0:
        return []
    edges = np.zeros(n - 1, dtype=bool)
    for column in columns:
        edges |= column[1:] != column[:-1]
    starts = [0, *(np.nonzero(edges)[0] + 1).tolist(), n]
    return list(zip(starts, starts[1:]))


def _fold_slots(window_us: int):
    """Rate decisions of sorted requests, slot by slot; rows marked ``carried`` are earlier admissions."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, times = None, []
        for batch in batches:
            key, slot, us = (batch[c].to_numpy() for c in ("key_id", "slot", "us"))
            carried, rpm = batch["carried"].to_numpy(), batch["rpm"].to_numpy()
            passed = np.zeros(len(batch), dtype=bool)
            for start, end in _runs(key, slot):
                if current != (key[start], slot[start]):
                    current, times = (key[start], slot[start]), []
                first = start + int(carried[start:end].sum())
                times.extend(us[start:first].tolist())
                passed[first:end] = _admit(us[first:end], times, int(rpm[start]), window_us)
            out = batch.assign(rate_ok=passed)[~carried]
            yield out[["key_id", "slot", "us", "event_id", "daily_limit", "rate_ok"]]

    return fold


def _quota_labels(flagged: DataFrame) -> DataFrame:
    """Join the day's quota: a request is refused once ``daily_limit`` earlier ones passed the rate check."""
    counted = scan.running(
        flagged.withColumns(
            {"quota_day": F.expr(f"us div {DAY_SECONDS * 1_000_000}"), "__passed": F.col("rate_ok").cast("bigint")}
        ),
        ["key_id", "quota_day"],
        ["us", "event_id"],
        F.expr(f"us div {BUCKET_SECONDS * 1_000_000}"),
        {"used": ("sum", "__passed")},
        exclusive=True,
    )
    return counted.withColumn(
        "decision",
        F.when((F.col("daily_limit") > 0) & (F.col("used") >= F.col("daily_limit")), "quota")
        .when(~F.col("rate_ok"), "rpm")
        .otherwise("ok"),
    ).drop("__passed", "used", "quota_day")


def rate_and_quota(
    candidates: DataFrame, window_seconds: int = WINDOW_SECONDS, slot_seconds: int | None = None
) -> DataFrame:
    """Decisions ok / quota / rpm for requests of keys with a rolling limit.

    Admissions feed back: only admitted requests fill the rolling window. The
    time of every key is cut into slots, parts of a day, that are folded in
    parallel from an empty window; then the true window at each slot's start is
    read off the admissions of the slots before it, and slots that were given
    another one are folded again, until none is left. A slot is final once
    those before it are, so this ends with the sequential result; a key whose
    slots all had their true window is settled and takes no further part. A
    quiet stretch as long as the window, or a quota that is met, settles what
    follows at once; a key without either takes as many rounds as it takes its
    slots to forget where they started. Folds stream sorted rows and keep at
    most ``rpm`` times; a window may be longer than a slot, or than a day.
    """
    if slot_seconds is None:
        slot_seconds = next((s for s in SLOTS if s >= 4 * window_seconds), DAY_SECONDS)
    if DAY_SECONDS % slot_seconds:
        raise ValueError("a slot must divide the day")
    window_us, slot_us = window_seconds * 1_000_000, slot_seconds * 1_000_000
    reach = -(-window_seconds // slot_seconds)
    timed = checkpointed(
        candidates.select(
            "key_id", "event_id", micros("ts").alias("us"), F.col("rpm").cast("int"), F.col("daily_limit").cast("int")
        ).withColumns({"carried": F.lit(False), "slot": F.expr(f"us div {slot_us}")})
    )
    key_type = timed.schema["key_id"].dataType.simpleString()

    def fold(rows: DataFrame) -> DataFrame:
        # Partitioned by a digest, so that no join can stand in for this shuffle and be split by
        # its skew handling: the rows of a slot must stay together and in order.
        ordered = rows.repartition(F.xxhash64("key_id", "slot")).sortWithinPartitions("key_id", "slot", "us", "event_id")
        return ordered.mapInPandas(
            _fold_slots(window_us),
            f"key_id {key_type}, slot bigint, us bigint, event_id bigint, daily_limit int, rate_ok boolean",
        )

    def handed_on(labelled: DataFrame) -> DataFrame:
        """Admitted times still inside the window when a later slot starts (a window holds at most rpm)."""
        ahead = labelled.where("decision = 'ok'").withColumn("ahead", F.explode(F.sequence(F.lit(1), F.lit(reach))))
        late = ahead.withColumn("slot", F.col("slot") + F.col("ahead")).where(F.col("us") > F.col("slot") * slot_us - window_us)
        return late.groupBy("key_id", "slot").agg(F.array_sort(F.collect_list("us")).alias("true_times"))

    empty = F.array().cast("array<bigint>")
    slots = timed.groupBy("key_id", "slot").agg(F.min("us").alias("first_us"), F.max("rpm").alias("rpm"))
    flagged, given = checkpointed(fold(timed)), checkpointed(slots.withColumn("times", empty))
    # Decisions of settled keys are added to one table, so the plan does not grow with the rounds.
    table = f"{ensure_checkpoint_dir(timed.sparkSession)}/decided-{uuid.uuid4().hex}"
    while True:
        labelled = checkpointed(_quota_labels(flagged))
        # Times that have left the window by the slot's first request play no part.
        counted = F.filter(F.coalesce("true_times", empty), lambda t: t > F.col("first_us") - window_us)
        compared = checkpointed(
            given.join(handed_on(labelled), ["key_id", "slot"], "left").select(
                "key_id", "slot", "first_us", "rpm", counted.alias("times"), (F.col("times") != counted).alias("stale")
            )
        )
        stale = compared.where("stale")
        decided = labelled.select("key_id", "event_id", "decision")
        if stale.isEmpty():
            decided.write.mode("append").parquet(table)
            return timed.sparkSession.read.schema(decided.schema).parquet(table)
        moving = stale.select("key_id").distinct()
        decided.join(moving, "key_id", "left_anti").write.mode("append").parquet(table)
        carried = stale.select(
            "key_id",
            F.lit(-1).cast("bigint").alias("event_id"),
            F.explode("times").alias("us"),
            "rpm",
            F.lit(0).alias("daily_limit"),
            F.lit(True).alias("carried"),
            "slot",
        )
        here = stale.select("key_id", "slot")
        again = fold(timed.join(here, ["key_id", "slot"], "left_semi").unionByName(carried))
        kept = flagged.join(moving, "key_id", "left_semi").join(here, ["key_id", "slot"], "left_anti")
        flagged = checkpointed(kept.unionByName(again))
        given = compared.join(moving, "key_id", "left_semi").drop("stale")


def decide(
    requests: DataFrame,
    keys: DataFrame,
    sharing: bool = True,
    window_seconds: int = WINDOW_SECONDS,
    slot_seconds: int | None = None,
) -> DataFrame:
    """Every request ``(event_id, key_id, model, ts)`` with its decision.

    Order of the checks: sharing off, missing, invalid, expired, model, quota,
    rpm, ok. The stateless ones are columns; unlimited keys need nothing more;
    quota-only keys are counted; only keys with a rolling limit are folded.
    """
    joined = join_keys(requests, keys)
    judged = joined.withColumn("decision", stateless_reason(joined, sharing))
    refused = judged.where("decision IS NOT NULL").select("event_id", "key_id", "decision")
    rest = judged.where("decision IS NULL").drop("decision")
    if not sharing:
        return refused
    free = rest.where("rpm = 0 AND daily_limit = 0").select("event_id", "key_id", F.lit("ok").alias("decision"))
    quota = daily_quota(rest.where("rpm = 0 AND daily_limit > 0")).select("event_id", "key_id", "decision")
    rated = rate_and_quota(rest.where("rpm > 0"), window_seconds, slot_seconds)
    rated = rated.select("event_id", "key_id", "decision")
    return refused.unionByName(free).unionByName(quota).unionByName(rated)


def usage_by_day(admitted: DataFrame, key: str = "key_id", ts: str = "ts") -> DataFrame:
    """Admitted requests per key and day, and the key's running total."""
    daily = admitted.groupBy(key, day_of(ts).alias("day")).agg(F.count("*").alias("used"))
    # A key has one row per day here, so its days are few whatever its requests.
    return scan.running(
        daily, [key], ["day"], F.expr("year(day)"), {"total": ("sum", "used")}
    )


def retain(usage: DataFrame, as_of: str, days: int = RETENTION_DAYS, day: str = "day") -> DataFrame:
    """Day counters not older than the retention."""
    return usage.where(F.col(day) >= F.date_format(F.date_sub(F.to_date(F.lit(as_of)), days), "yyyy-MM-dd"))


def dashboard(keys: DataFrame, usage: DataFrame, as_of: str) -> DataFrame:
    """Per key: used today, in total, share of the quota with a warning, days left with a warning."""
    today = as_of[:10]
    used = usage.groupBy("key_id").agg(
        F.sum(F.when(F.col("day") == today, F.col("used")).otherwise(0)).alias("today_usage"),
        F.sum("used").alias("total_usage"),
    )
    left_us = micros("expires_at") - F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', TIMESTAMP_NTZ '{as_of}')")
    percent = F.floor(F.col("today_usage") * 100 / F.col("daily_limit") + 0.5).cast("bigint")
    limited = F.col("daily_limit") > 0
    return (
        keys.join(used, "key_id", "left")
        .withColumn("today_usage", F.coalesce("today_usage", F.lit(0)))
        .withColumn("total_usage", F.coalesce("total_usage", F.lit(0)))
        .select(
            "key_id",
            "active",
            "rpm",
            "daily_limit",
            "today_usage",
            "total_usage",
            F.when(limited, percent).alias("quota_pct"),
            F.coalesce(F.when(limited, percent > QUOTA_WARNING), F.lit(False)).alias("quota_warning"),
            F.when(left_us > 0, F.ceil(left_us / (DAY_SECONDS * 1_000_000))).cast("bigint").alias("days_left"),
            F.coalesce(left_us < DAY_SECONDS * 1_000_000, F.lit(False)).alias("expiry_warning"),
            F.size("allowed_models").cast("bigint").alias("n_models"),
        )
    )


def dashboard_totals(board: DataFrame) -> DataFrame:
    return board.agg(
        F.count("*").alias("keys"),
        F.count_if(F.coalesce("active", F.lit(True))).alias("active_keys"),
        F.sum("today_usage").alias("today_usage"),
        F.sum("total_usage").alias("total_usage"),
    )


def token_usage(df: DataFrame, prompt: str, completion: str) -> DataFrame:
    """Prompt, completion and total tokens; a missing count is zero."""
    p, c = F.coalesce(F.col(prompt), F.lit(0)), F.coalesce(F.col(completion), F.lit(0))
    return df.withColumns({"prompt_tokens": p, "completion_tokens": c, "total_tokens": p + c})
