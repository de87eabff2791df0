"""Named queries of request admission and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import metering as op
from ..streaming import admission as streamed
from . import inputs
from .registry import query

# The events of one user are mostly hours apart, so the rolling window of the
# queries is six hours instead of a minute; otherwise it would hardly bind.
WINDOW = 21_600
AS_OF = "2024-01-30 12:00:00"


def api_keys(spark, sf_dir):
    """One key per user, its limits by the user's number."""
    users = inputs.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key_id")).agg(F.lit(1).alias("one"))
    k = F.col("key_id")
    return users.select(
        "key_id",
        (k % 17 != 0).alias("active"),
        (F.when(k % 3 == 0, 0).otherwise(k % 3 + 1)).cast("int").alias("rpm"),
        F.when(k % 4 == 0, 0).otherwise(k % 4 + 1).cast("int").alias("daily_limit"),
        F.when(k % 5 == 0, F.array(F.lit("click"), F.lit("view"), F.lit("purchase")))
        .otherwise(F.array().cast("array<string>"))
        .alias("allowed_models"),
        F.when(k % 7 == 0, F.lit("2024-01-20 06:00:00").cast("timestamp_ntz"))
        .when(k % 7 == 1, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
        .alias("expires_at"),
    )


def requests(spark, sf_dir):
    return as_requests(inputs.table(spark, sf_dir, "events"))


def as_requests(events):
    """Events as requests; some name an unknown key, some none, some no model."""
    e = F.col("event_id")
    return events.select(
        "event_id",
        F.when(e % 31 == 0, F.lit(None)).when(e % 29 == 0, F.col("user_id") + 1_000_000).otherwise(F.col("user_id")).alias("key_id"),
        F.when(e % 13 == 0, F.lit("")).otherwise(F.col("event_type")).alias("model"),
        "ts",
    )


_KEYS_SQL = """
keys AS (SELECT DISTINCT user_id AS key_id, user_id % 17 <> 0 AS active, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 3 + 1 END AS rpm,
  CASE WHEN user_id % 4 = 0 THEN 0 ELSE user_id % 4 + 1 END AS daily_limit,
  CASE WHEN user_id % 5 = 0 THEN ['click', 'view', 'purchase'] ELSE [] END AS allowed_models,
  CASE user_id % 7 WHEN 0 THEN TIMESTAMP '2024-01-20 06:00:00' WHEN 1 THEN TIMESTAMP '2024-01-31 00:00:00' END AS expires_at FROM events),
requests AS (SELECT event_id, CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 29 = 0 THEN user_id + 1000000 ELSE user_id END AS key_id,
  CASE WHEN event_id % 13 = 0 THEN '' ELSE event_type END AS model, ts FROM events),
judged AS (SELECT r.event_id, r.key_id, r.model, r.ts, epoch_us(r.ts) AS us, strftime(r.ts, '%Y-%m-%d') AS day, k.rpm, k.daily_limit,
  CASE WHEN r.key_id IS NULL THEN 'missing' WHEN k.key_id IS NULL THEN 'invalid' WHEN r.ts > k.expires_at THEN 'expired'
       WHEN len(k.allowed_models) > 0 AND r.model <> '' AND NOT list_contains(k.allowed_models, r.model) THEN 'model' END AS reason
  FROM requests r LEFT JOIN keys k ON k.key_id = r.key_id AND k.active)
"""


def _fold_sql(limit: str) -> str:
    return f"""
cand AS (SELECT *, {limit} AS lim, row_number() OVER (PARTITION BY key_id ORDER BY us, event_id) AS rn FROM judged WHERE reason IS NULL),
fold AS (
  SELECT key_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, []::BIGINT[] AS win, '' AS day, 0::BIGINT AS used, 'ok' AS decision FROM cand WHERE rn = 1
  UNION ALL
  SELECT key_id, rn, event_id, CASE WHEN decision = 'ok' THEN list_append(w, us) ELSE w END, day, u + CASE WHEN decision = 'ok' THEN 1 ELSE 0 END, decision FROM (
    SELECT *, CASE WHEN lim > 0 AND u >= lim THEN 'quota' WHEN rpm > 0 AND len(w) >= rpm THEN 'rpm' ELSE 'ok' END AS decision FROM (
      SELECT c.*, CASE WHEN f.day = c.day THEN f.used ELSE 0 END AS u, list_filter(f.win, lambda t: t > c.us - {WINDOW * 1_000_000}) AS w
      FROM fold f JOIN cand c ON c.key_id = f.key_id AND c.rn = f.rn + 1)))
"""


def decisions(spark, sf_dir):
    return op.decide(requests(spark, sf_dir), api_keys(spark, sf_dir), window_seconds=WINDOW)


@query("requests_invalid_key", f"WITH {_KEYS_SQL} SELECT event_id, key_id, model FROM judged WHERE reason IN ('invalid', 'missing')")
def requests_invalid_key(spark, sf_dir):
    return op.invalid_key(requests(spark, sf_dir), api_keys(spark, sf_dir)).select("event_id", "key_id", "model")


@query(
    "requests_expired",
    f"WITH {_KEYS_SQL} SELECT r.event_id, r.key_id FROM requests r JOIN keys k ON k.key_id = r.key_id AND k.active WHERE r.ts > k.expires_at",
)
def requests_expired(spark, sf_dir):
    joined = op.join_keys(requests(spark, sf_dir), api_keys(spark, sf_dir))
    return joined.where(op.is_expired(F.col("ts"), F.col("expires_at"))).select("event_id", "key_id")


@query(
    "requests_model_denied",
    f"""WITH {_KEYS_SQL} SELECT r.event_id, r.key_id, r.model FROM requests r JOIN keys k ON k.key_id = r.key_id AND k.active
    WHERE len(k.allowed_models) > 0 AND r.model <> '' AND NOT list_contains(k.allowed_models, r.model)""",
)
def requests_model_denied(spark, sf_dir):
    joined = op.join_keys(requests(spark, sf_dir), api_keys(spark, sf_dir)).where("known")
    return joined.where(op.is_model_denied(F.col("model"), F.col("allowed_models"))).select("event_id", "key_id", "model")


def _eligible(spark, sf_dir):
    """Requests that pass the checks needing no history, with the limits of their key."""
    joined = op.join_keys(requests(spark, sf_dir), api_keys(spark, sf_dir))
    return joined.where(op.stateless_reason(joined).isNull())


@query(
    "daily_quota",
    f"""WITH {_KEYS_SQL} SELECT event_id, key_id, day, CASE WHEN daily_limit = 0 OR row_number() OVER (PARTITION BY key_id, day ORDER BY us, event_id) <= daily_limit
      THEN 'ok' ELSE 'quota' END AS decision FROM judged WHERE reason IS NULL""",
)
def daily_quota(spark, sf_dir):
    return op.daily_quota(_eligible(spark, sf_dir)).select("event_id", "key_id", "day", "decision")


@query(
    "rolling_rate_limit",
    f"WITH RECURSIVE {_KEYS_SQL.strip()}, {_fold_sql('0')} SELECT event_id, key_id, decision FROM fold WHERE rn > 0 AND key_id % 3 <> 0",
)
def rolling_rate_limit(spark, sf_dir):
    """Only the rolling limit: the quota of every limited key is lifted."""
    limited = _eligible(spark, sf_dir).where("rpm > 0").withColumn("daily_limit", F.lit(0))
    return op.rate_and_quota(limited, WINDOW).select("event_id", "key_id", "decision")


_DECIDED_SQL = f"""{_KEYS_SQL.strip()}, {_fold_sql('daily_limit')},
decided AS (SELECT event_id, key_id, reason AS decision FROM judged WHERE reason IS NOT NULL UNION ALL SELECT event_id, key_id, decision FROM fold WHERE rn > 0),
usage AS (SELECT d.key_id, strftime(e.ts, '%Y-%m-%d') AS day, count(*) AS used FROM decided d JOIN events e USING (event_id) WHERE decision = 'ok' GROUP BY ALL)
"""


@query("admission_decisions", f"WITH RECURSIVE {_DECIDED_SQL} SELECT event_id, key_id, decision FROM decided")
def admission_decisions(spark, sf_dir):
    return decisions(spark, sf_dir)


@query("admission_stream", f"WITH RECURSIVE {_DECIDED_SQL} SELECT event_id, key_id, decision FROM decided")
def admission_stream(spark, sf_dir):
    """The same decisions taken by the streaming job over all events available now."""
    events = inputs.stream(spark, sf_dir, "events")
    decided = streamed.admission_stream(as_requests(events), api_keys(spark, sf_dir), window_seconds=WINDOW)
    folder = inputs.scratch(spark, "admission")
    streamed.run_to_table(decided, f"{folder}/table", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/table")


def _usage(spark, sf_dir):
    """Day counters of the requests that are admitted under all rules, the rolling limit included."""
    admitted = decisions(spark, sf_dir).where("decision = 'ok'").select("event_id")
    return op.usage_by_day(requests(spark, sf_dir).join(admitted, "event_id"))


_USAGE_SQL = f"""{_DECIDED_SQL.strip()},
counted AS (SELECT *, (sum(used) OVER (PARTITION BY key_id ORDER BY day))::BIGINT AS total FROM usage)
"""


@query("usage_by_day", f"WITH RECURSIVE {_USAGE_SQL} SELECT key_id, day, used, total FROM counted")
def usage_by_day(spark, sf_dir):
    return _usage(spark, sf_dir).select("key_id", "day", "used", "total")


@query("usage_retention", f"WITH RECURSIVE {_USAGE_SQL} SELECT key_id, day, used FROM counted WHERE day >= '2024-01-10'")
def usage_retention(spark, sf_dir):
    return op.retain(_usage(spark, sf_dir), "2024-02-09").select("key_id", "day", "used")


@query(
    "key_dashboard",
    f"""WITH RECURSIVE {_USAGE_SQL}, used AS (SELECT key_id, sum(CASE WHEN day = '2024-01-30' THEN used ELSE 0 END)::BIGINT AS today, sum(used)::BIGINT AS total FROM counted GROUP BY key_id)
    SELECT k.key_id, active, rpm::INT AS rpm, daily_limit::INT AS daily_limit, coalesce(today, 0) AS today_usage, coalesce(total, 0) AS total_usage,
      CASE WHEN daily_limit > 0 THEN floor(coalesce(today, 0) * 100 / daily_limit + 0.5)::BIGINT END AS quota_pct,
      daily_limit > 0 AND floor(coalesce(today, 0) * 100 / daily_limit + 0.5) > 80 AS quota_warning,
      CASE WHEN expires_at > TIMESTAMP '{AS_OF}' THEN ceil((epoch_us(expires_at) - epoch_us(TIMESTAMP '{AS_OF}')) / 86400000000)::BIGINT END AS days_left,
      coalesce(epoch_us(expires_at) - epoch_us(TIMESTAMP '{AS_OF}') < 86400000000, false) AS expiry_warning, len(allowed_models)::BIGINT AS n_models
    FROM keys k LEFT JOIN used u ON u.key_id = k.key_id""",
)
def key_dashboard(spark, sf_dir):
    return op.dashboard(api_keys(spark, sf_dir), _usage(spark, sf_dir), AS_OF)


@query(
    "key_totals",
    f"""WITH RECURSIVE {_USAGE_SQL} SELECT (SELECT count(*) FROM keys) AS keys, (SELECT count(*) FROM keys WHERE active) AS active_keys,
      (SELECT sum(used)::BIGINT FROM counted WHERE day = '2024-01-30') AS today_usage, (SELECT sum(used)::BIGINT FROM counted) AS total_usage""",
)
def key_totals(spark, sf_dir):
    return op.dashboard_totals(op.dashboard(api_keys(spark, sf_dir), _usage(spark, sf_dir), AS_OF))


@query(
    "token_usage",
    """SELECT user_id, sum(coalesce(p, 0))::BIGINT AS prompt_tokens, sum(coalesce(c, 0))::BIGINT AS completion_tokens, sum(coalesce(p, 0) + coalesce(c, 0))::BIGINT AS total_tokens
    FROM (SELECT user_id, CASE WHEN event_id % 3 <> 0 THEN (props->>'k')::BIGINT END AS p, CASE WHEN event_id % 4 <> 0 THEN event_id % 50 END AS c FROM events) GROUP BY user_id""",
)
def token_usage(spark, sf_dir):
    e = F.col("event_id")
    replies = inputs.table(spark, sf_dir, "events").select(
        "user_id",
        F.when(e % 3 != 0, F.get_json_object("props", "$.k").cast("bigint")).alias("prompt_eval_count"),
        F.when(e % 4 != 0, e % 50).alias("eval_count"),
    )
    used = op.token_usage(replies, "prompt_eval_count", "eval_count")
    return used.groupBy("user_id").agg(
        *[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    )


@query(
    "mask_secret",
    "SELECT DISTINCT user_id AS key_id, substr('key-' || md5(user_id::VARCHAR), 1, 12) || '...****************' AS key_preview FROM events",
)
def mask_secret(spark, sf_dir):
    secret = F.concat(F.lit("key-"), F.md5(F.col("key_id").cast("string").cast("binary")))
    return api_keys(spark, sf_dir).select("key_id", tx.mask_secret(secret).alias("key_preview"))
