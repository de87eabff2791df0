"""Named queries of training-run telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logs, text as tx
from ..operators import metering, telemetry as op
from ..streaming import runs as streamed
from . import inputs
from .registry import query

RUN, ORDER = "run_id", "seq"
EPOCHS = 3


def run_lines(spark, sf_dir):
    return as_run_lines(inputs.table(spark, sf_dir, "events"))


def as_run_lines(events):
    """Events as the output lines of training runs: JSON events, plain log text, and broken JSON."""
    e, step = F.col("event_id"), F.expr("event_id div 500")
    k = F.get_json_object("props", "$.k").cast("bigint")

    def event(name, *fields):
        return F.to_json(F.struct(F.lit(name).alias("event"), *fields))

    line = (
        F.when(e % 97 == 0, event("done", step.alias("step"), (k * 1.5).alias("elapsed"), F.col("value").alias("final_val_loss"), F.lit("final.pt").alias("path")))
        .when(e % 61 == 0, event("init", F.concat(F.lit("cuda:"), (k % 8).cast("string")).alias("device"), (k * 1000).alias("params")))
        .when(e % 19 == 0, F.concat(F.lit("STEP: loading shard "), k.cast("string")))
        .when(e % 23 == 0, F.lit('{"event": "step", "step'))
        .when(F.col("event_type") == "click", event("step", step.alias("step"), F.lit(100000).alias("total"), F.col("value").alias("loss"), (k / 1000).alias("lr"), (k * 10).alias("tok_s")))
        .when(F.col("event_type") == "view", event("eval", step.alias("step"), F.col("value").alias("val_loss"), F.col("value").alias("best_val_loss")))
        .when(F.col("event_type") == "purchase", event("checkpoint", step.alias("step"), F.concat(F.lit("step_"), F.lpad(step.cast("string"), 6, "0"), F.lit(".pt")).alias("path")))
        .when(F.col("event_type") == "error", event("warning", F.concat(F.lit("gradient overflow "), k.cast("string")).alias("msg")))
        .otherwise(
            event(
                "sample",
                step.alias("step"),
                F.array(
                    F.struct(F.lit("Once").alias("prompt"), F.concat(F.lit("Once upon "), k.cast("string")).alias("text")),
                    F.struct(F.lit("The").alias("prompt"), F.concat(F.lit("The "), F.col("event_id").cast("string")).alias("text")),
                ).alias("samples"),
            )
        )
    )
    return events.select(
        F.col("user_id").alias(RUN), e.alias(ORDER), "ts", "value", k.alias("k"), "event_type", line.alias("line")
    )


_RUN_SQL = """
ev AS (SELECT user_id AS run_id, event_id AS seq, ts, value, (props->>'k')::BIGINT AS k, event_type, event_id // 500 AS step,
  CASE WHEN event_id % 97 = 0 THEN 'done' WHEN event_id % 61 = 0 THEN 'init' WHEN event_id % 19 = 0 THEN 'log' WHEN event_id % 23 = 0 THEN 'broken'
       ELSE CASE event_type WHEN 'click' THEN 'step' WHEN 'view' THEN 'eval' WHEN 'purchase' THEN 'checkpoint' WHEN 'error' THEN 'warning' ELSE 'sample' END END AS event FROM events)
"""


def run_events(spark, sf_dir):
    return op.parse_lines(run_lines(spark, sf_dir))


@query(
    "parse_event_lines",
    f"""WITH {_RUN_SQL} SELECT run_id, seq, CASE WHEN event IN ('log', 'broken') THEN 'log' ELSE 'event' END AS kind,
      CASE WHEN event NOT IN ('log', 'broken') THEN event END AS event, CASE WHEN event IN ('done', 'step', 'eval', 'checkpoint', 'sample') THEN step END AS step,
      CASE WHEN event = 'step' THEN value END AS loss, CASE WHEN event = 'warning' THEN 'gradient overflow ' || k END AS msg FROM ev""",
)
def parse_event_lines(spark, sf_dir):
    return run_events(spark, sf_dir).select(
        RUN,
        ORDER,
        F.when(F.col("ev").isNull(), "log").otherwise("event").alias("kind"),
        "ev.event",
        "ev.step",
        "ev.loss",
        "ev.msg",
    )


_STATE_SQL = """state AS (SELECT run_id, arg_max(step, seq) FILTER (event = 'step') AS current_step,
  CASE WHEN count(*) FILTER (event = 'step') > 0 THEN 100000::BIGINT END AS total_steps, arg_max(value, seq) FILTER (event = 'step') AS loss,
  (arg_max(k, seq) FILTER (event = 'step') * 10)::DOUBLE AS tokens_per_sec, arg_max(value, seq) FILTER (event = 'eval') AS val_loss,
  arg_max(value, seq) FILTER (event = 'eval') AS best_val_loss, 'cuda:' || (arg_max(k, seq) FILTER (event = 'init') % 8) AS device,
  arg_max(k, seq) FILTER (event = 'init') * 1000 AS total_params, count(*) FILTER (event = 'done') = 0 AS running
  FROM ev WHERE event NOT IN ('log', 'broken') GROUP BY run_id)"""


@query("latest_run_state", f"WITH {_RUN_SQL}, {_STATE_SQL} SELECT * FROM state")
def latest_run_state(spark, sf_dir):
    return op.latest_state(run_events(spark, sf_dir), RUN, ORDER)


@query("run_state_stream", f"WITH {_RUN_SQL}, {_STATE_SQL} SELECT * FROM state")
def run_state_stream(spark, sf_dir):
    """The same state folded by the streaming job over all lines available now."""
    lines = as_run_lines(inputs.stream(spark, sf_dir, "events"))
    folder = inputs.scratch(spark, "runs")
    streamed.run_to_versions(streamed.run_state_stream(lines, RUN, ORDER), f"{folder}/table", f"{folder}/checkpoint")
    return streamed.current_states(spark, f"{folder}/table", RUN)


_CURVE_SQL = """points AS (SELECT run_id, CASE event WHEN 'step' THEN 'train' ELSE 'val' END AS curve, seq, step, value AS loss FROM ev WHERE event IN ('step', 'eval') AND value > 0),
curves AS (SELECT run_id, curve, seq, step, loss FROM (SELECT *, lag(step) OVER (PARTITION BY run_id, curve ORDER BY seq) AS previous FROM points) WHERE previous IS NULL OR previous <> step)"""


@query("loss_curve", f"WITH {_RUN_SQL}, {_CURVE_SQL} SELECT * FROM curves")
def loss_curve(spark, sf_dir):
    return op.loss_curves(run_events(spark, sf_dir), RUN, ORDER)


@query(
    "loss_curve_scaled",
    f"""WITH {_RUN_SQL}, {_CURVE_SQL}, b AS (SELECT run_id, min(loss) AS lo, max(loss) AS hi, min(step) FILTER (curve = 'train') AS s0, max(step) FILTER (curve = 'train') AS s1 FROM curves GROUP BY run_id)
    SELECT run_id, curve, step, (step - s0) / CASE WHEN s1 - s0 = 0 THEN 1 ELSE s1 - s0 END AS x, (loss - lo) / CASE WHEN hi - lo = 0 THEN 1 ELSE hi - lo END AS y
    FROM curves JOIN b USING (run_id)""",
)
def loss_curve_scaled(spark, sf_dir):
    return op.scaled_curves(op.loss_curves(run_events(spark, sf_dir), RUN, ORDER), RUN)


_BEST_SQL = "best AS (SELECT run_id, seq, value AS val_loss, min(value) OVER (PARTITION BY run_id ORDER BY seq) AS best_val_loss FROM ev WHERE event = 'eval')"


@query("best_val_running", f"WITH {_RUN_SQL}, {_BEST_SQL} SELECT run_id, seq, val_loss, best_val_loss FROM best")
def best_val_running(spark, sf_dir):
    return op.best_validation(run_events(spark, sf_dir), RUN, ORDER).select(RUN, ORDER, "val_loss", "best_val_loss")


@query("val_health", f"WITH {_RUN_SQL}, {_BEST_SQL} SELECT run_id, seq, val_loss <= best_val_loss * 1.05::DOUBLE AS healthy FROM best")
def val_health(spark, sf_dir):
    return op.best_validation(run_events(spark, sf_dir), RUN, ORDER).select(RUN, ORDER, "healthy")


@query(
    "throughput",
    f"""WITH {_RUN_SQL}, s AS (SELECT run_id, seq, (sum(k) OVER (PARTITION BY run_id ORDER BY seq))::BIGINT AS tokens_so_far,
        epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY run_id) AS us FROM ev WHERE event = 'step')
    SELECT run_id, seq, tokens_so_far, CASE WHEN us > 0 THEN tokens_so_far / (us / 1000000) ELSE 0.0::DOUBLE END AS tok_s FROM s""",
)
def throughput(spark, sf_dir):
    steps = run_events(spark, sf_dir).where("ev.event = 'step'").select(RUN, ORDER, "k", metering.micros("ts").alias("us"))
    start = steps.groupBy(RUN).agg(F.min("us").alias("start"))
    timed = steps.join(start, RUN).withColumn("elapsed", (F.col("us") - F.col("start")) / 1_000_000)
    return op.throughput(timed, RUN, ORDER, "k", "elapsed").select(RUN, ORDER, "tokens_so_far", "tok_s")


# ---- plain log lines -------------------------------------------------------

_MESSAGES = [
    "STEP: epoch {} begins",
    "WARN: learning rate {} is high, STEP: goes on",
    "ERROR: worker {} failed",
    "CUDA out of memory on device {}",
    "401 Client Error: Unauthorized for url /{}",
    "GatedRepoError 401 token {} refused",
    "HTTP 401, token {} has expired",
    "❌ STEP: {} stopped",
    "saved {} tensors",
    "cuda oom at batch {}",
]
_MESSAGES_SQL = "[" + ", ".join(f"'{m}'" for m in _MESSAGES) + "]"


def _log_lines(spark, sf_dir):
    """Ten kinds of log lines and, in between, metric lines of the text log."""
    e = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    message = F.replace(F.get(F.array(*[F.lit(m) for m in _MESSAGES]), (e % 10).cast("int")), F.lit("{}"), k)
    metric = F.concat(F.lit("{'loss': "), (e % 300 / 100).cast("string"), F.lit(", 'epoch': "), (e % 40 / 10).cast("string"), F.lit("}"))
    meta = F.concat(
        F.lit('done TRAIN_META: {"loss": '), (e % 300 / 100).cast("string"), F.lit(', "total_steps": '), e.cast("string"), F.lit(', "ollama_ok": true}')
    )
    line = (
        F.when(e % 50 == 0, F.lit("EXPORT_DONE path=out"))
        .when(e % 9 == 0, meta)
        .when(e % 3 == 0, metric)
        .otherwise(message)
    )
    return inputs.table(spark, sf_dir, "events").select("event_id", "event_type", line.alias("line"))


_LOG_SQL = f"""
log AS (SELECT event_id, event_type, CASE WHEN event_id % 50 = 0 THEN 'export' WHEN event_id % 9 = 0 THEN 'meta' WHEN event_id % 3 = 0 THEN 'metric' ELSE 'text' END AS kind,
  event_id % 300 / 100 AS loss, event_id % 40 / 10 AS epoch, replace({_MESSAGES_SQL}[event_id % 10 + 1], '{{}}', props->>'k') AS line FROM events)
"""


@query(
    "log_metrics",
    f"""WITH {_LOG_SQL} SELECT event_id, CASE WHEN kind = 'metric' THEN loss END AS loss, CASE WHEN kind = 'metric' THEN epoch END AS epoch,
      CASE kind WHEN 'export' THEN 100 WHEN 'metric' THEN least(95, floor(epoch / {EPOCHS}::DOUBLE * 95)::BIGINT) END AS progress FROM log""",
)
def log_metrics(spark, sf_dir):
    line = F.col("line")
    return _log_lines(spark, sf_dir).select(
        "event_id",
        logs.logged_loss(line).alias("loss"),
        logs.logged_epoch(line).alias("epoch"),
        logs.progress(line, EPOCHS).alias("progress"),
    )


@query(
    "log_error_class",
    f"WITH {_LOG_SQL} SELECT event_id, CASE WHEN kind = 'text' THEN CASE event_id % 10 WHEN 3 THEN 'oom' WHEN 4 THEN 'auth' WHEN 5 THEN 'gated' WHEN 6 THEN 'auth' WHEN 9 THEN 'oom' END END AS error_class FROM log",
)
def log_error_class(spark, sf_dir):
    return _log_lines(spark, sf_dir).select("event_id", logs.error_class(F.col("line")).alias("error_class"))


@query(
    "log_severity",
    f"WITH {_LOG_SQL} SELECT event_id, CASE WHEN kind = 'text' THEN CASE event_id % 10 WHEN 0 THEN 'step' WHEN 1 THEN 'warn' WHEN 2 THEN 'error' WHEN 7 THEN 'error' ELSE '' END ELSE '' END AS severity FROM log",
)
def log_severity(spark, sf_dir):
    return _log_lines(spark, sf_dir).select("event_id", logs.severity(F.col("line")).alias("severity"))


@query("log_train_meta", f"WITH {_LOG_SQL} SELECT event_id, loss, event_id AS total_steps, true AS ollama_ok FROM log WHERE kind = 'meta'")
def log_train_meta(spark, sf_dir):
    found = _log_lines(spark, sf_dir).select("event_id", logs.train_meta(F.col("line")).alias("m")).where("m IS NOT NULL")
    return found.select("event_id", "m.*")


@query(
    "log_tail",
    """SELECT event_type, event_id, rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rank, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    WHERE rank <= CASE WHEN n <= 500 THEN n ELSE 300 + (n - 501) % 201 END""",
)
def log_tail(spark, sf_dir):
    """One bounded log per kind of event: few, long logs."""
    lines = inputs.table(spark, sf_dir, "events").select("event_type", "event_id")
    return op.log_tail(lines, "event_type", "event_id").select("event_type", "event_id", F.col("rank").cast("bigint").alias("rank"))


@query("strip_ansi", "SELECT event_id, event_type || ' ' || user_id || ' done' AS line FROM events")
def strip_ansi(spark, sf_dir):
    raw = F.concat(
        F.lit("\x1b[1;31m"), F.col("event_type"), F.lit("\x1b[0m \x1b]0;title\x07"), F.col("user_id").cast("string"), F.lit(" \x1b[2Kdone \n")
    )
    return inputs.table(spark, sf_dir, "events").select("event_id", tx.strip_ansi(raw).alias("line"))


# ---- runs, checkpoints, projects -------------------------------------------

_RECORDS_SQL = f"""{_RUN_SQL.strip()},
carried AS (SELECT *, last_value(CASE WHEN event = 'step' THEN value END IGNORE NULLS) OVER w AS final_loss,
  last_value(CASE WHEN event = 'init' THEN 'cuda:' || (k % 8) END IGNORE NULLS) OVER w AS device FROM ev WHERE event NOT IN ('log', 'broken')
  WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
records AS (SELECT 'run-' || seq AS id, run_id, seq, step AS steps, k * 1.5::DOUBLE AS elapsed_sec, coalesce(final_loss, 0) AS final_loss, value AS final_val_loss,
  'final.pt' AS checkpoint_path, coalesce(device, 'unknown') AS device FROM carried WHERE event = 'done')"""


@query("run_history", f"WITH {_RECORDS_SQL} SELECT * FROM records ORDER BY seq DESC LIMIT 100")
def run_history(spark, sf_dir):
    return op.history(op.run_records(run_events(spark, sf_dir), RUN, ORDER), ORDER)


@query("run_history_delete", f"WITH {_RECORDS_SQL} SELECT * FROM records WHERE NOT (seq % 4 = 0)")
def run_history_delete(spark, sf_dir):
    unwanted = inputs.table(spark, sf_dir, "events").where("event_id % 4 = 0").select(
        F.concat(F.lit("run-"), F.col("event_id").cast("string")).alias("id")
    )
    return op.delete_records(op.run_records(run_events(spark, sf_dir), RUN, ORDER), unwanted)


def checkpoint_manifest(spark, sf_dir):
    """Purchases as checkpoint files and folders of their user's project, with a short training log."""
    e = F.col("event_id")
    name = F.when(e % 4 == 0, F.concat(F.lit("checkpoint-"), e.cast("string"))).otherwise(
        F.concat(F.lit("step_"), F.lpad(e.cast("string"), 8, "0"), F.when(e % 9 == 0, "_final").otherwise(""), F.lit(".pt"))
    )
    no_number = F.lit(None).cast("double")
    entry = F.struct(
        F.when(e % 5 != 0, F.col("value")).otherwise(no_number).alias("loss"),
        F.when(e % 5 == 0, F.col("value") * 2).otherwise(no_number).alias("train_loss"),
        (e % 30 / 10).alias("epoch"),
    )
    first = F.struct(F.lit(9.0).alias("loss"), no_number.alias("train_loss"), F.lit(0.0).alias("epoch"))
    log = F.when(e % 6 == 0, F.array().cast("array<struct<loss:double,train_loss:double,epoch:double>>")).otherwise(F.array(first, entry))
    return inputs.table(spark, sf_dir, "events").where("event_type = 'purchase'").select(
        F.col("user_id").alias("project"), e.alias("ord"), name.alias("name"), (e * 1000).alias("size"), log.alias("log_history")
    )


_CKPT_SQL = """
ckpt AS (SELECT user_id AS project, event_id AS ord, CASE WHEN event_id % 4 = 0 THEN 'checkpoint-' || event_id ELSE 'step_' || lpad(event_id::VARCHAR, 8, '0') || CASE WHEN event_id % 9 = 0 THEN '_final' ELSE '' END || '.pt' END AS name,
  event_id * 1000 AS size, event_id AS step, event_id % 4 <> 0 AND event_id % 9 = 0 AS is_final,
  CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 5 = 0 THEN value * 2 ELSE value END AS loss, CASE WHEN event_id % 6 <> 0 THEN event_id % 30 / 10 END AS epoch
  FROM events WHERE event_type = 'purchase')
"""


@query("checkpoint_list", f"WITH {_CKPT_SQL} SELECT project, name, size, step, is_final, loss, epoch FROM ckpt")
def checkpoint_list(spark, sf_dir):
    return op.checkpoints(checkpoint_manifest(spark, sf_dir)).select("project", "name", "size", "step", "is_final", "loss", "epoch")


def projects(spark, sf_dir):
    """Customers as projects: label, wanted vocabulary and sequence length, merged-model flag."""
    c = F.col("c_custkey")
    return inputs.table(spark, sf_dir, "customer").select(
        c.alias("project"),
        F.when(c % 3 != 0, F.col("c_name")).alias("label"),
        F.when(c % 2 == 0, 8000).otherwise(16000).alias("vocab_size"),
        F.when(c % 5 == 0, 1024).otherwise(512).alias("max_seq_len"),
        (c % 11 == 0).alias("has_merged"),
    )


@query(
    "checkpoint_project_join",
    f"""WITH {_CKPT_SQL} SELECT project, name, step, CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE c_custkey::VARCHAR END AS project_label
    FROM ckpt JOIN customer ON c_custkey = project""",
)
def checkpoint_project_join(spark, sf_dir):
    rows = op.checkpoints(checkpoint_manifest(spark, sf_dir)).select("project", "name", "step")
    return op.with_project(rows, projects(spark, sf_dir), "project")


@query("latest_checkpoint", f"WITH {_CKPT_SQL} SELECT project, max(name) AS name FROM ckpt GROUP BY project")
def latest_checkpoint(spark, sf_dir):
    return op.latest_checkpoint(checkpoint_manifest(spark, sf_dir), "project")


@query(
    "even_spaced_pick",
    f"""WITH {_CKPT_SQL}, n AS (SELECT project, name, row_number() OVER (PARTITION BY project ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY project) AS n FROM ckpt),
    p AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY i) AS r FROM n WHERE n <= 4 OR i % greatest(n // 4, 1) = 0 OR i = n - 1)
    SELECT project, name, i AS place FROM p WHERE r <= 4""",
)
def even_spaced_pick(spark, sf_dir):
    rows = checkpoint_manifest(spark, sf_dir).select("project", "ord", "name")
    return op.evenly_spaced(rows, "project", "ord").select("project", "name", "place")


@query(
    "sample_timeline",
    f"""WITH {_RUN_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS rank FROM ev WHERE event = 'sample')
    SELECT run_id, rank, step, 0 AS item, 'Once' AS prompt, ' upon ' || k AS generated FROM s WHERE rank <= 5 UNION ALL
    SELECT run_id, rank, step, 1, 'The', ' ' || seq FROM s WHERE rank <= 5""",
)
def sample_timeline(spark, sf_dir):
    return op.sample_timeline(run_events(spark, sf_dir), RUN, ORDER)


def _artefacts(spark, sf_dir):
    """Orders as the artefacts of their customer's project."""
    kind = (
        F.when(F.col("o_orderkey") % 7 == 0, "tokenizer")
        .when(F.col("o_orderstatus") == "O", "dataset")
        .when(F.col("o_orderstatus") == "F", "processed")
        .otherwise("checkpoint")
    )
    return inputs.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("project"), kind.alias("kind"), F.col("o_orderkey").alias("ord")
    )


_ARTEFACT_SQL = """art AS (SELECT o_custkey AS project, o_orderkey AS ord, CASE WHEN o_orderkey % 7 = 0 THEN 'tokenizer' WHEN o_orderstatus = 'O' THEN 'dataset' WHEN o_orderstatus = 'F' THEN 'processed' ELSE 'checkpoint' END AS kind FROM orders),
proj AS (SELECT c_custkey AS project, CASE WHEN c_custkey % 2 = 0 THEN 8000 ELSE 16000 END AS vocab_size, CASE WHEN c_custkey % 5 = 0 THEN 1024 ELSE 512 END AS max_seq_len FROM customer)"""


@query(
    "project_step_status",
    f"""WITH {_ARTEFACT_SQL} SELECT project, count(*) FILTER (kind = 'tokenizer') > 0 AS has_tokenizer, count(*) FILTER (kind = 'dataset') > 0 AS has_dataset,
      count(*) FILTER (kind = 'processed') > 0 AS has_processed, count(*) FILTER (kind = 'checkpoint') > 0 AS has_checkpoint FROM proj LEFT JOIN art USING (project) GROUP BY project""",
)
def project_step_status(spark, sf_dir):
    return op.project_steps(projects(spark, sf_dir), _artefacts(spark, sf_dir), "project")


@query(
    "preflight_issues",
    f"""WITH {_ARTEFACT_SQL}, tok AS (SELECT DISTINCT project, CASE WHEN project % 3 = 0 THEN 16000 ELSE 8000 END AS v FROM art WHERE kind = 'tokenizer'),
    pro AS (SELECT project, CASE WHEN min(ord) % 3 = 0 THEN 1024 ELSE 512 END AS l FROM art WHERE kind = 'processed' GROUP BY project)
    SELECT project, CASE WHEN v IS NULL THEN 'no tokenizer' ELSE 'vocabulary size differs' END AS issue FROM proj LEFT JOIN tok USING (project) WHERE v IS NULL OR v <> vocab_size UNION ALL
    SELECT project, CASE WHEN l IS NULL THEN 'no processed data' ELSE 'sequence length differs' END FROM proj LEFT JOIN pro USING (project) WHERE l IS NULL OR l <> max_seq_len""",
)
def preflight_issues(spark, sf_dir):
    artefacts = _artefacts(spark, sf_dir)
    tokenizers = artefacts.where("kind = 'tokenizer'").groupBy("project").agg(
        F.when(F.col("project") % 3 == 0, 16000).otherwise(8000).alias("vocab_size")
    )
    processed = artefacts.where("kind = 'processed'").select(
        "project", "ord", F.when(F.col("ord") % 3 == 0, 1024).otherwise(512).alias("max_seq_len")
    )
    return op.preflight_issues(projects(spark, sf_dir), tokenizers, processed, "project")


@query(
    "project_overview",
    f"""WITH {_CKPT_SQL}, {_RUN_SQL}, {_STATE_SQL}, c AS (SELECT project, count(*) AS n FROM ckpt GROUP BY project)
    SELECT c_custkey AS project, coalesce(n, 0) AS checkpoint_count, CASE WHEN running IS NULL THEN 'design' WHEN running THEN 'running' ELSE 'done' END AS status, c_custkey % 11 = 0 AS has_merged
    FROM customer LEFT JOIN c ON project = c_custkey LEFT JOIN state ON run_id = c_custkey ORDER BY project DESC""",
)
def project_overview(spark, sf_dir):
    states = op.latest_state(run_events(spark, sf_dir), RUN, ORDER).withColumnRenamed(RUN, "project")
    return op.project_overview(projects(spark, sf_dir), checkpoint_manifest(spark, sf_dir), states, "project")
