"""Training-log lines: event parsing, metrics, error classes and severities."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import text as tx

# Fields of the training events and of the meta payload.
EVENT_SCHEMA = (
    "event string, step bigint, total bigint, loss double, lr double, tok_s double, elapsed double, "
    "val_loss double, best_val_loss double, final_val_loss double, path string, params bigint, device string, "
    "msg string, samples array<struct<prompt:string,text:string>>"
)
META_SCHEMA = "loss double, total_steps bigint, ollama_ok boolean"

# Patterns and markers of the text log.
LOSS_PATTERN = r"'loss':\s*([\d.]+)"
EPOCH_PATTERN = r"'epoch':\s*([\d.]+)"
EXPORT_MARKER = "EXPORT_DONE"
META_MARKER = "TRAIN_META:"
GATED_MARKERS = ["gatedrepoerror", "gated repo", "authorized list"]
MEMORY_MARKERS = ["out of memory", "cuda oom"]


def contains_any(c: Column, markers: list[str]) -> Column:
    found = F.lit(False)
    for marker in markers:
        found = found | F.contains(c, F.lit(marker))
    return found


def parse_event(line: Column) -> Column:
    """Event struct of a line that is a JSON object, null for any other line."""
    return F.when(
        F.startswith(line, F.lit("{")) & tx.valid_json(line), F.from_json(line, EVENT_SCHEMA, tx.ANY_LENGTH)
    )


def _number(line: Column, pattern: str) -> Column:
    return F.when(
        F.contains(line, F.lit("'loss'")), F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    ).try_cast("double")


def logged_loss(line: Column) -> Column:
    return _number(line, LOSS_PATTERN)


def logged_epoch(line: Column) -> Column:
    return _number(line, EPOCH_PATTERN)


def progress(line: Column, epochs: float) -> Column:
    """Percent done: up to 95 by epoch, 100 at the export marker, null when the line says nothing."""
    percent = F.floor(logged_epoch(line) / F.lit(float(epochs)) * 95)
    by_epoch = F.when(percent > 95, 95).otherwise(percent).cast("bigint")
    return F.when(F.contains(line, F.lit(EXPORT_MARKER)), F.lit(100).cast("bigint")).otherwise(by_epoch)


def error_class(line: Column) -> Column:
    """gated, auth or oom, by the first rule that applies."""
    lowered = F.lower(line)
    return (
        F.when(contains_any(lowered, GATED_MARKERS), "gated")
        .when(F.contains(line, F.lit("401")) & contains_any(lowered, ["unauthorized", "token"]), "auth")
        .when(contains_any(lowered, MEMORY_MARKERS), "oom")
    )


def severity(line: Column) -> Column:
    """warn over error over step; empty when none applies."""
    return (
        F.when(F.contains(line, F.lit("WARN")), "warn")
        .when(contains_any(line, ["ERROR", "❌"]), "error")
        .when(F.contains(line, F.lit("STEP:")), "step")
        .otherwise("")
    )


def train_meta(line: Column) -> Column:
    """Payload of a meta line, null elsewhere."""
    payload = F.get(F.split(line, META_MARKER), F.lit(1))
    return F.when(F.contains(line, F.lit(META_MARKER)), F.from_json(F.trim(payload), META_SCHEMA, tx.ANY_LENGTH))
