"""Running aggregates that do not send a key, or the whole table, through one task.

``Window.partitionBy(key).orderBy(...)`` sorts a key's rows in a single task,
and an unpartitioned window sorts the table there. Here a coarse *bucket* of
the order column splits every key: totals per bucket are tiny after partial
aggregation, their exclusive prefix is computed on its own, and only the rows
of one (key, bucket) ever meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_BUCKET = "__bucket"
_PARENT = "__parent"
_AGG = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
_MERGE = {"sum": "sum", "count": "sum", "min": "min", "max": "max", "last": "last"}


def _total(op: str, value: Column, order: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), order)) if op == "last" else _AGG[op](value)


def _over(op: str, value: Column, window) -> Column:
    return (F.last(value, ignorenulls=True) if op == "last" else _AGG[op](value)).over(window)


def _combine(op: str, before: Column, here: Column) -> Column:
    if op in ("sum", "count"):
        return F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
    if op == "min":
        return F.least(before, here)
    if op == "max":
        return F.greatest(before, here)
    return F.coalesce(here, before)


def _before(*keys: str):
    window = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return window.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)


def _bucket_prefix(totals: DataFrame, by: list[str], ops: dict[str, str], levels: int, fan_out: int) -> DataFrame:
    """Exclusive prefix of the bucket totals, through coarser buckets while ``levels`` last."""
    merge = {name: _MERGE[op] for name, op in ops.items()}
    if levels == 0:
        window = _before(*by)
        return totals.select(*by, _BUCKET, *[_over(op, F.col(n), window).alias(n) for n, op in merge.items()])
    fine = totals.withColumn(_PARENT, F.expr(f"{_BUCKET} div {fan_out}"))
    coarse = fine.groupBy(*by, _PARENT).agg(
        *[_total(op, F.col(n), F.col(_BUCKET)).alias(n) for n, op in merge.items()]
    )
    above = _bucket_prefix(coarse.withColumnRenamed(_PARENT, _BUCKET), by, merge, levels - 1, fan_out)
    above = above.select(*by, F.col(_BUCKET).alias(_PARENT), *[F.col(n).alias(f"__up_{n}") for n in merge])
    window = _before(*by, _PARENT)
    local = fine.select(*by, _PARENT, _BUCKET, *[_over(op, F.col(n), window).alias(n) for n, op in merge.items()])
    return local.join(above, [*by, _PARENT], "left").select(
        *by, _BUCKET, *[_combine(op, F.col(f"__up_{n}"), F.col(n)).alias(n) for n, op in merge.items()]
    )


def running(
    df: DataFrame,
    by: list[str],
    order: list[str],
    bucket: Column,
    aggs: dict[str, tuple[str, str]],
    exclusive: bool = False,
    levels: int | None = None,
    fan_out: int = 4096,
    bounds: bool = False,
) -> DataFrame:
    """Add running aggregates of ``{name: (op, column)}`` per key in the given order.

    ``op`` is sum, count, min, max or last (non-null); with ``exclusive`` the
    current row is left out, so ``last`` is the previous value. ``bucket`` is a whole
    number that never decreases along ``order`` (``rec_no div 1024``, a day
    number) and bounds how many rows of a key meet in one task. ``levels``
    adds coarser buckets above it; by default one when there is no key.

    With ``bounds`` the result keeps the ``bucket`` it is partitioned by and,
    for every aggregate, ``<name>_from`` and ``<name>_to``: its value before
    and after the whole bucket. Grouping by the bucket then needs no shuffle.
    """
    if levels is None:
        levels = 0 if by else 1
    ops = {name: op for name, (op, _) in aggs.items()}
    ranked = df.withColumn(_BUCKET, bucket.cast("bigint"))
    order_key = F.struct(*order)
    totals = ranked.groupBy(*by, _BUCKET).agg(
        *[_total(op, F.col(c), order_key).alias(name) for name, (op, c) in aggs.items()]
    )
    prefix = _bucket_prefix(totals, by, ops, levels, fan_out)
    prefix = prefix.select(*by, _BUCKET, *[F.col(n).alias(f"__pre_{n}") for n in ops])
    if bounds:
        prefix = totals.withColumnsRenamed({n: f"__all_{n}" for n in ops}).join(prefix, [*by, _BUCKET], "left")
    inside = (
        Window.partitionBy(*by, _BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    )
    placed = ranked.select("*", *[_over(op, F.col(c), inside).alias(f"__in_{n}") for n, (op, c) in aggs.items()])
    extra = []
    if bounds:
        extra.append(F.col(_BUCKET).alias("bucket"))
        for n, op in ops.items():
            nothing = F.lit(0) if op in ("sum", "count") else F.lit(None)
            extra.append(F.coalesce(F.col(f"__pre_{n}"), nothing).alias(f"{n}_from"))
            extra.append(_combine(op, F.col(f"__pre_{n}"), F.col(f"__all_{n}")).alias(f"{n}_to"))
    return placed.join(prefix, [*by, _BUCKET], "left").select(
        *df.columns,
        *[_combine(op, F.col(f"__pre_{n}"), F.col(f"__in_{n}")).alias(n) for n, op in ops.items()],
        *extra,
    )


def last_k(df: DataFrame, by: list[str], order: list[str], bucket: Column, k: int, rank: str = "rank") -> DataFrame:
    """The last ``k`` rows of every key with their rank from the end.

    Rows per bucket are counted first; only buckets with fewer than ``k`` rows
    after them are ranked, so a key of any size costs one bucket more than ``k``.
    """
    bucketed = df.withColumn(_BUCKET, bucket.cast("bigint"))
    after = Window.partitionBy(*by).orderBy(F.desc(_BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    late = (
        bucketed.groupBy(*by, _BUCKET)
        .agg(F.count("*").alias("__n"))
        .withColumn("__after", F.coalesce(F.sum("__n").over(after), F.lit(0)))
        .where(F.col("__after") < k)
        .select(*by, _BUCKET)
    )
    newest = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return (
        bucketed.join(late, [*by, _BUCKET], "left_semi")
        .withColumn(rank, F.row_number().over(newest))
        .where(F.col(rank) <= k)
        .drop(_BUCKET)
    )
