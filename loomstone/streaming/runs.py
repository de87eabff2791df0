"""Training-run state over a stream of output lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import telemetry as op


def run_state_stream(lines: DataFrame, run: str, order: str, line: str = "line") -> DataFrame:
    """The folded state of every run, as a streaming aggregate (update mode).

    The fold keeps the newest value of each event kind, which is a built-in
    aggregate, so state lives in the state store and no Python runs.
    """
    return op.latest_state(op.parse_lines(lines, line), run, order)


# Micro-batches whose changes are kept apart before they are folded into the base.
COMPACT_EVERY = 10


def _folders(spark: SparkSession, path: str) -> tuple[object, list[int], list[int]]:
    """The file system, and the numbers of finished bases and of change sets."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    system = place(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(kind: str) -> list[int]:
        if not system.exists(place(f"{path}/{kind}")):
            return []
        names = [s.getPath().getName() for s in system.listStatus(place(f"{path}/{kind}"))]
        return sorted(int(n.partition("=")[2]) for n in names if "=" in n and system.exists(place(f"{path}/{kind}/{n}/_SUCCESS")))

    return system, numbers("base"), numbers("changes")


def run_to_versions(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Upsert the runs changed by each micro-batch; a repeated batch replaces itself.

    Changes are kept under the batch's number; every ``COMPACT_EVERY`` batches they are folded into a new base, a row a run, and
    what the base holds is removed, so the table never has more than the runs and the changes of a few batches.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number}")
        if (number + 1) % COMPACT_EVERY == 0:
            _compact(batch.sparkSession, path, batch.columns[0], number)

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def _compact(spark: SparkSession, path: str, run: str, number: int) -> None:
    current_states(spark, path, run).write.mode("overwrite").parquet(f"{path}/base/batch={number}")
    system, bases, changes = _folders(spark, path)
    place = spark._jvm.org.apache.hadoop.fs.Path
    # The base before stays for readers that have just begun.
    for n in [b for b in bases if b < number][:-1]:
        system.delete(place(f"{path}/base/batch={n}"), True)
    kept_from = max([b for b in bases if b < number], default=-1)
    for n in [c for c in changes if c <= kept_from]:
        system.delete(place(f"{path}/changes/batch={n}"), True)


def current_states(spark: SparkSession, path: str, run: str) -> DataFrame:
    """The newest version of every run's state: the newest base and the changes since."""
    _, bases, changes = _folders(spark, path)
    base = bases[-1] if bases else -1
    parts = [(f"{path}/base/batch={base}", base)] if bases else []
    parts += [(f"{path}/changes/batch={n}", n) for n in changes if n > base]
    versions = None
    for folder, n in parts:
        part = spark.read.parquet(folder).withColumn("batch", F.lit(n))
        versions = part if versions is None else versions.unionByName(part)
    if versions is None:
        raise FileNotFoundError(f"{path}: no states yet")
    columns = [c for c in versions.columns if c not in (run, "batch")]
    newest = versions.groupBy(run).agg(F.max_by(F.struct(*columns), "batch").alias("s"))
    return newest.select(run, *[F.col(f"s.{c}").alias(c) for c in columns])
