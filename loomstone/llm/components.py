"""Connected components of an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Every node of ``edges`` (``a``, ``b``) with the smallest node it reaches, as (``node``, ``comp``).

    Rounds of taking the smallest neighbouring label and then the label's own label,
    so a chain of length n needs about log2(n) rounds. Labels of a round are a
    written table; only the number of changed labels comes to the driver. Edges with a
    null end are left out; an empty table gives an empty result.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.keep(both, f"{name}-edges")
    labels = scratch.keep(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp")),
        f"{name}-0",
    )
    step = 0
    while True:
        step += 1
        seen = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").select(F.col("a").alias("node"), "comp", F.lit(None).cast("bigint").alias("was"))
        lower = seen.unionAll(labels.select("node", "comp", F.col("comp").alias("was"))).groupBy("node").agg(
            F.min("comp").alias("mid"), F.max("was").alias("was")
        )
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("further"))
        after = scratch.keep(
            lower.join(jump, "mid").select("node", "was", F.least("mid", "further").alias("comp")), f"{name}-{step}"
        )
        changed = after.where("was <> comp").limit(1).count()
        scratch.drop(f"{name}-{step - 1}")
        labels = after.select("node", "comp")
        if not changed:
            return labels
