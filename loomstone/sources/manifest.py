"""Choosing which parts of a published data set to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def select_split(parts: DataFrame, dataset: str = "dataset", config: str = "default") -> DataFrame:
    """Parts of the chosen configuration and split of every data set.

    The wanted configuration if there, else the first listed; of its splits
    ``train``, else ``all``, else the first listed. ``parts`` has config,
    split and ord (listing order). Only partial aggregates and a semi-join.
    """
    split_rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "all", 1).otherwise(2)
    best_split = F.min(
        F.struct(split_rank.alias("rank"), F.when(split_rank == 2, F.col("ord")).otherwise(0).alias("first"), "split")
    )
    per_config = parts.groupBy(dataset, "config").agg(best_split.alias("best"), F.min("ord").alias("first"))
    chosen = (
        per_config.groupBy(dataset)
        .agg(
            F.min(
                F.struct((F.col("config") != config).alias("other"), "first", "config", F.col("best.split").alias("split"))
            ).alias("pick")
        )
        .select(dataset, "pick.config", "pick.split")
    )
    return parts.join(chosen, [dataset, "config", "split"], "left_semi")
