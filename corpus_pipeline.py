"""Training corpus from ``documents``: bad and toxic texts out, one of each near-duplicate group, no benchmark items, mixed by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomstone.llm import decontaminate, mixing, near_dedup, quality, toxicity
from loomstone.llm.common import Scratch, table

#: No stage but the last could be stated in SQL: learned models, MinHash components and edit distances.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; a null id is never rejected."""
    network = quality.fit(docs, table(spark, sf_dir, "labels"), label_col="quality")
    rejected = quality.score(docs, network).where("predicted = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not judged toxic; a null id is never rejected."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), grade_col="toxic")
    rejected = toxicity.severity(docs, model).where("toxic AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every group of near duplicates; its repeated rows become one."""
    gone = near_dedup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    known, unknown = kept.where("doc_id IS NOT NULL"), kept.where("doc_id IS NULL")
    return known.dropDuplicates(["doc_id", "text"]).unionAll(unknown)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    leaks = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark")).select("doc_id").where("doc_id IS NOT NULL").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mixture takes."""
    return mixing.taken_words(mixing.mix_sources(docs, Scratch(spark, "mixing")))


STAGES = [
    ("quality_classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", one_of_each),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and reread as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    scratch.drop(*[name for name, _ in STAGES[:-1]])
    return docs
