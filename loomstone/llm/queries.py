"""Registered queries of the operators, one per operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, html_text, language_id, language_model, line_dedup, mixing, near_dedup, nearest, quality, structure_repair, tool_calls, toxicity, whitening
from .common import Scratch, remainder, table

Query = Callable[[SparkSession, str], DataFrame]

TOOLS = {
    "search": '{"type":"object","required":["query"],"properties":{"query":{"type":"string","minLength":1,"maxLength":200},"turn":{"type":"integer"}},"additionalProperties":false}',
    "lookup": '{"type":"object","required":["query","turn"],"properties":{"query":{"type":"string"},"turn":{"type":"integer","maximum":4}}}',
}


def tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tool traffic: a user turn asks a tool, the assistant turn after it is the tool's result.

    A call waits for the conversation's user turn two before it, if there is one.
    """
    turns = table(spark, sf_dir, "conversations")
    name = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("translate")), (F.col("conv_id") % 3 + 1).cast("int"))
    call = F.struct(
        F.concat(F.lit("c"), "turn").alias("id"),
        F.struct(name.alias("name"), F.to_json(F.struct(F.col("text").alias("query"), "turn")).alias("arguments")).alias("function"),
        F.array(F.concat(F.lit("c"), F.col("turn") - 2)).alias("depends_on"),
    )
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.lit("assistant").alias("role"), F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text"))
    given = turns.where("role = 'assistant'").select(
        "conv_id", "turn", F.lit("tool").alias("role"),
        F.to_json(F.struct(F.concat(F.lit("c"), F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content"))).alias("text"),
    )
    return asked.unionAll(given)


def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.parse_messages(tool_messages(spark, sf_dir))
    schemas = spark.createDataFrame(sorted(TOOLS.items()), "name string, schema string")
    linked = tool_calls.link(calls, results, schemas, Scratch(spark, "tool-calls"))
    return linked.withColumn("conv_id", F.col("conv").cast("bigint")).drop("conv")


OP1_SQL = """
WITH u AS (
  SELECT conv_id, turn, text, ['search', 'lookup', 'translate'][conv_id % 3 + 1] AS name FROM conversations WHERE role = 'user'
), a AS (
  SELECT conv_id, turn - 1 AS turn, text, turn AS at FROM conversations WHERE role = 'assistant'
), runs AS (
  SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM u
), l AS (
  SELECT conv_id, turn, name, text, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn) - 1 AS level FROM runs
), j AS (
  SELECT coalesce(l.conv_id, a.conv_id) AS conv_id, 'c' || coalesce(l.turn, a.turn) AS call, coalesce(l.turn, a.at) AS turn, l.level,
    CASE WHEN l.conv_id IS NULL THEN 'no_call' WHEN a.conv_id IS NULL THEN 'no_result' ELSE 'linked' END AS status,
    CASE WHEN a.conv_id IS NULL THEN 0 ELSE 1 END AS n_results,
    CASE WHEN l.conv_id IS NOT NULL AND l.level = 0 THEN 1 ELSE 0 END AS missing,
    CASE WHEN l.conv_id IS NULL THEN '' WHEN l.name = 'translate' THEN '$: unknown tool'
         WHEN l.name = 'search' AND length(l.text) NOT BETWEEN 1 AND 200 THEN '$.query: length'
         WHEN l.name = 'lookup' AND l.turn > 4 THEN '$.turn: range' ELSE '' END AS errors,
    CASE WHEN l.conv_id IS NULL THEN '{"arguments":null,"depends_on":[],"id":"c' || a.turn || '","name":null,"result":' || to_json(a.text) || '}'
         ELSE '{"arguments":{"query":' || to_json(l.text) || ',"turn":' || l.turn || '},"depends_on":["c' || (l.turn - 2) || '"],"id":"c' || l.turn
           || '","name":"' || l.name || '","result":' || coalesce(to_json(a.text)::VARCHAR, 'null') || '}' END AS canonical
  FROM l FULL JOIN a ON l.conv_id = a.conv_id AND l.turn = a.turn
)
SELECT conv_id, call, turn, level::INT AS level,
  row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(level, 1073741824), turn, call) AS order_no,
  status, n_results::BIGINT AS n_results, missing::BIGINT AS missing, errors = '' AND status <> 'no_call' AS valid, errors, canonical
FROM j
"""


def _held(df: DataFrame, divisor: int, rest: int) -> DataFrame:
    return df.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), divisor) == rest, F.lit(False)))


def op2_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    network = quality.fit(docs, labels.where(remainder(F.col("doc_id"), 5) != 0), label_col="quality")
    return _held(quality.score(docs, network), 5, 0)


def op3_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(remainder(F.col("doc_id"), 5) != 0), grade_col="toxic")
    return _held(toxicity.severity(docs, model), 5, 0)


def op4_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix_sources(table(spark, sf_dir, "documents"), Scratch(spark, "mixing")))


def op7_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learns = remainder(F.col("doc_id"), 7) != 2
    holds = F.floor(F.crc32(F.col("doc_id").cast("string")) / 7) % language_model.FOLDS == 0
    return _held(language_model.score(docs, learns, holds), 7, 2)


def op9_hierarchical_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machines = language_id.fit(docs.where(remainder(F.col("doc_id"), 4) != 2))
    return _held(language_id.predict(docs, machines), 4, 2)


def op10_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), lambda key: key % 20 == 0)


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    every = turns.select(F.col("conv_id").alias("conv"))
    repaired = structure_repair.repair(structure_repair.damage(turns), Scratch(spark, "repair"), every)
    return repaired.withColumnRenamed("conv", "conv_id")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), Scratch(spark, "line-dedup"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP13_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), f AS (
  SELECT k.*, coalesce(r.keeper <> k.doc_id, false) AS gone FROM k LEFT JOIN r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_tool_call_linking, op2_attention_quality, op3_ordinal_toxicity, op4_line_block_text, op5_minhash_near_dedup, op6_source_mixing,
        op7_pigeonhole_decontamination, op8_deleted_interpolation, op9_hierarchical_language, op10_block_matrix_neighbours, op11_structure_repair, op12_whitening,
        op13_line_dedup,
    )
}
ORACLES: dict[str, str] = {"op1_tool_call_linking": OP1_SQL, "op13_line_dedup": OP13_SQL}
