"""Inputs of the named queries: the given tables and data derived from them.

Conversations are re-serialised in the foreign record formats the converters
accept, events stand for API requests and for training-run events, and parts,
customers and orders stand for catalogues and projects. Every derivation is a
row-local expression or an equi-join, so it grows with the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir, spread

# Number of record formats in `foreign_rows`.
FORMATS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which every executor sees."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The text corpus with only the columns asked for, evened out over the cores."""
    return spread(table(spark, sf_dir, "documents").select(*columns))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn that directly follows it."""
    turns = conversations(spark, sf_dir)
    user = turns.where("role = 'user'").select(
        "conv_id", "turn", (F.col("turn") + 1).alias("next_turn"), F.col("text").alias("user_text")
    )
    reply = turns.where("role = 'assistant'").select(
        "conv_id", F.col("turn").alias("next_turn"), F.col("text").alias("assistant_text")
    )
    return user.join(reply, ["conv_id", "next_turn"]).select("conv_id", "turn", "user_text", "assistant_text")


PAIRS_SQL = """
pairs AS (
  SELECT u.conv_id, u.turn, u.text AS user_text, a.text AS assistant_text
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)
"""


def foreign_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as JSON lines in six record formats, chosen by position."""
    u, a = F.col("user_text"), F.col("assistant_text")
    fmt = (F.col("conv_id") + F.col("turn")) % FORMATS
    system = F.concat(F.lit("You are helper "), (F.col("conv_id") % 3).cast("string"))

    def turn(role: str, text):
        return F.struct(F.lit(role).alias("from"), text.alias("value"))

    line = (
        F.when(fmt == 0, F.to_json(F.struct(u.alias("instruction"), F.lit("").alias("input"), a.alias("output"))))
        .when(fmt == 1, F.to_json(F.struct(system.alias("system_prompt"), u.alias("question"), a.alias("response"))))
        .when(fmt == 2, F.to_json(F.struct(u.alias("prompt"), a.alias("completion"))))
        .when(fmt == 3, F.to_json(F.struct(u.alias("query"), a.alias("answer"))))
        .when(fmt == 4, F.to_json(F.struct(F.array(turn("human", u), turn("gpt", a)).alias("conversations"))))
        .otherwise(F.to_json(F.struct(u.alias("title"), a.alias("body"))))
    )
    return pairs(spark, sf_dir).select(
        "conv_id", "turn", fmt.cast("int").alias("fmt"), "user_text", "assistant_text", line.alias("line")
    )


def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`foreign_rows` as a file: some lines cut short (malformed), some blank, some not an object."""
    number = F.col("conv_id") * 100 + F.col("turn")
    return foreign_rows(spark, sf_dir).select(
        "conv_id",
        "turn",
        "fmt",
        number.alias("line_no"),
        F.when(number % 11 == 0, F.lit("   "))
        .when(number % 7 == 0, F.expr("substring(line, 1, length(line) div 2)"))
        .when(number % 13 == 0, F.concat(F.lit("["), F.col("line"), F.lit("]")))
        .otherwise(F.col("line"))
        .alias("line"),
    )


DIRTY_SQL = f"""
{PAIRS_SQL.strip()},
dirty AS (
  SELECT conv_id, turn, ((conv_id + turn) % 6)::INT AS fmt, conv_id * 100 + turn AS line_no, user_text, assistant_text,
    CASE WHEN (conv_id * 100 + turn) % 11 = 0 THEN 'blank' WHEN (conv_id * 100 + turn) % 7 = 0 THEN 'malformed'
         WHEN (conv_id * 100 + turn) % 13 = 0 THEN 'list' ELSE 'good' END AS kind
  FROM pairs
)
"""
