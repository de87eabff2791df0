"""Mixing sources to target weights, in DataFrame operations only.

The words of each source, in document order, are packed into blocks of ``BLOCK`` words. Output
shards of ``SHARD`` slots draw how many blocks they take from every source from one multinomial
distribution; a source's slots are numbered through the shards, number ``j`` is mapped to a
block by a pseudorandom permutation of the source's block indexes (a swap-or-not
shuffle, one permutation per pass over the source), and blocks are joined by that index. Draws beyond
a source's quota are left out and what is short of it fills further shards, so each
source gives exactly its quota of blocks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.scan import running
from .common import Scratch

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 128
SHARD = 1024
ROUNDS = 24
CELLS = 4096
TASK_SLOTS = 1 << 18
NOT_SPACE = r"[^\x20\x09-\x0D]+"


class Mix(NamedTuple):
    """``sources``: quotas; ``places``: where each document's words lie; ``slots``: what each output slot takes."""

    sources: DataFrame
    places: DataFrame
    slots: DataFrame


def source_key(source: Column) -> Column:
    """Text that sorts sources by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Words wanted of each source (``key``, ``source_size``): ``target``.

    Sources by key weigh ``weights``, repeating. ``share`` times all words is split by weight; a source
    above ``most`` times its size stays there and its excess goes to the others by weight. With
    sources by ascending size per weight, one is capped just when its cap is below
    what the words and weights left by those before it would give it.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("key")
    everything = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (((F.row_number().over(order) - 1) % len(weights)) + 1).cast("int"))
    weighed = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * most).withColumn(
        "total", F.sum("source_size").over(everything) * share
    )
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    left = weighed.withColumn("words_left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    left = left.withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    capped = F.col("cap") * F.col("weight_left") <= F.col("words_left") * F.col("weight")
    level = F.max(F.when(~F.col("capped"), F.col("words_left") / F.col("weight_left"))).over(everything)
    return left.withColumn("capped", capped).select(
        "key", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * level).alias("target")
    )


def permuted(index: Column, n: Column, *tweak: Column, rounds: int = ROUNDS) -> Column:
    """Place of ``index`` under a pseudorandom permutation of 0..n-1 chosen by ``tweak``.

    Each round pairs i with (k - i) mod n for a k of that round, and swaps the pair
    if one bit hashed from its larger member says so; a pair is swapped as a whole,
    so every round, and their sequence, is a permutation for any n.
    """

    def step(at: Column, turn: Column) -> Column:
        partner = F.pmod(F.xxhash64(turn, *tweak) - at, n)
        swap = F.xxhash64(turn, F.greatest(at, partner), *tweak).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("bigint"), step)


def mix_sources(
    docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = 17,
) -> Mix:
    """Plan of the mixture; its tables are written below ``scratch``."""
    spark = docs.sparkSession
    sized = scratch.keep(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            source_key(F.col(source_col)).alias("key"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(NOT_SPACE)), F.lit(0)).cast("bigint").alias("size"),
            F.xxhash64(text_col).alias("digest"),
        ),
        "sized",
    )
    wanted = targets(sized.groupBy("key").agg(F.sum("size").alias("source_size")), weights, share, most)
    blocks = F.ceil(F.col("source_size") / block)
    sources = scratch.keep(
        wanted.withColumn("blocks", blocks)
        .withColumn("quota", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("bigint"))
        .withColumn("until", F.sum("quota").over(Window.partitionBy(F.lit(0)).orderBy("key"))),
        "sources",
    )
    places = scratch.keep(
        running(
            sized, ["key"], ["id", "digest"], F.expr("coalesce(floor(id / 512), -1)"), {"begin": ("sum", "size")}, exclusive=True, levels=1
        ),
        "places",
    )
    slots = scratch.keep(_slots(spark, sources, shard, seed), "slots")
    return Mix(sources, places, slots)


def _slots(spark, sources: DataFrame, shard: int, seed: int) -> DataFrame:
    """(shard, key, number, block): the blocks that each output shard takes."""
    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    cells = CELLS
    shards = -(-total // shard)
    share = sources.where("quota > 0").select(
        "key", "quota", "blocks", ((F.col("until") - F.col("quota")) / total).alias("low"), (F.col("until") / total).alias("high")
    )
    cell = share.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1))))
    ).select("cell", "key", "low", "high")
    uniform = F.xxhash64(F.lit(seed), "id").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    draws = spark.range(0, total).select(F.expr(f"id div {shard}").alias("shard"), uniform.alias("u"))
    draws = draws.withColumn("cell", F.floor(F.col("u") * cells))
    drawn = draws.join(cell, "cell").where("u >= low AND u < high").groupBy("shard", "key").agg(F.count("*").alias("n"))
    numbered = running(drawn, ["key"], ["shard"], F.expr("shard div 4096"), {"begin": ("sum", "n")}, exclusive=True, levels=1)
    took = numbered.join(share.select("key", "quota", "blocks"), "key").select(
        "shard", "key", "quota", "blocks", "begin", F.least(F.col("begin") + F.col("n"), "quota").alias("end")
    )
    took = took.where("end > begin")
    have = drawn.groupBy("key").agg(F.sum("n").alias("begin"))
    short = share.join(have, "key", "left").withColumn("begin", F.coalesce("begin", F.lit(0))).where("begin < quota")
    short = short.withColumn(
        "from", F.explode(F.expr(f"sequence(begin, quota - 1, {shard})"))
    ).select(
        (F.lit(shards) + F.expr(f"(from - begin) div {shard}")).alias("shard"), "key", "quota", "blocks",
        F.col("from").alias("begin"), F.least(F.col("from") + shard, "quota").alias("end"),
    )
    # a row becomes up to a shard of slots, so rows are dealt by the slots they make, not by their bytes
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_SLOTS))
    number = took.unionByName(short).repartition(tasks, "shard", "key").withColumn("number", F.explode(F.expr("sequence(begin, end - 1)")))
    passed = F.expr("number div blocks")
    return number.select(
        "shard", "key", "number",
        permuted(F.col("number") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("key"), passed).alias("block"),
    )


def taken_words(mix: Mix, id_col: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row per document row: id, source, size, source_size, target, taken.

    Null texts and texts without words have size 0 and nothing taken; a null source is a
    source of its own, after all others; rows with the same id are separate documents. An
    empty table, or one without words, gives targets of 0. A block is taken at most ``MOST``
    times, so no document gives more than that times its size.
    """
    times = mix.slots.groupBy("key", "block").agg(F.count("*").alias("times"))
    worded = mix.places.where("size > 0").withColumn(
        "block", F.explode(F.expr(f"sequence(begin div {block}, (begin + size - 1) div {block})"))
    )
    inside = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("begin"), F.col("block") * block)
    summed = (
        worded.select("id", "source", "key", "size", "begin", "block", inside.alias("words"))
        .join(times, ["key", "block"], "left")
        .groupBy("key", "begin", "id", "source", "size")
        .agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).cast("bigint").alias("taken"))
        .select("key", "id", "source", "size", "taken")
    )
    none = mix.places.where("size = 0").select("key", "id", "source", "size", F.lit(0).cast("bigint").alias("taken"))
    return summed.unionAll(none).join(mix.sources.select("key", "source_size", "target"), "key").select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", "taken"
    )
