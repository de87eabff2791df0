"""Conversations as token and loss-mask blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import templates as tp, text as tx
from ..sources.sinks import token_dtype
from . import scan

PAD_ID = 0
MIN_TOKENS = 4


def codepoint_example(conv: Column, template: str) -> Column:
    """``struct<tokens, mask>`` with one id per code point; ones on assistant content and footer.

    The mask is concatenated from runs, so its cost is linear in the text.
    """
    parts = tp.rendered_turns(conv, template)
    tokens = tx.codepoints(F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"])), ""))
    mask = F.flatten(
        F.transform(
            parts,
            lambda p: F.concat(
                F.array_repeat(F.lit(0), F.length(p["head"])),
                F.array_repeat(p["assistant"].cast("int"), F.length(p["body"])),
            ),
        )
    )
    return F.struct(tokens.alias("tokens"), mask.alias("mask"))


def long_enough(tokens: Column) -> Column:
    """Examples of fewer than four tokens are left out."""
    return F.size(tokens) >= MIN_TOKENS


def fit(values: Column, seq_len: int, pad: int = PAD_ID) -> Column:
    """Cut or right-pad an array to ``seq_len``."""
    padding = F.array_repeat(F.lit(pad), F.greatest(F.lit(seq_len) - F.size(values), F.lit(0)))
    return F.concat(F.slice(values, 1, seq_len), padding)


def pad_and_truncate(examples: DataFrame, seq_len: int) -> DataFrame:
    """Fixed-length ``tokens`` and ``mask``, with the assistant tokens before and after the cut."""
    kept = examples.where(long_enough(F.col("tokens")))
    ones = F.size(F.filter("mask", lambda m: m == 1))
    kept_ones = F.size(F.filter(F.slice("mask", 1, seq_len), lambda m: m == 1))
    return (
        kept.withColumn("assistant_tokens_raw", ones.cast("bigint"))
        .withColumn("assistant_tokens_kept", kept_ones.cast("bigint"))
        .withColumn("tokens", fit(F.col("tokens"), seq_len))
        .withColumn("mask", fit(F.col("mask"), seq_len, 0))
    )


def number_blocks(blocks: DataFrame, order: str) -> DataFrame:
    """Blocks with a dense ``seq_id`` from 0 in the order of a whole number; left-out conversations leave no hole."""
    return scan.running(blocks, [], [order], F.expr(f"{order} div 1024"), {"seq_id": ("count", order)}, exclusive=True)


def processing_meta(blocks: DataFrame, template: str, seq_len: int, vocab_size: int, original_vocab_size: int) -> DataFrame:
    """One row of counts over the padded examples."""
    total = F.col("total_conversations") * seq_len
    return blocks.agg(
        F.count("*").alias("total_conversations"),
        F.coalesce(F.sum("assistant_tokens_raw"), F.lit(0)).cast("bigint").alias("assistant_tokens"),
        F.coalesce(F.sum("assistant_tokens_kept"), F.lit(0)).cast("bigint").alias("assistant_tokens_kept"),
    ).select(
        F.lit("sft").alias("mode"),
        F.lit(template).alias("chat_template"),
        "*",
        total.alias("total_tokens"),
        (F.col("assistant_tokens") * 100 / F.greatest(total, F.lit(1))).alias("assistant_pct"),
        F.col("total_conversations").alias("n_sequences"),
        F.lit(seq_len).cast("bigint").alias("max_seq_len"),
        F.lit(vocab_size).cast("bigint").alias("vocab_size"),
        F.lit(vocab_size != original_vocab_size).alias("vocab_expanded"),
        F.lit(token_dtype(vocab_size)).alias("dtype"),
    )
