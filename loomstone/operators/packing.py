"""Token streams cut into fixed-length sequences, splits, and training pairs.

The tokens of all documents form one ordered stream. No task ever holds it:
a document's place comes from the bucketed prefix sum, each document is cut
into the pieces of the blocks it touches, and a block's few pieces meet by
block number. Work and shuffle are linear in the tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..session import checkpointed
from ..sources.sinks import token_dtype
from . import scan

ROWS_PER_BUCKET = 256
CHUNK_CHARS = 100_000
RECORD_SEPARATOR = "\n\n"


def _assemble(placed: DataFrame, by: list[str], size: Column, length: int, cut, join) -> DataFrame:
    """Blocks ``(*by, block, value)`` of ``length`` units from documents placed in their stream.

    ``placed`` has start, bucket, and the bucket's place (start_from, start_to),
    and is partitioned by bucket. Blocks inside one bucket, nearly all, are put
    together where they are; only documents that touch a block reaching over a
    bucket's edge are sent on to meet by block number.
    """
    first, last = F.expr(f"start_from div {length}"), F.expr(f"start_to div {length}")
    shared_first = F.when(F.col("start_from") % length != 0, first).otherwise(-1)
    shared_last = F.when(F.col("start_to") % length != 0, last).otherwise(-1)
    marked = placed.withColumns(
        {"first_shared": shared_first, "last_shared": shared_last, "stop": F.col("start") + size}
    ).withColumn("from_block", F.expr(f"start div {length}")).withColumn("to_block", F.expr(f"(stop - 1) div {length}"))
    edge = (F.col("block") == F.col("first_shared")) | (F.col("block") == F.col("last_shared"))
    touches_edge = (F.col("from_block") == F.col("first_shared")) | (F.col("to_block") == F.col("last_shared"))
    ordered = join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"]))

    def pieces(docs: DataFrame) -> DataFrame:
        return docs.select(*by, "bucket", "first_shared", "last_shared", F.inline(cut()))

    inside = pieces(marked).where(~edge).groupBy(*by, "bucket", "block").agg(ordered.alias("value")).drop("bucket")
    across = pieces(marked.where(touches_edge)).where(edge).groupBy(*by, "block").agg(ordered.alias("value"))
    return inside.unionByName(across)


def _bucket_of(order: str) -> Column:
    return F.expr(f"{order} div {ROWS_PER_BUCKET}")


def pack(docs: DataFrame, order: str, tokens: str, seq_len: int, keep_tail: bool = False) -> DataFrame:
    """Blocks ``(seq_id, tokens)`` of exactly ``seq_len`` ids over all documents in order.

    The unfinished last block is dropped unless ``keep_tail``.
    """
    sized = docs.select(order, tokens, F.size(tokens).cast("bigint").alias("__n")).where("__n > 0")
    placed = scan.running(
        sized, [], [order], _bucket_of(order), {"start": ("sum", "__n")}, exclusive=True, bounds=True
    )

    def cut() -> Column:
        def piece(block: Column) -> Column:
            begin = F.greatest(block * seq_len - F.col("start"), F.lit(0))
            end = F.least((block + 1) * seq_len, F.col("stop")) - F.col("start")
            part = F.slice(tokens, (begin + 1).cast("int"), (end - begin).cast("int"))
            return F.struct(block.alias("block"), (F.col("start") + begin).alias("at"), part.alias("piece"))

        return F.transform(F.sequence("from_block", "to_block"), piece)

    blocks = _assemble(placed, [], F.col("__n"), seq_len, cut, F.flatten)
    blocks = blocks.select(F.col("block").alias("seq_id"), F.col("value").alias("tokens"))
    return blocks if keep_tail else blocks.where(F.size("tokens") == seq_len)


def place_records(
    records: DataFrame, by: list[str], order: str, text: str, separator: str | Column = RECORD_SEPARATOR, bounds: bool = False
) -> DataFrame:
    """Add ``start``, and put the separator in front of every record but the first of its file.

    ``start`` is the character position in the joined file. The first record is
    the one with nothing before it, so separators cost no extra pass or join.
    The separator may be a column, the same for all records of a file.
    """
    gap = F.lit(separator) if isinstance(separator, str) else separator
    sized = records.withColumn("__gap", gap).withColumn("__n", (F.length(text) + F.length("__gap")).cast("bigint"))
    placed = scan.running(
        sized, by, [order], _bucket_of(order), {"__before": ("sum", "__n")}, exclusive=True, levels=1, bounds=bounds
    )

    def without_first_gap(before: Column) -> Column:
        return F.when(before == 0, F.lit(0)).otherwise(before - F.length("__gap")).cast("bigint")

    columns = {
        text: F.when(F.col("__before") == 0, F.col(text)).otherwise(F.concat("__gap", F.col(text))),
        "start": without_first_gap(F.col("__before")),
    }
    if bounds:
        columns["start_from"] = without_first_gap(F.col("__before_from"))
        columns["start_to"] = without_first_gap(F.col("__before_to"))
    return placed.withColumns(columns).drop("__gap", "__n", "__before", "__before_from", "__before_to")


def chunk_text(
    records: DataFrame,
    by: list[str],
    order: str,
    text: str,
    chunk_chars: int = CHUNK_CHARS,
    separator: str | Column = RECORD_SEPARATOR,
) -> DataFrame:
    """Joined files as chunks ``(*by, chunk, text)`` of ``chunk_chars`` characters, the last one shorter.

    A record is cut at the chunk edges in one pass over its text.
    """
    gap = F.lit(separator) if isinstance(separator, str) else separator
    needed = records.select(*by, order, text, gap.alias("__sep"))
    placed = place_records(needed, by, order, text, F.col("__sep"), bounds=True).where(F.length(text) > 0)

    def cut() -> Column:
        room = (F.lit(chunk_chars) - F.col("start") % chunk_chars).cast("int")
        head = F.array(F.substring(F.col(text), F.lit(1), room))
        tail = F.substring(F.col(text), room + 1, F.length(text))
        parts = F.concat(head, F.regexp_extract_all(tail, F.lit(f"(?s).{{1,{chunk_chars}}}"), F.lit(0)))

        def piece(part: Column, k: Column) -> Column:
            block = F.col("from_block") + k
            # Only a record's first piece can start inside its chunk.
            at = F.greatest(F.col("start"), block * chunk_chars)
            return F.struct(block.alias("block"), at.alias("at"), part.alias("piece"))

        return F.transform(parts, piece)

    blocks = _assemble(placed, by, F.length(text), chunk_chars, cut, lambda parts: F.array_join(parts, ""))
    return blocks.select(*by, F.col("block").alias("chunk"), F.col("value").alias("text"))


def pack_codepoints(records: DataFrame, order: str, text: str, seq_len: int, keep_tail: bool = False) -> DataFrame:
    """``pack`` for the code-point tokenizer: text is cut and shuffled as text, ids are made at the end."""
    blocks = chunk_text(records, [], order, text, seq_len)
    if not keep_tail:
        blocks = blocks.where(F.length("text") == seq_len)
    return blocks.select(F.col("chunk").alias("seq_id"), tx.codepoints("text").alias("tokens"))


def processing_meta(
    docs: DataFrame, chars: Column, tokens: Column, seq_len: int, vocab_size: int, between: tuple[int, int] = (0, 0)
) -> DataFrame:
    """One row of counts: characters, tokens, usable tokens, sequences, characters per token.

    ``between`` adds the characters and tokens of the separator between records.
    """
    gaps = F.greatest(F.count("*") - 1, F.lit(0))
    totals = docs.agg(
        (F.coalesce(F.sum(chars), F.lit(0)) + gaps * between[0]).cast("bigint").alias("total_chars"),
        (F.coalesce(F.sum(tokens), F.lit(0)) + gaps * between[1]).cast("bigint").alias("total_tokens"),
        F.count("*").alias("rows_extracted"),
    )
    dtype = token_dtype(vocab_size)
    sequences = F.expr(f"total_tokens div {seq_len}")
    return totals.select(
        "*",
        sequences.alias("n_sequences"),
        (sequences * seq_len).alias("usable_tokens"),
        F.when(F.col("total_tokens") > 0, F.col("total_chars") / F.col("total_tokens")).otherwise(0.0).alias("chars_per_token"),
        F.lit(seq_len).cast("bigint").alias("max_seq_len"),
        F.lit(vocab_size).cast("bigint").alias("vocab_size"),
        F.lit(dtype).alias("dtype"),
        (sequences * seq_len * (2 if dtype == "H" else 4)).alias("file_size"),
    )


def split_bounds(total: DataFrame, seq_len: int, val_split: float = 0.05) -> DataFrame:
    """One row: how many tokens and blocks train and validation hold, from one row with ``n_blocks``.

    The validation share is the tail, rounded down to whole blocks; it is
    evaluated only with at least two blocks, and left out of training anyway.
    """
    sized = total.withColumn("total", F.col("n_blocks") * seq_len)
    val = F.expr(f"cast(floor(total * {val_split!r}D) as bigint) div {seq_len}")
    return sized.select(
        F.col("total").alias("total_tokens"),
        (val * seq_len).alias("val_tokens"),
        (F.col("total") - val * seq_len).alias("train_tokens"),
        (F.col("n_blocks") - val).alias("train_blocks"),
        val.alias("val_blocks"),
        F.greatest(F.col("n_blocks") - val - 1, F.lit(0)).alias("train_served"),
        F.when(val >= 2, val - 1).otherwise(0).alias("val_served"),
    )


def block_count(docs: DataFrame, n_tokens: Column, seq_len: int) -> DataFrame:
    """Number of whole blocks from the documents' token counts, without building a block."""
    return docs.select(n_tokens.cast("bigint").alias("n")).agg(
        F.expr(f"coalesce(sum(n), 0) div {seq_len}").alias("n_blocks")
    )


def with_split(blocks: DataFrame, total: DataFrame, seq_len: int, val_split: float = 0.05) -> DataFrame:
    """Mark each block train or val; the bounds enter as scalar subqueries."""
    bounds = split_bounds(total, seq_len, val_split)
    train_blocks = bounds.select("train_blocks").scalar()
    val_blocks = bounds.select("val_blocks").scalar()
    return blocks.withColumn(
        "split", F.when(F.col("seq_id") < train_blocks, F.lit("train")).otherwise(F.lit("val"))
    ).withColumn("val_evaluated", val_blocks >= 2)


def shifted_pairs(blocks: DataFrame, split: str, *arrays: str) -> DataFrame:
    """Training pairs: each array also shifted by one id, the next block giving the last.

    The blocks are built once, into a table; the first ids of the next ones come from an equi-join on
    the number, and the last block of a split, which has no successor there, is not served.
    """
    arrays = arrays or ("tokens",)
    blocks = checkpointed(blocks)
    heads = blocks.select(
        split, (F.col("seq_id") - 1).alias("seq_id"), *[F.get(F.col(a), F.lit(0)).alias(f"__next_{a}") for a in arrays]
    )
    joined = blocks.join(heads, [split, "seq_id"])

    def shifted(a: str) -> Column:
        return F.concat(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.array(f"__next_{a}"))

    names = {"tokens": "y", "mask": "m"}
    outputs = [F.col("tokens").alias("x")] if "tokens" in arrays else []
    return joined.select("seq_id", split, *outputs, *[shifted(a).alias(names.get(a, f"{a}_next")) for a in arrays])


def epoch_order(blocks: DataFrame, epoch: int, ranks: int, seed: int = 0) -> DataFrame:
    """Blocks in the shuffled order of an epoch, dealt to ``ranks`` readers.

    The order is by a digest of block number, epoch and seed: the same on every
    run. Position is counted through 4,096 ranges of the digest, so no task
    sees all blocks.
    """
    digest = F.md5(F.concat_ws(":", F.col("seq_id").cast("string"), F.lit(str(epoch)), F.lit(str(seed))).cast("binary"))
    placed = scan.running(
        blocks.withColumn("shuffle_key", digest),
        [],
        ["shuffle_key", "seq_id"],
        F.conv(F.substring("shuffle_key", 1, 3), 16, 10),
        {"position": ("count", "seq_id")},
        exclusive=True,
        levels=0,
    )
    return placed.withColumn("rank", (F.col("position") % ranks).cast("int"))


def compression(docs: DataFrame, key: str, chars: Column, tokens: Column) -> DataFrame:
    """Characters, tokens and characters per token of each key."""
    return docs.groupBy(key).agg(
        F.sum(chars).cast("bigint").alias("chars"), F.sum(tokens).cast("bigint").alias("tokens")
    ).withColumn("chars_per_token", F.col("chars") / F.greatest("tokens", F.lit(1)))
