"""Byte-level byte-pair encoding: training, encoding, previews and loss masks.

Training works on the partitioned table of distinct pre-tokens with their counts;
only leading pairs, bounded in number, and the vocabulary reach the driver. Encoding takes Arrow batches whole, with the
merge table in its closure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import checkpointed, ensure_checkpoint_dir
from . import encoding, merges

# The published byte-level pre-token pattern, the default special
# tokens in id order, and the texts encoded as a check after training.
PRETOKEN_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL_TOKENS = ["<|endoftext|>", "<pad>", "<unk>", "<s>", "</s>"]
CHECK_TEXTS = [
    "Hello, world! This is a test.",
    "你好世界！这是一个测试。",
    "The quick brown fox jumps over the lazy dog.",
    "人工智能正在改变我们的生活方式。",
]
VOCAB_SIZE = 8000
MIN_FREQUENCY = 2


def byte_alphabet() -> dict[int, str]:
    """Printable stand-in of every byte: itself when printable, else the next character from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    shown = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in shown):
        shown[b] = chr(256 + n)
    return shown


def pretokens(text: Column) -> Column:
    """Pre-tokens of a text; joined again they are the text."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PRETOKEN_PATTERN), F.lit(0))


def pretoken_counts(df: DataFrame, text: str) -> DataFrame:
    """Distinct pre-tokens of all lines with their counts; a line keeps its newline, as in a file reader."""
    counted = df.select(F.col(text).cast("string")).mapInArrow(encoding.line_pieces, "token string, n bigint")
    return counted.groupBy("token").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Tokenizer:
    """Vocabulary and merges of a trained tokenizer; both are bounded by the vocabulary size."""

    vocab: dict[str, int]
    merges: list[tuple[str, str]]
    special: list[str] = field(default_factory=lambda: list(SPECIAL_TOKENS))

    @property
    def size(self) -> int:
        return len(self.vocab)

    def vocab_frame(self, spark: SparkSession) -> DataFrame:
        rows = sorted(self.vocab.items(), key=lambda item: item[1])
        return spark.createDataFrame([(i, t) for t, i in rows], "id int, token string")

    def merges_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(n, left, right) for n, (left, right) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left string, right string")

    def with_special(self, tokens: list[str]) -> tuple[Tokenizer, list[str]]:
        """Tokenizer with the missing special tokens appended, and which those were."""
        added = [t for t in tokens if t not in self.vocab]
        vocab = dict(self.vocab)
        for token in added:
            vocab[token] = len(vocab)
        special = self.special + [t for t in tokens if t not in self.special]
        return replace(self, vocab=vocab, special=special), added


def _symbol_table(counts: DataFrame, first_id: int) -> tuple[DataFrame, list[str]]:
    """Pre-tokens as arrays of symbol ids, and the alphabet (at most 256 characters) in id order."""

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(encoding.byte_ranges(batch.column(0))[0]).astype(np.int32))], names=["b"])

    shown = byte_alphabet()
    seen = [r.b for r in counts.select("token").mapInArrow(used, "b int").distinct().collect()]
    alphabet = sorted(shown[b] for b in seen)
    ids = np.zeros(256, np.int32)
    ids[seen] = [first_id + alphabet.index(shown[b]) for b in seen]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, places = encoding.byte_ranges(batch.column(1))
            symbols = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(ids[data]))
            yield pa.RecordBatch.from_arrays([batch.column(0), symbols], names=["n", "symbols"])

    spelled = counts.select("n", "token").mapInArrow(spell, "n bigint, symbols array<int>")
    return spelled.where(F.size("symbols") > 1), alphabet


def train(
    df: DataFrame,
    text: str,
    vocab_size: int = VOCAB_SIZE,
    min_frequency: int = MIN_FREQUENCY,
    special: list[str] | None = None,
) -> Tokenizer:
    """Learn merges from a text column, equal to merging one best pair after another (see ``merges``)."""
    return train_counts(checkpointed(pretoken_counts(df, text)), vocab_size, min_frequency, special)


def train_counts(counts: DataFrame, vocab_size: int = VOCAB_SIZE, min_frequency: int = MIN_FREQUENCY, special: list[str] | None = None) -> Tokenizer:
    """Learn merges from distinct pre-tokens ``(token, n)``; every step runs on partitioned tables, whatever their size."""
    special = list(SPECIAL_TOKENS if special is None else special)
    words, alphabet = _symbol_table(counts, len(special))
    vocab = {token: i for i, token in enumerate([*special, *alphabet])}
    names = {i: token for token, i in vocab.items()}
    cores = counts.sparkSession.sparkContext.defaultParallelism
    learned = merges.learn(words.repartition(cores), names, vocab, vocab_size, min_frequency)
    return Tokenizer(vocab, learned, special)


def train_once(df: DataFrame, text: str, vocab_size: int = VOCAB_SIZE, min_frequency: int = MIN_FREQUENCY) -> Tokenizer:
    """``train``, but a session that has trained on the same words finds the result in its checkpoint folder.

    The pre-tokens are counted every time, and their digest names the result, so changed data are learned anew.
    """
    spark = df.sparkSession
    counts = checkpointed(pretoken_counts(df, text))
    hashed = [F.xxhash64(F.lit(seed), "token", "n") for seed in (1, 2)]
    marks = counts.agg(F.count("*"), *[F.bit_xor(h) for h in hashed], *[F.sum(F.shiftright(h, 20)) for h in hashed]).first()
    path = f"{ensure_checkpoint_dir(spark)}/tokenizer-{vocab_size}-{min_frequency}-" + "-".join(str(m or 0) for m in marks)
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/merges/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        tokenizer = train_counts(counts, vocab_size, min_frequency)
        tokenizer.vocab_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
        tokenizer.merges_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")
        return tokenizer
    vocab = {r.token: r.id for r in spark.read.parquet(f"{path}/vocab").collect()}
    learned = [(r.left, r.right) for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]
    return Tokenizer(vocab, learned)


def encoder(tokenizer: Tokenizer) -> encoding.Encoder:
    """Encoder of a tokenizer, for use inside a task."""
    return encoding.Encoder(tokenizer.vocab, tokenizer.merges, tokenizer.special, byte_alphabet())


def encode(tokenizer: Tokenizer, text: Column) -> Column:
    """Ids of a text column as ``array<int>``; null gives none."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(tokenizer)
        yield from encoding.each(batches, own.encode_texts, encoding.text_bytes)

    return run(text)


def encode_chunks(tokenizer: Tokenizer, chunks: DataFrame, text: str = "text") -> DataFrame:
    """Chunks of joined files with their ``ids`` (no merge crosses a chunk edge)."""
    return chunks.withColumn("ids", encode(tokenizer, F.col(text)))


def decode(tokenizer: Tokenizer, ids: Column, skip_special: bool = True) -> Column:
    """Text of an id column; bytes that form no character become the replacement character, null gives an empty text."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        back = {c: b for b, c in byte_alphabet().items()}
        special = set(tokenizer.special)
        spelling = [b""] * (1 + max(tokenizer.vocab.values(), default=-1))
        for token, i in tokenizer.vocab.items():
            spelling[i] = (b"" if skip_special else token.encode()) if token in special else bytes(back[c] for c in token)
        yield from encoding.each(batches, lambda lists: encoding.spelled_out(lists, spelling), encoding.list_bytes)

    return run(ids)


def sample_encodings(tokenizer: Tokenizer, df: DataFrame, text: str, *keep: str, shown: int = 30) -> DataFrame:
    """The first tokens and ids of each text, and how many there are."""

    @F.arrow_udf("array<string>")
    def names(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        stored = [""] * (1 + max(tokenizer.vocab.values(), default=-1))
        for token, i in tokenizer.vocab.items():
            stored[i] = token
        yield from encoding.each(batches, lambda lists: encoding.named(lists, stored), encoding.list_bytes)

    encoded = df.select(*keep, text, encode(tokenizer, F.col(text)).alias("all_ids"))
    return encoded.select(
        *keep,
        text,
        F.slice("all_ids", 1, shown).alias("ids"),
        names(F.slice("all_ids", 1, shown)).alias("tokens"),
        F.size("all_ids").cast("bigint").alias("length"),
    )


def token_table(tokenizer: Tokenizer, spark: SparkSession) -> DataFrame:
    """``(id, raw, shown)``: the stored token, and its bytes as text, or the stored form when they are none."""
    back = {c: b for b, c in byte_alphabet().items()}
    rows = []
    for token, i in sorted(tokenizer.vocab.items(), key=lambda item: item[1]):
        if token in tokenizer.special:
            shown = token
        else:
            shown = bytes(back[c] for c in token).decode("utf-8", errors="replace") or token
        rows.append((i, token, shown))
    return spark.createDataFrame(rows, "id int, raw string, shown string")


def token_preview(tokenizer: Tokenizer, encoded: DataFrame, ids: str, *keep: str) -> DataFrame:
    """Encoded texts as one row per token. The joined table is the vocabulary, so its size is bounded.

    Of a plain column Spark would first filter the lists that are not empty, and so encode every text twice, with two Python workers a task.
    """
    placed = encoded.select(*keep, F.posexplode(F.coalesce(ids, F.array())).alias("pos", "id"))
    return placed.join(F.broadcast(token_table(tokenizer, encoded.sparkSession)), "id").select(*keep, "pos", "id", "shown")


def inject_special(vocab: DataFrame, needed: DataFrame) -> DataFrame:
    """Tokens a template needs and the vocabulary lacks, with the ids they get after the last one.

    ``vocab`` is ``(id, token)``, ``needed`` is ``(ord, token)``, a handful of rows.
    """
    last = vocab.agg(F.max("id").alias("last")).scalar()
    missing = needed.join(vocab.select("token"), "token", "left_anti")
    place = F.array_sort(F.collect_list(F.struct("ord", "token")))
    return missing.agg(place.alias("m")).select(F.posexplode("m").alias("k", "m")).select(
        F.col("m.token").alias("token"), (last + F.col("k") + 1).cast("bigint").alias("id")
    )


def sft_examples(tokenizer: Tokenizer, df: DataFrame, parts: str, *keep: str) -> DataFrame:
    """Token ids and loss mask of rendered conversations (see ``templates.rendered_turns``).

    Each assistant turn marks the ids between the encoding of the text before
    its content and the encoding of the text up to its footer.
    """

    @F.arrow_udf("struct<tokens:array<int>,mask:array<int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(tokenizer)

        def made(rows: pa.Array) -> pa.Array:
            return pa.StructArray.from_arrays(own.examples(rows), names=["tokens", "mask"])

        yield from encoding.each(batches, made, encoding.part_bytes)

    # Not deterministic for Spark, else a filter on the result (``sft.long_enough``) moves below it and every conversation is encoded twice.
    made_once = run.asNondeterministic()
    return df.select(*keep, made_once(F.col(parts)).alias("__ex")).select(*keep, "__ex.tokens", "__ex.mask")
