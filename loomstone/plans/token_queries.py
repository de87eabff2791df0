"""Named queries of tokens: packing, masks, splits and byte-pair encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import templates as tp
from ..operators import bpe, packing as op, profile, sft
from . import corpus, inputs
from .chat_queries import rendered_sql, spans_sql
from .convert_queries import nested
from .registry import query

SEQ_LEN = 512
SFT_LEN = 1024
# Every Unicode code point is an id of the reference tokenizer.
CODEPOINTS = 0x110000


def _show(c: str):
    return F.array_join(F.transform(c, lambda t: t.cast("string")), " ")


def codepoint_blocks(spark, sf_dir, keep_tail=False):
    """Documents in id order, a blank line between them, packed by code point."""
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id", "text")
    return op.pack_codepoints(docs, "doc_id", "text", SEQ_LEN, keep_tail)


def codepoint_split(spark, sf_dir):
    """The blocks marked train or val; their number follows from the character counts."""
    docs = inputs.table(spark, sf_dir, "documents").select("text")
    chars = docs.agg((F.sum(F.length("text")) + 2 * (F.count("*") - 1)).alias("chars"))
    total = op.block_count(chars, F.col("chars"), SEQ_LEN)
    return op.with_split(codepoint_blocks(spark, sf_dir), total, SEQ_LEN)


_STREAM_SQL = f"""
sep AS (SELECT doc_id, text || CASE WHEN doc_id = (SELECT max(doc_id) FROM documents) THEN '' ELSE chr(10) || chr(10) END AS text FROM documents),
placed AS (SELECT doc_id, text, sum(length(text)) OVER (ORDER BY doc_id) - length(text) AS start FROM sep),
toks AS (SELECT unnest(list_transform(string_split(text, ''), lambda c: unicode(c))) AS id, start + unnest(range(length(text))) AS pos FROM placed),
blocks AS (SELECT (pos // {SEQ_LEN})::BIGINT AS seq_id, list(id ORDER BY pos) AS ids FROM toks GROUP BY ALL),
whole AS (SELECT * FROM blocks WHERE len(ids) = {SEQ_LEN})
"""


@query("pack_sequences", f"WITH {_STREAM_SQL} SELECT seq_id, array_to_string(ids, ' ') AS tokens FROM whole")
def pack_sequences(spark, sf_dir):
    return codepoint_blocks(spark, sf_dir).select("seq_id", _show("tokens").alias("tokens"))


@query(
    "pack_tail_dropped",
    f"WITH {_STREAM_SQL} SELECT seq_id, len(ids)::BIGINT AS dropped_tokens, array_to_string(ids, ' ') AS tokens FROM blocks WHERE len(ids) < {SEQ_LEN}",
)
def pack_tail_dropped(spark, sf_dir):
    tail = codepoint_blocks(spark, sf_dir, keep_tail=True).where(F.size("tokens") < SEQ_LEN)
    return tail.select("seq_id", F.size("tokens").cast("bigint").alias("dropped_tokens"), _show("tokens").alias("tokens"))


@query(
    "pack_meta",
    f"""WITH t AS (SELECT count(*) AS rows_extracted, sum(length(text))::BIGINT + 2 * (count(*) - 1) AS total_chars FROM documents)
    SELECT total_chars, total_chars AS total_tokens, rows_extracted, total_chars // {SEQ_LEN} AS n_sequences, total_chars // {SEQ_LEN} * {SEQ_LEN} AS usable_tokens,
      1.0::DOUBLE AS chars_per_token, {SEQ_LEN}::BIGINT AS max_seq_len, {CODEPOINTS}::BIGINT AS vocab_size, 'I' AS dtype, total_chars // {SEQ_LEN} * {SEQ_LEN} * 4 AS file_size FROM t""",
)
def pack_meta(spark, sf_dir):
    """Counts only: the tokens of the reference tokenizer are its characters, none need be built."""
    docs = inputs.table(spark, sf_dir, "documents").select("text")
    chars = F.length("text")
    return op.processing_meta(docs, chars, chars, SEQ_LEN, CODEPOINTS, between=(2, 2))


@query(
    "compression_by_lang",
    """SELECT lang, sum(length(text))::BIGINT AS chars, sum(len(regexp_extract_all(text, '[A-Za-z]+')))::BIGINT AS tokens,
      sum(length(text))::BIGINT / greatest(sum(len(regexp_extract_all(text, '[A-Za-z]+'))), 1) AS chars_per_token FROM documents GROUP BY lang""",
)
def compression_by_lang(spark, sf_dir):
    docs = inputs.documents(spark, sf_dir, "lang", "text")
    words = F.regexp_count("text", F.lit("[A-Za-z]+"))
    return op.compression(docs, "lang", F.length("text"), words)


@query(
    "train_val_split",
    f"""WITH {_STREAM_SQL}, n AS (SELECT count(*) AS n FROM whole), v AS (SELECT n, floor(n * {SEQ_LEN} * 0.05::DOUBLE)::BIGINT // {SEQ_LEN} AS val FROM n)
    SELECT seq_id, CASE WHEN seq_id < n - val THEN 'train' ELSE 'val' END AS split, val >= 2 AS val_evaluated FROM whole, v""",
)
def train_val_split(spark, sf_dir):
    """Block numbers are known from the character counts alone, so no token array is built."""
    return codepoint_split(spark, sf_dir).select("seq_id", "split", "val_evaluated")


@query(
    "shifted_pairs",
    f"""WITH {_STREAM_SQL}, n AS (SELECT count(*) AS n FROM whole), v AS (SELECT n, floor(n * {SEQ_LEN} * 0.05::DOUBLE)::BIGINT // {SEQ_LEN} AS val FROM n),
    b AS (SELECT seq_id, ids, CASE WHEN seq_id < n - val THEN 'train' ELSE 'val' END AS split FROM whole, v)
    SELECT a.seq_id, a.split, array_to_string(a.ids, ' ') AS x, array_to_string(list_append(a.ids[2:], c.ids[1]), ' ') AS y
    FROM b a JOIN b c ON c.seq_id = a.seq_id + 1 AND c.split = a.split""",
)
def shifted_pairs(spark, sf_dir):
    return op.shifted_pairs(codepoint_split(spark, sf_dir), "split").select("seq_id", "split", _show("x").alias("x"), _show("y").alias("y"))


@query(
    "epoch_shard",
    f"""WITH n AS (SELECT (sum(length(text)) + 2 * (count(*) - 1)) // {SEQ_LEN} AS n FROM documents), b AS (SELECT unnest(range(n::BIGINT)) AS seq_id FROM n),
    p AS (SELECT seq_id, row_number() OVER (ORDER BY md5(seq_id || ':1:0'), seq_id) - 1 AS position FROM b) SELECT seq_id, position, (position % 4)::INT AS rank FROM p""",
)
def epoch_shard(spark, sf_dir):
    blocks = codepoint_blocks(spark, sf_dir).select("seq_id")
    return op.epoch_order(blocks, epoch=1, ranks=4).select("seq_id", "position", "rank")


# ---- conversations as token and mask blocks --------------------------------


def codepoint_examples(spark, sf_dir, template="simple"):
    return nested(spark, sf_dir).select("conv_id", F.inline(F.array(sft.codepoint_example(F.col("conv"), template))))


_MASK_SQL = f"""
text AS ({rendered_sql("simple")}),
{spans_sql("simple")},
marks AS (SELECT conv_id, string_agg(repeat('0', h) || repeat(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, b), '' ORDER BY turn) AS mask FROM spans GROUP BY conv_id),
ex AS (SELECT conv_id, rendered, mask FROM text JOIN marks USING (conv_id) WHERE length(rendered) >= 4),
fitted AS (SELECT conv_id, rpad(substr(mask, 1, {SFT_LEN}), {SFT_LEN}, '0') AS mask,
  length(replace(mask, '0', ''))::BIGINT AS assistant_tokens_raw, length(replace(substr(mask, 1, {SFT_LEN}), '0', ''))::BIGINT AS assistant_tokens_kept,
  array_to_string(list_concat(list_transform(string_split(substr(rendered, 1, {SFT_LEN}), ''), lambda c: unicode(c)),
    list_transform(range(greatest({SFT_LEN} - length(rendered), 0)), lambda i: 0)), ' ') AS tokens FROM ex)
"""


@query("sft_mask_codepoint", f"WITH {_MASK_SQL} SELECT conv_id, length(rendered)::BIGINT AS n_tokens, mask FROM ex")
def sft_mask_codepoint(spark, sf_dir):
    return codepoint_examples(spark, sf_dir).where(sft.long_enough(F.col("tokens"))).select(
        "conv_id",
        F.size("tokens").cast("bigint").alias("n_tokens"),
        F.array_join(F.transform("mask", lambda m: m.cast("string")), "").alias("mask"),
    )


@query("sft_pad_truncate", f"WITH {_MASK_SQL} SELECT conv_id, tokens, mask, assistant_tokens_raw, assistant_tokens_kept FROM fitted")
def sft_pad_truncate(spark, sf_dir):
    blocks = sft.pad_and_truncate(codepoint_examples(spark, sf_dir), SFT_LEN)
    return blocks.select(
        "conv_id",
        _show("tokens").alias("tokens"),
        F.array_join(F.transform("mask", lambda m: m.cast("string")), "").alias("mask"),
        "assistant_tokens_raw",
        "assistant_tokens_kept",
    )


@query(
    "sft_meta",
    f"""WITH {_MASK_SQL}, t AS (SELECT count(*) AS n, sum(assistant_tokens_raw)::BIGINT AS raw, sum(assistant_tokens_kept)::BIGINT AS kept FROM fitted)
    SELECT 'sft' AS mode, 'simple' AS chat_template, n AS total_conversations, raw AS assistant_tokens, kept AS assistant_tokens_kept, n * {SFT_LEN} AS total_tokens,
      raw * 100 / (n * {SFT_LEN}) AS assistant_pct, n AS n_sequences, {SFT_LEN}::BIGINT AS max_seq_len, {CODEPOINTS}::BIGINT AS vocab_size, false AS vocab_expanded, 'I' AS dtype FROM t""",
)
def sft_meta(spark, sf_dir):
    blocks = sft.pad_and_truncate(codepoint_examples(spark, sf_dir), SFT_LEN)
    return sft.processing_meta(blocks, "simple", SFT_LEN, CODEPOINTS, CODEPOINTS)


# ---- byte-pair encoding ----------------------------------------------------

def trained(spark, sf_dir) -> bpe.Tokenizer:
    """Tokenizer of the documents as they are now, of the default size, learned once a session for the same words."""
    return bpe.train_once(inputs.documents(spark, sf_dir, "text"), "text")


# The check engine has no look-ahead: a mark before the last space of a run that a word follows does the same.
_PRETOKENS_SQL = r"""regexp_extract_all(regexp_replace({}, '(\s)(\S)', chr(1) || '\1\2', 'g'),
  '\x27(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}\x01]+|\s+')"""


@query(
    "pretokenize",
    f"SELECT doc_id, unnest(range(len(t)))::INT AS pos, unnest(t) AS token FROM (SELECT doc_id, {_PRETOKENS_SQL.format('text')} AS t FROM documents)",
)
def pretokenize(spark, sf_dir):
    docs = inputs.documents(spark, sf_dir, "doc_id", "text")
    return docs.select("doc_id", F.posexplode(bpe.pretokens(F.col("text"))).alias("pos", "token"))


@query(
    "pretoken_counts",
    f"""WITH parts AS (SELECT string_split(text, chr(10)) AS p FROM documents),
    lines AS (SELECT unnest(list_concat(list_transform(p[:-2], lambda x: x || chr(10)), p[-1:])) AS line FROM parts)
    SELECT token, count(*) AS n FROM (SELECT unnest({_PRETOKENS_SQL.format('line')}) AS token FROM lines) GROUP BY token""",
)
def pretoken_counts(spark, sf_dir):
    return bpe.pretoken_counts(inputs.documents(spark, sf_dir, "text"), "text")


@query("bpe_merges")
def bpe_merges(spark, sf_dir):
    return trained(spark, sf_dir).merges_frame(spark)


@query("vocab_head")
def vocab_head(spark, sf_dir):
    return trained(spark, sf_dir).vocab_frame(spark).orderBy("id").limit(50)


@query("encode_docs")
def encode_docs(spark, sf_dir):
    """Each source as one joined file, encoded in chunks of 100,000 characters."""
    records = inputs.table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("rec_ord"), "text")
    encoded = corpus.encode_files(records, trained(spark, sf_dir))
    return encoded.select("source", "chunk", F.size("ids").alias("n_ids"), _show("ids").alias("ids"))


@query("compression_of_ids")
def compression_of_ids(spark, sf_dir):
    """Characters per token of each language under the learned tokenizer."""
    docs = inputs.documents(spark, sf_dir, "lang", "text")
    encoded = docs.select("lang", "text", bpe.encode(trained(spark, sf_dir), F.col("text")).alias("ids"))
    return op.compression(encoded, "lang", F.length("text"), F.size("ids"))


@query("decode_docs", "SELECT doc_id, text FROM documents")
def decode_docs(spark, sf_dir):
    """Documents encoded and decoded again, special tokens shown."""
    tokenizer = trained(spark, sf_dir)
    encoded = inputs.documents(spark, sf_dir, "doc_id", "text").select("doc_id", bpe.encode(tokenizer, F.col("text")).alias("ids"))
    return encoded.select("doc_id", bpe.decode(tokenizer, F.col("ids"), skip_special=False).alias("text"))


@query("sample_encodings")
def sample_encodings(spark, sf_dir):
    """The first thirty tokens of every conversation turn."""
    turns = inputs.conversations(spark, sf_dir)
    sampled = bpe.sample_encodings(trained(spark, sf_dir), turns, "text", "conv_id", "turn")
    return sampled.select("conv_id", "turn", F.array_join("tokens", " ").alias("tokens"), _show("ids").alias("ids"), "length")


@query("token_preview")
def token_preview(spark, sf_dir):
    tokenizer = trained(spark, sf_dir)
    turns = inputs.conversations(spark, sf_dir)
    encoded = turns.select("conv_id", "turn", bpe.encode(tokenizer, F.col("text")).alias("ids"))
    return bpe.token_preview(tokenizer, encoded, "ids", "conv_id", "turn")


@query("pack_bpe_sequences")
def pack_bpe_sequences(spark, sf_dir):
    """The sources in order as one token stream, packed into blocks."""
    docs = inputs.table(spark, sf_dir, "documents")
    records = docs.select("source", F.col("doc_id").alias("rec_ord"), "text")
    order = docs.groupBy("source").agg(F.min("doc_id").alias("file_ord"))
    built = corpus.build_corpus(records, order, trained(spark, sf_dir), SEQ_LEN, inputs.scratch(spark, "corpus"))
    return built.blocks.select("seq_id", _show("tokens").alias("tokens"))


@query("sft_mask_bpe")
def sft_mask_bpe(spark, sf_dir):
    blocks, _, _ = corpus.build_examples(nested(spark, sf_dir), "conv", "conv_id", trained(spark, sf_dir), "chatml", SFT_LEN)
    return blocks.select(
        "conv_id",
        _show("tokens").alias("tokens"),
        F.array_join(F.transform("mask", lambda m: m.cast("string")), "").alias("mask"),
        "assistant_tokens_raw",
        "assistant_tokens_kept",
    )


@query(
    "special_token_inject",
    """WITH chars AS (SELECT DISTINCT unnest(string_split(text, '')) AS token FROM documents), top AS (SELECT max(unicode(token)) AS last FROM chars WHERE token <> '')
    SELECT template, token, (last + k)::BIGINT AS id FROM top, (VALUES ('chatml', 1, '<|im_start|>'), ('chatml', 2, '<|im_end|>'), ('llama', 1, '[INST]'), ('llama', 2, '[/INST]'),
      ('llama', 3, '<<SYS>>'), ('llama', 4, '<</SYS>>')) AS t(template, k, token)""",
)
def special_token_inject(spark, sf_dir):
    """The documents' characters and the default special tokens as vocabulary, grown for each template."""
    chars = profile.char_counts(inputs.documents(spark, sf_dir, "text"), "text").select(
        F.ascii("char").alias("id"), F.col("char").alias("token")
    )
    special = spark.createDataFrame(list(enumerate(bpe.SPECIAL_TOKENS)), "id int, token string")
    vocab = chars.unionByName(special)
    result = None
    for template, tokens in tp.TEMPLATE_TOKENS.items():
        if not tokens:
            continue
        needed = spark.createDataFrame(list(enumerate(tokens)), "ord int, token string")
        added = bpe.inject_special(vocab, needed).select(F.lit(template).alias("template"), "token", "id")
        result = added if result is None else result.unionByName(added)
    return result
