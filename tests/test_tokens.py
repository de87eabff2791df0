import json
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders, models, pre_tokenizers, trainers

from loomstone.functions import templates as tp, turns as tn
from loomstone.operators import bpe, encoding, merges, packing, sft
from loomstone.plans import corpus
from loomstone.sources import shards, sinks


def library(files, vocab_size, min_frequency=2):
    reference = Tokenizer(models.BPE())
    reference.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    reference.decoder = decoders.ByteLevel()
    reference.train(
        files,
        trainers.BpeTrainer(
            vocab_size=vocab_size, min_frequency=min_frequency, special_tokens=bpe.SPECIAL_TOKENS, show_progress=False
        ),
    )
    return reference


def merges_of(reference):
    return [tuple(m) for m in json.loads(reference.to_str())["model"]["merges"]]


def write_files(folder, texts):
    paths = []
    for i, text in enumerate(texts):
        path = folder / f"{i}.txt"
        path.write_bytes(text.encode())
        paths.append(str(path))
    return paths


def ids_frame(spark, lists):
    return spark.createDataFrame(list(enumerate(lists)), "ord long, ids array<int>")


@pytest.fixture(scope="module")
def trained(spark, data, tmp_path_factory):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = [r.text for r in docs.select("text").collect()]
    tokenizer = bpe.train(docs, "text", 200)
    return tokenizer, library(write_files(tmp_path_factory.mktemp("docs"), texts), 200), texts


# ---- byte-pair encoding ----------------------------------------------------


@pytest.mark.parametrize("text,vocab_size,min_frequency", [("abab abab cd cd xy", 60, 2), ("ab ab cd", 60, 3), ("zy ba zy ba", 60, 2), ("aaaa aaa aaaaaaa aa", 60, 2)])
def test_small_corpora_train_like_the_library(spark, tmp_path, text, vocab_size, min_frequency):
    reference = library(write_files(tmp_path, [text]), vocab_size, min_frequency)
    tokenizer = bpe.train(spark.createDataFrame([(text,)], "t string"), "t", vocab_size, min_frequency)
    assert tokenizer.merges == merges_of(reference)
    assert tokenizer.vocab == reference.get_vocab()


def test_known_small_corpus(spark):
    tokenizer = bpe.train(spark.createDataFrame([("abab abab cd cd xy",)], "t string"), "t", 60)
    assert tokenizer.merges == [("a", "b"), ("c", "d"), ("Ġ", "cd"), ("ab", "ab")]
    assert bpe.encoder(tokenizer).encode("abZZab") == [tokenizer.vocab["abab"]]


@pytest.mark.parametrize("seed", range(2))
def test_random_corpora_train_like_the_library(spark, tmp_path, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("aab cd\n é'ts 1") for _ in range(rng.randrange(400))) for _ in range(12)]
    reference = library(write_files(tmp_path, texts), 90)
    tokenizer = bpe.train(spark.createDataFrame([(t,) for t in texts], "t string").repartition(7), "t", 90)
    assert tokenizer.merges == merges_of(reference)
    assert tokenizer.vocab == reference.get_vocab()


def test_documents_train_and_encode_like_the_library(spark, data, trained):
    tokenizer, reference, texts = trained
    assert tokenizer.merges == merges_of(reference)
    odd = [*texts, "", "new\n\n  Word\t x</s>y <pad>", *bpe.CHECK_TEXTS, "it's we'll 12 34"]
    encoded = spark.createDataFrame([(t,) for t in odd], "t string").select(bpe.encode(tokenizer, F.col("t")).alias("ids"))
    assert [list(r.ids) for r in encoded.collect()] == [reference.encode(t).ids for t in odd]


def test_pieces_equal_the_published_pattern():
    import regex

    rng = random.Random(8)
    atoms = ["a", "B", "é", "世", "1", "²", " ", "  ", "\n", "\t", "\u3000", "\u00a0", "'", "'s", "'ll", "'re", "'x", "'S", "!", "-", '"', "𝄞", "\u0301", "<pad>", "</s>", "<", "s>"]
    special = regex.compile("<pad>|</s>")
    for _ in range(60):
        texts = ["".join(rng.choice(atoms) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 30))]
        expected = []
        for text in texts:
            at = 0
            for m in [*special.finditer(text), None]:
                expected += [(p, False) for p in regex.findall(bpe.PRETOKEN_PATTERN, text[at : m.start() if m else len(text)])]
                if m:
                    expected.append((m.group(), True))
                    at = m.end()
        data, places = encoding.byte_ranges(pa.array(texts, pa.string()))
        pieces = encoding.split_pieces(data, places, re.compile("<pad>|</s>"))
        got = [data[a:b].tobytes().decode() for a, b in zip(pieces.begin, pieces.begin[1:])]
        assert list(zip(got, pieces.special.tolist())) == expected


def test_encoding_and_masks_in_small_chunks_and_with_nulls(spark, trained, monkeypatch):
    tokenizer, reference, texts = trained
    rng = random.Random(9)
    odd = [None, "", "<pad>", "a<pad></s> b'll ", "'s" * 50, " " * 200 + "x", *texts[:40]]
    expected = [reference.encode(t).ids if t else [] for t in odd]
    for chunk, cache in ((1, 3), (100, 50), (1 << 20, 10_000)):
        monkeypatch.setattr(encoding, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(encoding, "CACHE_LIMIT", cache)
        own = bpe.encoder(tokenizer)
        assert own.encode_texts(pa.array(odd, pa.string())).to_pylist() == expected
        assert own.encode_texts(pa.array(odd, pa.string()).slice(3, 7)).to_pylist() == expected[3:10]
    kind = pa.list_(pa.struct([("head", pa.string()), ("body", pa.string()), ("assistant", pa.bool_())]))
    rows = [[{"head": rng.choice(["", "<s>", "user: "]), "body": rng.choice(["", " x", "it's  ", "\n\n", "'", "s a"]), "assistant": rng.random() < 0.6} for _ in range(rng.randrange(6))] for _ in range(200)]
    ids, masks = own.examples(pa.array([*rows, None, []], kind))
    for row, tokens, mask in zip(rows, ids.to_pylist(), masks.to_pylist()):
        # The full text may still end a piece later than a prefix does: marks follow the prefixes.
        full = reference.encode("".join(p["head"] + p["body"] for p in row)).ids
        assert tokens == full and len(mask) == len(full)
        text, slow = "", [0] * len(full)
        for p in row:
            begin = len(reference.encode(text + p["head"]).ids)
            text += p["head"] + p["body"]
            if p["assistant"]:
                for i in range(begin, min(len(reference.encode(text).ids), len(full))):
                    slow[i] = 1
        assert mask == slow
    assert ids.to_pylist()[-2:] == [[], []]


def test_pretokens_lose_nothing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    joined = F.array_join(bpe.pretokens(F.col("text")), "")
    assert docs.where(joined != F.col("text")).count() == 0


def test_token_preview_shows_each_token_decoded(spark, trained):
    tokenizer, reference, _ = trained
    text = "Hello the world"
    ids = reference.encode(text).ids
    encoded = spark.createDataFrame([(1, ids)], "i int, ids array<int>")
    shown = bpe.token_preview(tokenizer, encoded, "ids", "i").orderBy("pos").collect()
    assert [r.shown for r in shown] == [reference.decode([i]) for i in ids]


def _encodings(df):
    """How often a row passes through a Python worker in the plan of ``df``."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_a_preview_encodes_every_text_once(spark, trained):
    tokenizer, reference, texts = trained
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, " x</s>"), *enumerate(texts[:5], 4)]
    turns = spark.createDataFrame(rows, "i int, text string")
    encoded = turns.select("i", bpe.encode(tokenizer, F.col("text")).alias("ids"))
    shown = bpe.token_preview(tokenizer, encoded, "ids", "i")
    assert _encodings(shown) == 1
    got = Counter((r.i, r.pos, r.id) for r in shown.collect())
    assert got == Counter((i, pos, token) for i, text in rows if text for pos, token in enumerate(reference.encode(text).ids))


def test_examples_are_encoded_once_where_short_ones_are_left_out(spark, trained):
    tokenizer, _, texts = trained
    conv = [(1, [("user", "a"), ("assistant", " b c d")]), (2, []), (3, None), (4, [("user", texts[0][:200]), ("assistant", texts[1][:200])])]
    talks = spark.createDataFrame(conv, "i int, conv array<struct<role:string,content:string>>")
    parts = talks.select("i", tp.rendered_turns(F.col("conv"), "simple").alias("parts"))
    examples = bpe.sft_examples(tokenizer, parts, "parts", "i")
    blocks = sft.pad_and_truncate(examples, 16)
    assert _encodings(blocks) == 1
    long = {r.i: r.tokens for r in examples.collect() if r.tokens and len(r.tokens) >= sft.MIN_TOKENS}
    assert {r.i: r.tokens for r in blocks.collect()} == {i: (t + [0] * 16)[:16] for i, t in long.items()} and 4 in long


def test_decoding_follows_the_library(spark, trained):
    tokenizer, reference, texts = trained
    lists = [reference.encode(t).ids for t in [*texts[:20], "a</s>b <pad>"]] + [[], [4], list(range(5, 60))]
    df = spark.createDataFrame([(x,) for x in lists], "ids array<int>")
    got = df.select(bpe.decode(tokenizer, F.col("ids")).alias("t"), bpe.decode(tokenizer, F.col("ids"), False).alias("u")).collect()
    assert [r.t for r in got] == [reference.decode(x) for x in lists]
    assert [r.u for r in got] == [reference.decode(x, skip_special_tokens=False) for x in lists]


def test_special_tokens_are_appended_once(trained):
    tokenizer, _, _ = trained
    grown, added = tokenizer.with_special(tp.TEMPLATE_TOKENS["llama"])
    assert added == ["[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
    assert [grown.vocab[t] for t in added] == list(range(tokenizer.size, tokenizer.size + 4))
    assert grown.with_special(tp.TEMPLATE_TOKENS["llama"])[1] == []


def test_loss_masks_follow_prefix_encoding(spark, data, trained):
    tokenizer, reference, _ = trained
    grown, added = tokenizer.with_special(tp.TEMPLATE_TOKENS["chatml"])
    reference = Tokenizer.from_str(reference.to_str())
    reference.add_special_tokens(added)
    turns = spark.read.parquet(f"{data}/conversations.parquet")
    nested = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("conv"))
    extra = spark.createDataFrame(
        [(-1, [(0, "user", "a"), (1, "assistant", "  b \n\n"), (2, "assistant", ""), (3, "user", "'"), (4, "assistant", "s x")])],
        nested.schema,
    )
    nested = nested.unionByName(extra)
    for template in tp.TEMPLATES:
        parts = nested.select("conv_id", tp.rendered_turns(F.col("conv"), template).alias("parts"))
        texts = {r.conv_id: r.parts for r in parts.collect()}
        for row in bpe.sft_examples(grown, parts, "parts", "conv_id").collect():
            text, spans = "", []
            for p in texts[row.conv_id]:
                spans.append((text + p["head"], text + p["head"] + p["body"], p["assistant"]))
                text += p["head"] + p["body"]
            ids = reference.encode(text).ids
            mask = [0] * len(ids)
            for before, after, assistant in spans:
                if assistant:
                    for i in range(len(reference.encode(before).ids), min(len(reference.encode(after).ids), len(ids))):
                        mask[i] = 1
            assert list(row.tokens) == ids and list(row.mask) == mask


# ---- packing ---------------------------------------------------------------


def test_pack_small(spark):
    blocks = packing.pack(ids_frame(spark, [[1, 2, 3], [], [4, 5, 6, 7, 8, 9]]), "ord", "ids", 4)
    assert sorted((r.seq_id, list(r.tokens)) for r in blocks.collect()) == [(0, [1, 2, 3, 4]), (1, [5, 6, 7, 8])]


@pytest.mark.parametrize("parts", [1, 7, 64])
@pytest.mark.parametrize("length", [3, 16])
def test_pack_keeps_order_and_content(spark, parts, length):
    rng = random.Random(length)
    # One document holds a third of all tokens, and keys have gaps across buckets.
    lists = [[rng.randrange(1000) for _ in range(rng.choice([0, 1, 5, 40]))] for _ in range(900)]
    lists[500] = [rng.randrange(1000) for _ in range(6000)]
    df = spark.createDataFrame([(i * 37 + (1 << 40) * (i // 300), x) for i, x in enumerate(lists)], "ord long, ids array<int>")
    whole = [t for x in lists for t in x]
    blocks = packing.pack(df.repartition(parts), "ord", "ids", length, keep_tail=True).collect()
    got = {r.seq_id: list(r.tokens) for r in blocks}
    assert got == {i: whole[i * length : (i + 1) * length] for i in range((len(whole) + length - 1) // length)}


@pytest.mark.parametrize("chunk", [1, 7, 100])
def test_chunks_are_the_joined_file(spark, chunk):
    rng = random.Random(chunk)
    records = [(f"f{rng.randrange(3)}", i, "".join(rng.choice("ab\n世𝄞 ") for _ in range(rng.choice([0, 1, 9, 300])))) for i in range(120)]
    df = spark.createDataFrame(records, "source string, ord long, text string").repartition(5)
    chunks = packing.chunk_text(df, ["source"], "ord", "text", chunk).collect()
    for source in {r[0] for r in records}:
        whole = "\n\n".join(r[2] for r in records if r[0] == source)
        got = {r.chunk: r.text for r in chunks if r.source == source}
        assert got == {i // chunk: whole[i : i + chunk] for i in range(0, len(whole), chunk)}


def test_codepoint_packing_equals_token_packing(spark):
    texts = ["ab世", "", "𝄞" * 20, "xyz"]
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, text string")
    blocks = packing.pack_codepoints(df, "ord", "text", 4).collect()
    whole = [ord(c) for c in "\n\n".join(texts)]
    assert {r.seq_id: list(r.tokens) for r in blocks} == {i: whole[i * 4 : i * 4 + 4] for i in range(len(whole) // 4)}


def test_split_bounds(spark):
    bounds = packing.split_bounds(spark.createDataFrame([(1000 // 16,)], "n_blocks long"), 16).first()
    assert (bounds["train_blocks"], bounds["val_blocks"], bounds["val_tokens"]) == (59, 3, 48)
    assert (bounds["train_served"], bounds["val_served"]) == (58, 2)
    exact = packing.split_bounds(spark.createDataFrame([(1000,)], "n_blocks long"), 1).first()
    assert (exact["train_tokens"], exact["val_tokens"], exact["train_served"], exact["val_served"]) == (950, 50, 949, 49)


def test_shifted_pairs_with_masks(spark):
    rows = [(0, "train", [1, 2], [0, 1]), (1, "train", [3, 4], [1, 1]), (2, "val", [5, 6], [0, 0])]
    df = spark.createDataFrame(rows, "seq_id long, split string, tokens array<int>, mask array<int>")
    got = packing.shifted_pairs(df, "split", "tokens", "mask").collect()
    assert [(r.seq_id, list(r.x), list(r.y), list(r.m)) for r in got] == [(0, [1, 2], [2, 3], [1, 1])]


def test_epoch_order_is_a_permutation_dealt_evenly(spark):
    blocks = spark.range(1000).withColumnRenamed("id", "seq_id")
    first = packing.epoch_order(blocks, 1, 4).collect()
    assert sorted(r.position for r in first) == list(range(1000))
    assert [r.seq_id for r in sorted(first, key=lambda r: r.position)] == [
        r.seq_id for r in sorted(first, key=lambda r: (r.shuffle_key, r.seq_id))
    ]
    assert all(sum(r["rank"] == k for r in first) == 250 for k in range(4))
    again = {r.seq_id: r.position for r in packing.epoch_order(blocks.repartition(3), 1, 4).collect()}
    assert again == {r.seq_id: r.position for r in first}
    other = {r.seq_id: r.position for r in packing.epoch_order(blocks, 2, 4).collect()}
    assert other != again


def test_codepoint_mask_and_padding(spark):
    conv = F.array(tn.turn("user", F.lit("a")), tn.turn("assistant", F.lit("bc")))
    row = spark.range(1).select(sft.codepoint_example(conv, "simple").alias("e")).first()["e"]
    assert [i for i, m in enumerate(row["mask"]) if m] == [28, 29, 30, 31] and len(row["tokens"]) == 32
    df = spark.createDataFrame([([7, 8, 9, 1], [0, 1, 1, 1]), ([7, 8, 9], [1, 1, 1]), ([1, 2, 3, 4, 5, 6, 7], [0] * 6 + [1])], "tokens array<int>, mask array<int>")
    got = [(list(r.tokens), list(r.mask), r.assistant_tokens_raw, r.assistant_tokens_kept) for r in sft.pad_and_truncate(df, 6).collect()]
    assert got == [([7, 8, 9, 1, 0, 0], [0, 1, 1, 1, 0, 0], 3, 3), ([1, 2, 3, 4, 5, 6], [0] * 6, 1, 0)]


def test_corpus_job_and_binary_export(spark, data, trained, tmp_path):
    tokenizer, reference, _ = trained
    docs = spark.read.parquet(f"{data}/documents.parquet")
    records = docs.select("source", F.col("doc_id").alias("rec_ord"), "text")
    order = docs.groupBy("source").agg(F.min("doc_id").alias("file_ord"))
    built = corpus.build_corpus(records, order, tokenizer, 128, str(tmp_path / "ids"), chunk_chars=5000)
    whole = []
    files = [r.source for r in order.orderBy("file_ord").collect()]
    for source in files:
        joined = "\n\n".join(r.text for r in docs.where(F.col("source") == source).orderBy("doc_id").collect())
        for i in range(0, len(joined), 5000):
            whole += reference.encode(joined[i : i + 5000]).ids
    blocks = {r.seq_id: list(r.tokens) for r in built.blocks.collect()}
    assert blocks == {i: whole[i * 128 : (i + 1) * 128] for i in range(len(whole) // 128)}
    meta = built.meta.first()
    assert meta["total_tokens"] == len(whole) and meta["n_sequences"] == len(blocks) and meta["dtype"] == "H"
    shards.write(built.blocks, str(tmp_path / "bin"), {"tokens": meta["dtype"]}, shard_blocks=64)
    files = sorted((tmp_path / "bin" / "tokens").iterdir())
    stored = b"".join(f.read_bytes() for f in files)
    assert stored == np.array(whole[: len(blocks) * 128], dtype="<u2").tobytes()
    assert sum(f.stat().st_size for f in files) == meta["file_size"]
    sinks.write_packed(built.blocks, str(tmp_path / "packed"), built.meta)
    named = sinks.read_processed_meta(spark, str(tmp_path / "*" / "meta")).first()
    assert named["name"] == "packed" and named["n_sequences"] == len(blocks)


def test_packed_rows_name_their_blocks_where_numbers_are_missing(spark):
    df = spark.createDataFrame([(i, [i, i + 1]) for i in (0, 2, 3, 7)], "seq_id long, tokens array<int>").coalesce(1)
    rows = sinks.pack_bytes(df, {"tokens": "H"}).collect()
    got = {}
    for r in rows:
        values = np.frombuffer(r.tokens, "<u2").reshape(r.n_sequences, 2).tolist()
        got |= {r.first_seq + k: v for k, v in enumerate(values)}
    assert got == {i: [i, i + 1] for i in (0, 2, 3, 7)}


def test_example_job(spark, data, trained):
    tokenizer, _, _ = trained
    turns = spark.read.parquet(f"{data}/conversations.parquet")
    nested = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("conv"))
    blocks, meta, grown = corpus.build_examples(nested, "conv", "conv_id", tokenizer, "chatml", 256)
    row = meta.first()
    assert grown.size == tokenizer.size + 2 and row["vocab_expanded"] and row["total_tokens"] == blocks.count() * 256
    assert blocks.where("size(tokens) <> 256 OR size(mask) <> 256").count() == 0


def test_queries_train_the_default_size_on_the_data_as_they_are(spark, tmp_path):
    from loomstone.plans import token_queries

    text = " ".join(f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz")
    for text in (text * 2, "other words other words"):
        spark.createDataFrame([(1, text)], "doc_id bigint, text string").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        learned = token_queries.bpe_merges(spark, str(tmp_path)).count()
        assert learned == len(bpe.train(spark.createDataFrame([(text,)], "t string"), "t", 8000).merges)
        assert token_queries.trained(spark, str(tmp_path)).size == learned + 5 + len(set(text.encode()))
        assert learned > 300 or text.startswith("other")


@pytest.mark.parametrize("rows,leading,tables", [(60_000, 64, 10), (60, 2, 1), (200, 4, 2), (3000, 500, 3)])
def test_merges_are_the_same_in_rounds_of_any_size(spark, tmp_path, monkeypatch, rows, leading, tables):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aaab ccd") for _ in range(rng.randint(0, 90))) for _ in range(60)] + ["aaaaaaa aaaa abababab babab cdcdcd é é"]
    reference = library(write_files(tmp_path, texts), 110)
    for name, value in (("ROWS", rows), ("LEADING", leading), ("ROUNDS_PER_TABLE", tables), ("CHUNK_SYMBOLS", 50)):
        monkeypatch.setattr(merges, name, value)
    tokenizer = bpe.train(spark.createDataFrame([(t,) for t in texts], "t string"), "t", 110)
    assert tokenizer.merges == merges_of(reference)
    assert tokenizer.vocab == reference.get_vocab()


def test_passes_equal_one_merge_after_another():
    rng = np.random.default_rng(2)
    for _ in range(200):
        symbols, word = rng.integers(0, 5, 80).astype(np.int32), np.sort(rng.integers(0, 12, 80))
        chosen, top = [], 5
        for _ in range(int(rng.integers(1, 9))):
            left, right = (int(v) for v in rng.integers(0, top, 2))
            if (left, right) not in [m[:2] for m in chosen]:
                chosen.append((left, right, top))
                top += 1
        once, once_word, hit = symbols, word, np.zeros(12, bool)
        for step in merges.passes(chosen):
            once, once_word = merges.Pass(step, top).apply(once, once_word, hit)
        slow = []
        for w in range(12):
            run = symbols[word == w].tolist()
            for left, right, new in chosen:
                out, k = [], 0
                while k < len(run):
                    pair = run[k : k + 2] == [left, right]
                    out.append(new if pair else run[k])
                    k += 1 + pair
                run = out
            slow.append(run)
            assert hit[w] == (run != symbols[word == w].tolist())
        assert once.tolist() == [s for run in slow for s in run]


def test_compression_counts_ids(spark, data, trained):
    tokenizer, reference, texts = trained
    docs = spark.read.parquet(f"{data}/documents.parquet").select("lang", "text")
    got = packing.compression(docs.withColumn("ids", bpe.encode(tokenizer, F.col("text"))), "lang", F.length("text"), F.size("ids")).collect()
    expected = {}
    for r in docs.collect():
        chars, tokens = expected.get(r.lang, (0, 0))
        expected[r.lang] = (chars + len(r.text), tokens + len(reference.encode(r.text).ids))
    assert {r.lang: (r.chars, r.tokens, r.chars_per_token) for r in got} == {k: (c, t, c / t) for k, (c, t) in expected.items()}


def test_tokenizer_of_the_same_words_is_learned_once(spark, monkeypatch):
    docs = spark.createDataFrame([("low lower lowest new newer",), ("wide wider widest 12",)], "t string")
    first = bpe.train_once(docs, "t", 60)
    monkeypatch.setattr(merges, "learn", None)
    assert bpe.train_once(docs.repartition(3), "t", 60) == first
    with pytest.raises(TypeError):
        bpe.train_once(docs.unionAll(docs.limit(1)), "t", 60)


def _peak(work):
    """MB that ``work`` holds at most beyond what was there."""
    tracemalloc.start()
    try:
        result = work()
        return result, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_wide_batch_is_encoded_and_decoded_in_bounded_slices(trained, monkeypatch):
    tokenizer, _, texts = trained
    monkeypatch.setattr(encoding, "CHUNK_BYTES", 1 << 16)
    batch = pa.array((texts * 40)[: 40 * len(texts)] + [None, ""], pa.string()).slice(0, 6000)
    own = bpe.encoder(tokenizer)
    encoded, most = _peak(lambda: list(encoding.each(iter([batch]), own.encode_texts, encoding.text_bytes)))
    lists = pa.concat_arrays(encoded)
    assert len(encoded) > 10 and lists.to_pylist() == own.encode_texts(batch).to_pylist()
    assert most < 40
    back = {c: b for b, c in bpe.byte_alphabet().items()}
    spelling = [t.encode() if t in tokenizer.special else bytes(back[c] for c in t) for t, _ in sorted(tokenizer.vocab.items(), key=lambda item: item[1])]
    decoded, most = _peak(lambda: list(encoding.each(iter([lists]), lambda part: encoding.spelled_out(part, spelling), encoding.list_bytes)))
    assert pa.concat_arrays(decoded).to_pylist() == [t or "" for t in batch.to_pylist()]
    assert len(decoded) > 10 and most < 40


def test_conversations_are_masked_alike_in_slices(trained, monkeypatch):
    own = bpe.encoder(trained[0])
    kind = pa.list_(pa.struct([("head", pa.string()), ("body", pa.string()), ("assistant", pa.bool_())]))
    turn = lambda n: {"head": f"user {n}:", "body": None if n % 7 == 0 else " it's so" * n, "assistant": n % 2 == 0}
    parts = pa.array([[turn(n) for n in range(k)] if k % 5 else None for k in range(40)], kind)
    whole = own.examples(parts.slice(3))
    monkeypatch.setattr(encoding, "CHUNK_BYTES", 200)
    sliced = list(encoding.each(iter([parts.slice(3)]), lambda rows: pa.StructArray.from_arrays(own.examples(rows), names=["tokens", "mask"]), encoding.part_bytes))
    assert len(sliced) > 5
    assert [[r[c] for s in sliced for r in s.to_pylist()] for c in ("tokens", "mask")] == [w.to_pylist() for w in whole]


def test_only_neighbours_of_a_merge_are_looked_up_again(trained):
    tokenizer, reference, texts = trained
    own, asked = bpe.encoder(tokenizer), []
    look = own._slots
    own._slots = lambda left, right: asked.append(len(left)) or look(left, right)
    word = "".join(t for t in re.findall("[a-z]+", " ".join(texts)))[:4000]
    ids = own.encode(word)
    assert ids == reference.encode(word).ids
    assert sum(asked) < len(word) + 2 * (len(word) - len(ids))


@pytest.mark.parametrize("held", [1, 3])
def test_pretokens_are_counted_over_several_chunks(monkeypatch, held):
    texts = ["a b\nb a", None, "", "it's  x\n\n", "b", "é b"] * 5
    whole = Counter()
    for batch in encoding.line_pieces(iter([pa.record_batch([pa.array(texts)], names=["t"])])):
        whole.update(dict(zip(*(c.to_pylist() for c in batch.columns))))
    monkeypatch.setattr(encoding, "SPLIT_BYTES", 6)
    monkeypatch.setattr(encoding, "COUNTED_CHUNKS", held)
    batches = list(encoding.line_pieces(iter([pa.record_batch([pa.array(texts)], names=["t"])])))
    parts = Counter()
    for batch in batches:
        for token, n in zip(*(c.to_pylist() for c in batch.columns)):
            parts[token] += n
    assert parts == whole and len(batches) > 3


def test_pending_merges_of_several_rounds_share_passes(spark, monkeypatch):
    """Passes are planned over all merges since the words were written, so there are fewer than round by round."""
    words = [("abcd", 9), ("abxy", 7), ("xyzw", 6), ("cdzw", 5), ("aaaa", 4), ("wzab", 3)]
    counts = spark.createDataFrame([(w, n) for w, n in words], "token string, n bigint")
    seen = []
    plan_passes = merges.passes
    monkeypatch.setattr(merges, "LEADING", 1)
    monkeypatch.setattr(merges, "passes", lambda m: seen.append(len(m)) or plan_passes(m))
    learned = bpe.train_counts(counts, 30, 2).merges
    assert len(seen) > 2 and max(seen) == len(learned)
