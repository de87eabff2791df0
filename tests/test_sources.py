import csv
import json
import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstone.functions import logs
from loomstone.operators import convert, formats, packing, profile
from loomstone.plans import corpus, inputs, source_queries
from loomstone.sources import files, shards, sinks


def write(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_lines_are_numbered_across_splits(spark, tmp_path):
    path = write(tmp_path, "a.txt", "".join(f"line {i}\n" for i in range(5000)) + "\nlast")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.read_lines(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.line_no: r.line for r in rows} == {i + 1: x for i, x in enumerate([f"line {i}" for i in range(5000)] + ["", "last"])}


def test_text_must_be_utf8(spark, tmp_path):
    assert files.read_text(spark, write(tmp_path, "good.txt", "é\n世")).first()["text"] == "é\n世"
    with pytest.raises(Exception, match="UTF"):
        files.read_text(spark, write(tmp_path, "bad.txt", b"caf\xe9")).collect()


def test_jsonl_skips_what_is_no_object(spark, tmp_path):
    path = write(tmp_path, "x.jsonl", '{"a": 1}\n\n  \n{bad\n[1]\n "s"\n{"b": {"c": 2}}\n')
    rows = files.read_jsonl(spark, path).orderBy("line_no").collect()
    assert [(r.line_no, json.loads(r.line)) for r in rows] == [(1, {"a": 1}), (7, {"b": {"c": 2}})]


@pytest.mark.parametrize(
    "content,expected",
    [
        ('[{"a": 1}, 5, {"b": "é"}]', [{"a": 1}, {"b": "é"}]),
        ('{"a": [1]}', [{"a": [1]}]),
        ('{"data": [{"x": 1}, {"y": 2}], "n": 2}', [{"x": 1}, {"y": 2}]),
        ('{"data": 5}', [{"data": 5}]),
    ],
)
def test_json_shapes(spark, tmp_path, content, expected):
    rows = files.read_json(spark, write(tmp_path, "x.json", content)).orderBy("line_no").collect()
    assert [json.loads(r.line) for r in rows] == expected


def test_delimited_values_stay_strings(spark, tmp_path):
    path = write(tmp_path, "x.csv", 'a,b\n1,"x, ""y""\nz"\n,007\n')
    rows = files.read_delimited(spark, path).collect()
    assert [tuple(r) for r in rows] == [("1", 'x, "y"\nz'), (None, "007")]
    assert tuple(files.read_delimited(spark, write(tmp_path, "x.tsv", "a\tb\n1\t2\n")).first()) == ("1", "2")


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def random_field(rng):
    return "".join(rng.choice(["a", "b", ",", '"', "\n", "\r\n", "\t", " ", "é", '""', ',"', "long " * 30]) for _ in range(rng.randrange(9)))


@pytest.mark.parametrize("sep,ext", [(",", "csv"), ("\t", "tsv")])
def test_delimited_records_are_cut_right_in_any_split(spark, tmp_path, small_splits, sep, ext):
    rng = random.Random(ext)
    table = [[str(i), random_field(rng) + "x", random_field(rng) + "y"] for i in range(700)]
    table[300][1] = "over several splits \n" * 900 + '"'
    with open(tmp_path / f"t.{ext}", "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, delimiter=sep, lineterminator="\n")
        out.writerow(["n", "b`c", "d"])
        out.writerows(table)
        f.write("\n\n")
    read = files.read_delimited(spark, str(tmp_path / f"t.{ext}"), numbered=True)
    assert spark.read.text(str(tmp_path / f"t.{ext}")).rdd.getNumPartitions() > 20
    rows = read.orderBy("rec_ord").collect()
    assert [list(r)[2:] for r in rows] == table and [r.rec_ord for r in rows] == list(range(1, 701))
    assert [r.n for r in files.count_rows(spark, str(tmp_path / f"t.{ext}")).collect()] == [700]


def test_delimited_odd_files(spark, tmp_path):
    path = write(tmp_path, "x.csv", 'a,b\r\n\r\n1,q"w\r\n"un\nclosed,2\n')
    assert [tuple(r) for r in files.read_delimited(spark, path, numbered=True).select("rec_ord", "a", "b").orderBy("rec_ord").collect()][0] == (1, "1", 'q"w')
    assert [r.n for r in files.count_rows(spark, path).collect()] == [2]
    assert [r.n for r in files.count_rows(spark, write(tmp_path, "h.csv", "a,b\n")).collect()] == [0]
    assert files.read_delimited(spark, str(tmp_path / "h.csv")).collect() == []


def random_value(rng, depth):
    kind = rng.randrange(9 if depth else 6)
    if kind < 3:
        return "".join(rng.choice(["a", "}", "{", "]", "[", '"', "\\", ",", "é", "\n", "pad " * 20]) for _ in range(rng.randrange(6)))
    if kind < 6:
        return rng.choice([None, True, 1, -2.5, ""])
    if kind < 7:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    keys = rng.sample("zyxwab", rng.randrange(5))
    return {k: random_value(rng, depth - 1) for k in keys}


@pytest.mark.parametrize("seed,indent", [(1, None), (2, 2), (3, None)])
def test_json_arrays_are_cut_right_in_any_split(spark, tmp_path, small_splits, seed, indent):
    rng = random.Random(seed)
    data = [random_value(rng, 3) if rng.random() < 0.3 else {"z": i, "a": random_value(rng, 2), "deep": random_value(rng, 3)} for i in range(500)]
    data[250] = {"z": "} , {" * 3000, "a": [[], {}, [{}]]}
    path = write(tmp_path, "x.json", "\ufeff " * (seed == 3) + json.dumps(data, ensure_ascii=False, indent=indent) + "\n" * seed)
    assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 10
    rows = files.read_json(spark, path).orderBy("line_no").collect()
    objects = [(i + 1, v) for i, v in enumerate(data) if isinstance(v, dict)]
    assert [(r.line_no, json.loads(r.line)) for r in rows] == objects
    assert [list(json.loads(r.line)) for r in rows] == [list(v) for _, v in objects]
    assert [r.n for r in files.count_rows(spark, path).collect()] == [500]


@pytest.mark.parametrize("content,n", [("[]", 0), (" [ ] ", 0), ("[1]", 1), ("[[]]", 1), ('["a,]}", 2]', 2), ('[{"a": 1}]', 1), ('{"data": [1, 2]}', 2), ('{"data": 1}', 1)])
def test_json_counts(spark, tmp_path, content, n):
    assert [r.n for r in files.count_rows(spark, write(tmp_path, "x.json", content)).collect()] == [n]


@pytest.mark.parametrize("content", ['[{"a": 1}', '[{"a": 1}, {"b": "x}]', '{"a": 1', "[{bad}]", "nothing"])
def test_malformed_json_documents_are_an_error(spark, tmp_path, content):
    with pytest.raises(Exception):
        files.read_json(spark, write(tmp_path, "x.json", content)).collect()


def test_keys_of_json_documents_keep_their_order(spark):
    docs = spark.createDataFrame([(1, '[{"z": 1, "a": {"y": 2, "b": 3}}, "{x}", null]'), (2, '{"n": 0, "data": [{"q": 1, "c": 2}]}'), (3, '{"z": 1, "a": 2}')], "k int, doc string")
    rows = files.json_documents(docs, "k", "doc").orderBy("k", "line_no").collect()
    assert [(r.k, r.line_no, json.dumps(json.loads(r.line))) for r in rows] == [
        (1, 1, '{"z": 1, "a": {"y": 2, "b": 3}}'), (2, 1, '{"q": 1, "c": 2}'), (3, 1, '{"z": 1, "a": 2}'),
    ]


def test_catalogue_and_job_lists(spark, tmp_path):
    for name in ("b.TXT", "a.jsonl", "c.parquet", "d.bin", "e.json"):
        write(tmp_path, name, name)
    os.utime(tmp_path / "c.parquet", (time.time() + 100, time.time() + 100))
    listed = files.list_files(spark, str(tmp_path))
    assert [(r.name, r["size"], r.ext) for r in listed.collect()] == [
        ("a.jsonl", 7, ".jsonl"), ("b.TXT", 5, ".txt"), ("c.parquet", 9, ".parquet"), ("e.json", 6, ".json"),
    ]
    assert files.list_files(spark, str(tmp_path), newest_first=True).first()["name"] == "c.parquet"
    jobs = {job: [r.name for r in files.files_for_job(listed, job).orderBy("name").collect()] for job in files.JOB_EXTENSIONS}
    assert jobs == {"text": ["a.jsonl", "b.TXT", "e.json"], "sft": ["a.jsonl", "e.json"], "tokenizer": ["a.jsonl", "b.TXT"]}


def test_records_of_every_kind_of_file(spark, tmp_path):
    def texts(path, columns=None, separator="|"):
        return [r.text for r in corpus.read_records(spark, path, columns, separator).orderBy("rec_ord").collect()]

    assert texts(write(tmp_path, "a.jsonl", '{"t": " x ", "u": " "}\n{"t": 5}\n{"u": "y"}\n'), ["t", "u"]) == ["x|", "y"]
    assert texts(write(tmp_path, "a.json", '[{"t": "x"}, {"u": "z"}]'), ["t", "u"]) == ["x", "z"]
    assert texts(write(tmp_path, "a.csv", "t,u\n x , \n,\n,b\n"), ["t", "u"]) == ["x", "b"]
    assert texts(write(tmp_path, "a.txt", "plain\ntext")) == ["plain", "text"]


def test_corpus_of_files_is_each_file_joined(spark, tmp_path):
    paths = [
        write(tmp_path, "a.jsonl", '{"t": " x "}\n{"t": "yy"}\n'),
        write(tmp_path, "b.txt", "plain\n\ntext\r\n\n"),
        write(tmp_path, "c.txt", "no newline at the end 世"),
        write(tmp_path, "d.csv", "t,u\n1,2\n,3\n"),
    ]
    records, order = corpus.read_corpus(spark, paths, {"a.jsonl": ["t"], "d.csv": ["t", "u"]})
    chunks = packing.chunk_text(records, ["source"], "rec_ord", "text", 5, F.col("gap"))
    whole = {}
    for r in chunks.join(order, "source").orderBy("file_ord", "chunk").collect():
        whole[r.file_ord] = whole.get(r.file_ord, "") + r.text
    assert whole == {0: "x\n\nyy", 1: "plain\n\ntext\r\n\n", 2: "no newline at the end 世", 3: "1\n2\n\n3"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("世", None), ("b", 2)], "t string, n int")
    sinks.write_jsonl(df.coalesce(1), str(tmp_path / "j"))
    lines = spark.read.text(str(tmp_path / "j")).collect()
    assert [json.loads(r.value) for r in lines] == [{"t": "世", "n": None}, {"t": "b", "n": 2}] and "世" in lines[0].value
    sinks.write_corpus(df.coalesce(1), "t", str(tmp_path / "c"))
    part = next(p for p in (tmp_path / "c").iterdir() if p.suffix == ".txt")
    assert part.read_text() == "世\n\nb\n\n"


def test_masks_are_exported_as_bytes(spark, tmp_path):
    df = spark.createDataFrame([(0, [1, 70000], [0, 1]), (1, [2, 3], [1, 1])], "seq_id long, tokens array<int>, mask array<int>")
    packed = sinks.pack_bytes(df.coalesce(1), {"tokens": "I", "mask": "B"}).orderBy("first_seq").collect()
    assert b"".join(bytes(r["mask"]) for r in packed) == bytes([0, 1, 1, 1])
    assert b"".join(bytes(r["tokens"]) for r in packed) == sinks.as_array([1, 70000, 2, 3], "I").tobytes()
    assert sum(r.n_sequences for r in packed) == 2


def test_concatenation_keeps_list_order(spark):
    a = spark.createDataFrame([(5, "x")], "i int, t string")
    b = spark.createDataFrame([(1, 2)], "j int, k int")
    rows = files.concat_sources([(a, "i"), (b, "j")]).orderBy("file_ord", "rec_ord").collect()
    assert [(r.file_ord, r.rec_ord, r.t, r.k) for r in rows] == [(0, 5, "x", None), (1, 1, None, 2)]


def test_records_with_a_text_above_20_million_characters_are_kept(spark, tmp_path):
    size = 21_000_000
    long = F.repeat(F.lit("x"), size)
    good = F.concat(F.lit('{"event": "step", "body": "'), long, F.lit('", "dialog": ["hi"], "question": "q", "answer": "a"}'))
    lines = spark.range(1).select(F.explode(F.array(good, F.concat(F.lit('{"event": "step", "body": "'), long))).alias("line"), F.lit(1).alias("no"))
    assert [r.k for r in lines.select(formats.record_keys(F.col("line")).alias("k")).collect()] == [["event", "body", "dialog", "question", "answer"], None]
    rec = convert.parse_records(lines, "line").select(F.length("rec.body").alias("body"), F.length(F.col("own")[1]).alias("own"))
    assert rec.collect() == [(size, size)]
    good_lines, bad = convert.split_malformed(lines, "line", "no")
    assert (good_lines.count(), bad.collect()) == (1, [(1, "line 1: malformed JSON")])
    assert lines.select(F.size(convert.dialog_values(F.col("line"), "dialog")).alias("n")).where("n > 0").count() == 1
    assert [r.e for r in lines.select(logs.parse_event(F.col("line"))["event"].alias("e")).collect()] == ["step", None]
    cells = profile.cells_of_records(lines, "line", "no").where("name = 'body'")
    assert cells.select(F.length("value")).collect() == [(size,)]
    lines.select("line").write.text(str(tmp_path / "long.jsonl"))
    assert files.read_jsonl(spark, str(tmp_path / "long.jsonl")).count() == 1
    assert corpus.read_records(spark, str(tmp_path / "long.jsonl"), ["body"]).select(F.length("text")).collect() == [(size,)]


# -- binary shards


def _blocks(spark, numbers, length=3):
    return spark.createDataFrame([(i, [i, 70000 + i, 2][:length], [1, 0, i % 2][:length]) for i in numbers], "seq_id long, tokens array<int>, mask array<int>")


KINDS = {"tokens": "I", "mask": "B"}


def test_shards_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    numbers = [i for i in range(500) if i not in (7, 8, 200)]  # holes end a shard
    random.Random(1).shuffle(numbers)
    df = _blocks(spark, numbers).repartition(6)
    shards.write(df, path, KINDS, shard_blocks=64)
    back = shards.read(spark, path)
    assert {r.seq_id: (r.tokens, r.mask) for r in back.collect()} == {r.seq_id: (r.tokens, r.mask) for r in df.collect()}
    assert back.rdd.getNumPartitions() > 5  # a shard is a partition
    assert shards.read(spark, path, "mask").columns == ["seq_id", "mask"]
    raw = {r.seq_id: bytes(r.tokens) for r in shards.read(spark, path, "tokens", raw=True).collect()}
    assert raw[9] == np.array([9, 70009, 2], "<u4").tobytes()
    names = sorted(p.name for p in (tmp_path / "t" / "tokens").iterdir())
    assert names == sorted(p.name for p in (tmp_path / "t" / "mask").iterdir()) and int(names[1].split("-")[0]) == 9
    with pytest.raises(FileExistsError):
        shards.write(df, path, KINDS)
    with pytest.raises(Exception, match="no column"):
        shards.read(spark, path, "other").collect()


def test_shards_append_overwrite_and_refuse(spark, tmp_path):
    path = str(tmp_path / "t")
    shards.write(_blocks(spark, range(10)), path, KINDS)
    shards.write(_blocks(spark, range(10, 30)), path, KINDS, mode="append")
    assert shards.read(spark, path).count() == 30
    before = sorted(p.name for p in (tmp_path / "t" / "tokens").iterdir())
    for wrong in (_blocks(spark, [5]), _blocks(spark, [40, 40]), _blocks(spark, [40], 2), spark.createDataFrame([(40, [1, -1, 2], [1, 1, 1])], "seq_id long, tokens array<int>, mask array<int>")):
        with pytest.raises(Exception, match="twice|elements|fit"):
            shards.write(wrong, path, KINDS, mode="append")
        assert shards.read(spark, path).count() == 30  # what failed left nothing that counts
    shards.write(_blocks(spark, range(3)), path, KINDS, mode="overwrite")
    left = sorted(p.name for p in (tmp_path / "t" / "tokens").iterdir())
    assert shards.read(spark, path).count() == 3 and len(left) == 1 and not set(left) & set(before)
    shards.write(_blocks(spark, []), path, KINDS, mode="overwrite")
    assert shards.read(spark, path).collect() == [] and list((tmp_path / "t" / "mask").iterdir()) == []
    with pytest.raises(Exception, match="manifest"):
        shards.read(spark, str(tmp_path / "none")).collect()


def test_a_repeated_attempt_leaves_no_second_shard(tmp_path):
    writer = shards.ShardWriter(str(tmp_path), KINDS, 64, overwrite=False)
    batch = pa.RecordBatch.from_pydict({"seq_id": [0, 1], "tokens": [[1, 2], [3, 4]], "mask": [[0, 1], [1, 1]]})
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch]))
    assert lost.shards != kept.shards and len(list((tmp_path / "tokens").iterdir())) == 2
    writer.commit([kept, None])
    assert [p.name for p in (tmp_path / "tokens").iterdir()] == [kept.shards[0][2]] == [p.name for p in (tmp_path / "mask").iterdir()]
    gone = writer.write(iter([pa.RecordBatch.from_pydict({"seq_id": [9], "tokens": [[1, 2]], "mask": [[0, 1]]})]))
    writer.abort([gone, None])
    assert len(list((tmp_path / "tokens").iterdir())) == 1


def test_row_counts_write_without_moving_the_texts(spark, tmp_path, monkeypatch):
    """Only the JSON array, one a source, is dealt by source; it is written record by record."""
    rows = [(i, None if i == 7 else f'say "hi", {i}\nnext', "ab"[i % 2]) for i in range(40)] + [(None, "x", "a")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(inputs, "scratch", lambda spark, name: str(tmp_path / name))
    found = {(r.source, r.ext): r.n for r in source_queries.row_counts_by_reader(spark, str(tmp_path)).collect()}
    size = {"a": 21, "b": 20}
    for source in "ab":
        lines = sum(1 if r[1] is None else r[1].count("\n") + 1 for r in rows if r[2] == source)
        objects = sum(r[0] is None or r[0] % 5 != 0 for r in rows if r[2] == source)
        expected = {"csv": size[source], "tsv": size[source], "json": size[source] + 1, "jsonl": objects, "txt": lines}
        assert {ext: found[source, ext] for ext in expected} == expected
        assert len(list((tmp_path / "counted-csv" / f"source={source}").glob("part-*"))) > 1
        (array,) = (tmp_path / "counted-json" / f"source={source}").glob("part-*")
        values = json.loads(array.read_text())
        ids = [v.get("doc_id") for v in values[1:]]
        assert values[0] == 0 and ids == sorted(ids, key=lambda i: -1 if i is None else i) and len(ids) == size[source]
