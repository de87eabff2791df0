import random
import re
import sys
import tracemalloc
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomstone.functions import text as tx
from loomstone.operators import counting, extract, profile

SAMPLE = "Hello, 世界!\n\nabc 12\n"


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


def test_text_stats_of_the_sample(spark):
    row = profile.text_stats(spark.createDataFrame([(SAMPLE,)], "t string"), "t").first().asDict()
    assert row == {
        "chars": 19, "lines": 3, "non_blank_lines": 2, "words": 4, "cjk": 2, "ascii_letters": 8, "digits": 2,
        "punctuation": 2, "spaces": 5, "language": "en", "rough_tokens": 6,
    }
    simple = profile.simple_text_stats(spark.createDataFrame([(SAMPLE,)], "t string"), "t").first()
    assert simple["lines"] == 4 and simple["other"] == 2 and simple["primary_language"] == "en"


def test_character_classes_follow_python(spark):
    chars = [chr(c) for c in range(0x20000) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select(
        "c", tx.space_count("c").alias("space"), tx.digit_count("c").alias("digit"), tx.word_count("c").alias("word")
    )
    known = {c for c in chars if unicodedata.category(c) not in ("Cn", "Co")}
    for row in rows.collect():
        if row.c in known:
            assert row.space == row.c.isspace(), repr(row.c)
            assert row.word == (not row.c.isspace()), repr(row.c)
            if row.digit != row.c.isdigit():  # only digits newer than the JVM's Unicode tables may differ
                assert unicodedata.category(row.c) in ("Nd", "No")
    assert "".join(sorted(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())) == "".join(sorted(tx.WHITESPACE))


@pytest.mark.parametrize("seed", range(3))
def test_stats_follow_python_on_random_text(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab Z9\n\t .,é世界\u00a0\u3000²x") for _ in range(rng.randrange(60))) for _ in range(80)]
    rows = profile.text_stats(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "i").collect()
    for row in rows:
        t = texts[row.i]
        assert row.chars == len(t)
        assert row.lines == t.count("\n") + (1 if t and not t.endswith("\n") else 0)
        assert row.non_blank_lines == sum(1 for line in t.split("\n") if line.strip())
        assert row.words == len(t.split())
        assert row.digits == sum(c.isdigit() for c in t)
        assert row.spaces == sum(c.isspace() for c in t)
        assert row.punctuation == sum(not c.isalnum() and not c.isspace() for c in t)


@pytest.mark.parametrize("cjk,letters,guess", [(3, 5, "zh-en"), (6, 5, "zh"), (1, 5, "en"), (0, 0, "other"), (3, 10, "en")])
def test_language_guess(spark, cjk, letters, guess):
    assert spark.range(1).select(tx.language_guess(F.lit(cjk), F.lit(letters))).first()[0] == guess


def test_strip_and_truncate(spark):
    assert one(spark, "\u3000\x1c a b \n", tx.strip(F.col("t")))[0] == "a b"
    assert one(spark, "x" * 33, tx.truncated(F.col("t"), 32))[0] == "x" * 32 + "..."
    assert one(spark, "x" * 32, tx.truncated(F.col("t"), 32))[0] == "x" * 32
    assert one(spark, "\x1b[1;31mred\x1b[0m \x1b]0;title\x07done ", tx.strip_ansi(F.col("t")))[0] == "red done"


def lines_of(spark, lengths):
    return spark.createDataFrame([("f", "\n".join("x" * n for n in lengths))], "s string, t string")


def test_upper_median_and_bins(spark):
    counts = profile.line_length_counts(lines_of(spark, [1, 2, 3, 4]), "t", "s")
    assert profile.line_length_distribution(counts, "s").first()["median_length"] == 3
    counts = profile.line_length_counts(lines_of(spark, [1, 2, 3, 25]), "t", "s")
    bins = {r["range"]: r["n"] for r in profile.line_length_histogram(counts, "s").collect()}
    assert len(bins) == 10 and bins["1-2"] == 2 and bins["3-4"] == 1 and bins["19-20"] == 1 and sum(bins.values()) == 4


def test_char_and_word_counts_follow_python(spark):
    texts = [("a", "Ab ab\n世界 é𝄞"), ("b", ""), ("a", "xx"), ("b", "世")]
    df = spark.createDataFrame(texts, "k string, t string")
    whole = {r.char: r.n for r in profile.char_counts(df, "t").collect()}
    assert whole == Counter("".join(t for _, t in texts))
    per_key = {(r.k, r.char): r.n for r in profile.char_counts(df, "t", "k").collect()}
    assert per_key == Counter((k, c) for k, t in texts for c in t)
    words = {r.word: r.n for r in profile.word_counts(df, "t").collect()}
    assert words == Counter(w for _, t in texts for w in re.findall(r"[\u4e00-\u9fff]|[a-zA-Z]+", t.lower()))


def test_half_filled_column_is_no_text(spark):
    rows = spark.createDataFrame([(i, "a long enough text" if i % 2 else "") for i in range(20)], "i int, story string")
    cells = profile.cells_of_columns(rows, "i")
    row = profile.with_column_roles(profile.column_profile(cells, cells)).where("name = 'story'").first()
    assert row["fill_rate"] == 50.0 and not row["is_text"] and row["non_empty"] == 10


def test_record_profile_of_mixed_types(spark):
    lines = ['{"text": "a long enough text", "n": 1}', '{"n": 2.5, "messages": [1], "x": null}', "broken {", "[1]"]
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    cells = profile.cells_of_records(df, "line", "i")
    kinds = {(r["name"], r["type"]) for r in cells.collect()}
    assert kinds == {("text", "str"), ("n", "int"), ("n", "float"), ("messages", "list"), ("x", "NoneType")}
    roles = {r["name"]: r for r in profile.with_column_roles(profile.column_profile(cells, cells)).collect()}
    assert roles["text"]["is_text"] and roles["messages"]["is_conversation"] and not roles["n"]["is_text"]
    assert [r["name"] for r in profile.suggest_columns(profile.column_profile(cells, cells)).collect()] == ["text"]


def test_join_columns_rules(spark):
    df = spark.createDataFrame([(" x ", "  ", "y"), ("", None, "")], "a string, b string, c string")
    assert [r.text for r in extract.extract_columns(df, ["a", "b", "c"], "|", keep_blank=True).collect()] == ["x||y"]
    assert [r.text for r in extract.extract_columns(df, ["a", "b", "c"], "|").collect()] == ["x|y"]


def test_text_column_choice(spark):
    assert extract.pick_text_column(spark.createDataFrame([(1, "b", "t")], "id int, body string, text string")) == "text"
    assert extract.pick_text_column(spark.createDataFrame([(1, "short")], "id int, body string")) == "id"
    assert extract.pick_text_column(spark.createDataFrame([(1, "long enough text")], "id int, body string")) == "body"


def test_preview(spark):
    df = spark.createDataFrame([("\n".join(map(str, range(40))),), ("a\n",)], "t string")
    first, second = extract.preview(df, "t").collect()
    assert first["preview"].split("\n") == [str(i) for i in range(30)] and first["total_lines"] == 40
    assert second["shown_lines"] == 2 and second["preview"] == "a\n"


def test_columns_of_records_are_suggested_in_their_own_order(spark):
    lines = ['{"zeta": "a long enough text", "title": "a long enough text", "body": "a long enough text", "n": 1}'] * 3
    cells = profile.cells_of_records(spark.createDataFrame(list(enumerate(lines)), "i int, line string"), "line", "i")
    suggested = profile.suggest_columns(profile.column_profile(cells, cells)).orderBy("rank").collect()
    assert [r["name"] for r in suggested] == ["zeta", "title", "body"]


def test_a_tally_equals_python_whatever_the_slices(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), "".join(rng.choice("aB c9\n\t.é世界\u3000²\U0001d11eİ") for _ in range(rng.choice([0, 1, 7, 300])))) for _ in range(300)]
    rows += [("a", None), ("only nulls", None), ("b", ""), ("b", "\n"), (None, "x\n\ny")]
    df = spark.createDataFrame(rows, "k string, t string").repartition(3)
    want = Counter()
    for k, t in rows:
        for item, n in {} if t is None else {
            "chars": len(t), "newlines": t.count("\n"), "words": len(t.split()), "non_blank_lines": sum(1 for x in t.split("\n") if x.strip()),
            "digits": sum(c.isdigit() for c in t), "lines": t.count("\n") + (t[-1:] not in ("", "\n")), "spaces": sum(c.isspace() for c in t),
            "punctuation": sum(not c.isalnum() and not c.isspace() for c in t), "cjk": sum("\u4e00" <= c <= "\u9fff" for c in t),
            "ascii_letters": sum(c.isascii() and c.isalpha() for c in t),
        }.items():
            want[k, "measure", item, None] += n
        want.update((k, "line", None, len(x)) for x in (t or "").split("\n") if x.strip())
        want.update((k, "char", c, None) for c in t or "")
        want.update((k, "word", w, None) for w in re.findall(r"[\u4e00-\u9fff]|[a-zA-Z]+", (t or "").lower()))
    for size in (64, counting.SLICE_BYTES):
        monkeypatch.setattr(counting, "SLICE_BYTES", size)
        got = counting.tally(df, "t", "k", kinds=("measure", "line", "char", "word")).collect()
        assert {(r.k, r.kind, r.item, r.length): r.n for r in got if r.n} == {k: n for k, n in want.items() if n}
        assert {r.n for r in got if r.k == "only nulls"} == {None}


def test_measures_keep_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, None, {"x": 1}), (2, "", None), (3, "a\nb", None)], "i int, t string, m map<string,int>")
    rows = {r.i: r for r in counting.measured(df, "t", "i", "m").collect()}
    assert rows[1].chars is None and rows[1].lines is None and rows[1].m == {"x": 1}
    assert (rows[2].chars, rows[2].lines, rows[3].chars, rows[3].lines, rows[3].words) == (0, 0, 3, 2, 2)
    assert counting.measured(df.limit(0), "t", "i").collect() == []
    assert counting.tally(df.limit(0), "t", kinds=("measure", "line", "char", "word")).collect() == []


def test_bytes_that_are_no_utf8_are_counted(spark):
    df = spark.createDataFrame([(bytearray(b"ab \xff\n"),), (bytearray("é".encode()),)], "b binary").select(F.col("b").cast("string").alias("t"))
    assert sorted(r.chars for r in counting.measured(df, "t").collect()) == [1, 5]


def test_a_report_reads_the_texts_once(spark, tmp_path):
    path = str(tmp_path / "texts")
    spark.createDataFrame([("a", "One two\nthree"), ("b", "x")], "k string, t string").write.parquet(path)
    plan = profile.dataset_report(spark.read.parquet(path), "t", "k")._jdf.queryExecution().optimizedPlan().toString()
    assert path not in plan and "MapInArrow" not in plan


def test_a_wide_batch_is_profiled_in_small_slices():
    texts = pa.array(["Ein Satz mit 12 Zeichen, é und 好.\n" * 40] * 6000, pa.string())
    batch = pa.record_batch([texts], names=["text"])
    tracemalloc.start()
    chars = sum(int(counting._Texts(part.column(0)).measures()["chars"].sum()) for part in counting._slices(iter([batch])))
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert chars == 6000 * len(texts[0].as_py())
    assert most < 80
