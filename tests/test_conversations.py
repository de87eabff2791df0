import json

import pytest
from pyspark.sql import functions as F

from loomstone.functions import templates as tp, turns as tn
from loomstone.operators import chat, convert, formats as fm
from loomstone.plans import corpus

TURN = "array<struct<role:string,from:string,content:string,value:string>>"


def expr(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def conv(rows):
    return F.array(*[tn.turn(r, F.lit(c)) for r, c in rows]).cast(tn.CONV_TYPE)


def pairs(value):
    return None if value is None else [(t["role"], t["content"]) for t in value]


def records(spark, *objects):
    lines = [(i, o if isinstance(o, str) else json.dumps(o, ensure_ascii=False)) for i, o in enumerate(objects)]
    return convert.parse_records(spark.createDataFrame(lines, "i int, line string"), "line").orderBy("i")


DETECTED = [
    ({"instruction": "a"}, "alpaca", "other", "unknown", "unchanged"),
    ({"instruction": "a", "output": "b"}, "alpaca", "alpaca", "alpaca", "alpaca"),
    ({"input": "a", "output": "b"}, "alpaca", "other", "qa:input,output", "mapped"),
    ({"prompt": "a", "response": "b"}, "completion", "other", "qa:prompt,response", "mapped"),
    ({"question": "a", "response": "b"}, "qa", "other", "openorca", "unchanged"),
    ({"conversations": [{"from": "human", "value": "x"}]}, "sharegpt", "sharegpt", "conversations", "sharegpt"),
    ({"text": "a"}, "text_only", "text", "unknown", "text"),
]


@pytest.mark.parametrize("record,upload,listing,strict,bulk", DETECTED)
def test_detectors(spark, record, upload, listing, strict, bulk):
    keys = F.col("keys")
    listed = F.coalesce("rec.conversations", "rec.messages").isNotNull()

    def holds(name):
        return F.get(F.col(f"rec.{name}"), F.lit(0)).isNotNull()

    row = records(spark, record).select(
        fm.detect_upload(keys),
        fm.detect_listing(keys),
        fm.detect_sft(keys, listed, F.col("rec.conversation").isNotNull()),
        fm.detect_bulk(keys, holds("conversations"), holds("messages"), F.size("rec.dialog") > 0),
    ).first()
    assert tuple(row) == (upload, listing, strict, bulk)


def test_normalize(spark):
    turns = F.from_json(F.lit('[{"from":"human","value":"hi"},{"from":"bot","value":""},{"from":"gpt","value":"yo"}]'), TURN)
    assert pairs(expr(spark, tn.normalize_turns(turns))) == [("user", "hi"), ("assistant", "yo")]
    short = F.from_json(F.lit('[{"from":"human","value":"hi"},{"from":"bot","value":""}]'), TURN)
    assert expr(spark, tn.normalize_turns(short)) is None
    assert pairs(expr(spark, tn.normalize_turns(short, drop_empty=False))) == [("user", "hi"), ("assistant", "")]
    again = F.transform(tn.normalize_turns(turns), lambda t: F.struct(t["role"], F.lit(None).cast("string").alias("from"), t["content"], F.lit(None).cast("string").alias("value")))
    assert pairs(expr(spark, tn.normalize_turns(again))) == [("user", "hi"), ("assistant", "yo")]


def test_alpaca_rules(spark):
    a = [F.lit(" a "), F.lit(" "), F.lit("b")]
    assert pairs(expr(spark, tn.alpaca_strict(*a))) == [("user", "a"), ("assistant", "b")]
    assert pairs(expr(spark, tn.alpaca_lenient(*a))) == [("user", " a \n "), ("assistant", "b")]
    assert expr(spark, tn.alpaca_strict(F.lit("a"), F.lit(""), F.lit(" "))) is None


def test_dialog_of_strings_and_objects_alternates(spark):
    line = F.lit('{"d": ["hi", {"text": "yo"}, 5, "ok", {"role": "system", "content": "s"}, {"n": 1}], "chat": "no list"}')
    turns = expr(spark, convert.dialog_to_sharegpt(convert.dialog_values(line, "d")))
    assert [(t["from"], t["value"]) for t in turns] == [("human", "hi"), ("gpt", "yo"), ("gpt", "ok"), ("system", "s"), ("gpt", '{"n":1}')]
    assert expr(spark, convert.dialog_values(line, "chat")) is None


def test_unknown_record_takes_two_longer_texts(spark):
    columns = [F.lit(" 12345 "), F.lit("first text"), F.lit(None).cast("string"), F.lit("second text")]
    assert pairs(expr(spark, tn.first_two_texts(columns))) == [("user", "first text"), ("assistant", "second text")]


@pytest.mark.parametrize(
    "text,found",
    [
        ("Q: What?\nA: That.\nQ: alone\nnext", [("What?", "That.")]),
        ("Quick fox\nA dog", []),
        ("q: x\nA dog", [("x", "dog")]),
        ("问：甲\n答：乙", [("甲", "乙")]),
        ("USER\u00a0a\nbot\tb", [("a", "b")]),
        ("Q:\nA: x", []),
        ("用户:一\r\n助手: 二\r", [("一", "二")]),
    ],
)
def test_question_answer_lines(spark, text, found):
    got = expr(spark, convert.qa_line_pairs(F.lit(text)))
    assert [(c[0]["content"], c[1]["content"]) for c in got] == found


def test_tab_pairs(spark):
    got = expr(spark, convert.tab_pairs(F.lit("abcd\tefgh\nabc\tefgh\n\nabcd \t efgh\tmore")))
    assert [(c[0]["content"], c[1]["content"]) for c in got] == [("abcd", "efgh"), ("abcd", "efgh")]


def test_fallback_ladder_prefers_json(spark):
    lines = {
        "both": ['{"instruction": "i", "output": "o"}', "Q: a", "A: b"],
        "qa": ["Q: a", "A: b", "long\tfield", "Q: c", "x", "A: d"],
        "tabs": ["long\tfield", "[1]"],
    }
    rows = [(s, n, x) for s, xs in lines.items() for n, x in enumerate(xs, 1)]
    got = convert.convert_lines(spark.createDataFrame(rows, "f string, n long, l string"), "f", "n", "l").collect()
    assert {(r.f, r.n, r.rule, r.conv[0]["content"]) for r in got} == {
        ("both", 1, "json", "i"), ("qa", 1, "qa_lines", "a"), ("tabs", 1, "tabs", "long"),
    }


def test_mixed_and_malformed_records(spark):
    df = records(
        spark,
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
        "broken",
        {"dialog": [{"from": "human", "value": "x"}]},
        {"question": "q", "response": "r"},
        {"other": 1},
        "[1]",
    )
    got = {r.i: pairs(r.c) for r in df.select("i", convert.mixed_conversation(F.col("keys"), F.col("rec")).alias("c")).collect()}
    assert got == {
        0: [("user", "a"), ("assistant", "b")], 2: [("user", "x")], 3: [("user", "q"), ("assistant", "r")], 4: None,
    }


def test_inject_system(spark):
    c = conv([("system", "old"), ("user", "u")])
    assert pairs(expr(spark, tn.inject_system(c, "new"))) == [("system", "new"), ("user", "u")]
    assert pairs(expr(spark, tn.inject_system(c, "  "))) == [("system", "old"), ("user", "u")]


def test_templates_and_spans(spark):
    c = conv([("user", "a"), ("assistant", "bc")])
    text = expr(spark, tp.render(c, "simple"))
    assert text == "### User:\na\n\n### Assistant:\nbc\n\n"
    spans = expr(spark, tp.assistant_spans(c, "simple"))
    assert [(s["span_start"], s["span_end"]) for s in spans] == [(28, 32)]
    llama = conv([("system", "s"), ("user", "u"), ("assistant", "x")])
    assert expr(spark, tp.render(llama, "llama")) == "<<SYS>>\ns\n<</SYS>>\n\n[INST] u [/INST]\nx\n"
    for template in tp.TEMPLATES:
        long = conv([("system", "s"), ("user", "ü世"), ("assistant", "x𝄞"), ("user", ""), ("assistant", "y")])
        text = expr(spark, tp.render(long, template))
        parts = expr(spark, tp.rendered_turns(long, template))
        spans = expr(spark, tp.assistant_spans(long, template))
        assert [text[s["span_start"] : s["span_end"]] for s in spans] == [p["body"] for p in parts if p["assistant"]]


def test_stop_cut(spark):
    assert expr(spark, tp.cut_at_stop(F.lit("hi<|im_end|>\nxx"), tp.STOP_TOKENS["chatml"])) == "hi"
    assert expr(spark, tp.cut_at_stop(F.lit("plain"), tp.STOP_TOKENS["simple"])) == "plain"


def test_titles_and_order(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "x" * 33), (2, 0, "user", "y" * 32)]
    df = spark.createDataFrame(rows, "c int, t int, r string, x string")
    titles = {r.c: r.title for r in chat.conversation_title(df, "c", "t", "r", "x").collect()}
    assert titles == {1: "x" * 32 + "...", 2: "y" * 32}
    chats = spark.createDataFrame([(1, False, 9), (2, True, 1), (3, True, 5), (4, False, 9)], "id int, pin boolean, ts int")
    assert [r.id for r in chat.pinned_then_recent(chats, "pin", "ts", "id").collect()] == [3, 2, 1, 4]


def test_text_route(spark):
    assert expr(spark, convert.text_route(F.lit("x ### Human: y"))) == "raw"
    assert expr(spark, convert.text_route(F.lit("x"))) == "alpaca"


@pytest.mark.parametrize(
    "first,fmt,shape",
    [
        ({"dialog": [{"text": "a"}, {"text": "b"}]}, "sharegpt", {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}),
        ({"dialog": ["hello there", "hi back"]}, "sharegpt", {"conversations": [{"from": "human", "value": "hello there"}, {"from": "gpt", "value": "hi back"}]}),
        ({"query": "q", "response": "r"}, "alpaca", {"instruction": "q", "input": "", "output": "r"}),
        ({"text": "t"}, "alpaca", {"instruction": "t", "input": "", "output": ""}),
        ({"text": "USER: t"}, "raw", {"text": "USER: t"}),
        ({"messages": [{"role": "user", "content": "x"}]}, "openai", {"messages": [{"role": "user", "content": "x"}]}),
    ],
)
def test_import_rows(spark, first, fmt, shape):
    rows = spark.createDataFrame([(json.dumps(first),)], "line string")
    got = corpus.import_rows(rows, "line").first()
    assert got["format"] == fmt and json.loads(got["line"]) == shape


def test_unknown_records_take_their_own_texts_in_order(spark):
    lines = [(1, '{"headline": "some title", "article": "the long text"}'), (2, '{"body": "first one", "n": 5, "title": "second one"}'), (3, '{"z": "only one here"}')]
    rows = convert.parse_records(spark.createDataFrame(lines, "i int, line string"), "line").orderBy("i")
    got = [r[0] for r in rows.select(convert.strict_conversation(F.col("keys"), F.col("rec"), F.col("own"))).collect()]
    assert [[t.content for t in c] if c else None for c in got] == [["some title", "the long text"], ["first one", "second one"], None]


@pytest.mark.parametrize(
    "lines,fmt,expected",
    [
        (["[1]", '{"messages": [{"role": "human", "content": "a"}, {"from": "gpt", "value": "b"}]}', '{"instruction": "x", "output": "y"}'], "conversations", [None, [("user", "a"), ("assistant", "b")], None]),
        (['{"instruction": "i", "output": "o"}', '{"instruction": " i2 ", "input": "x", "output": "o2", "question": "q"}', '{"question": "q", "response": "r"}'], "alpaca",
         [[("user", "i"), ("assistant", "o")], [("user", "i2\nx"), ("assistant", "o2")], None]),
        (['{"query": "q", "reply": "r"}', '{"query": "q2", "answer": "a2", "reply": ""}', "{cut"], "qa:query,reply", [[("user", "q"), ("assistant", "r")], None, None]),
        (['{"zz": "longer one", "n": 7, "aa": "longer two"}', '{"aa": "first text", "zz": "second text"}', '{"other": "long enough", "bb": "long enough"}'], "unknown",
         [[("user", "longer one"), ("assistant", "longer two")], [("user", "second text"), ("assistant", "first text")], None]),
        (['{"conversations": "no list", "messages": [{"role": "user", "content": "a"}, {"role": "bot", "content": "b"}]}'], "unknown", [None]),
        (["", "{"], "unknown", [None, None]),
    ],
)
def test_first_record_decides_the_format_of_all(spark, lines, fmt, expected):
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    converted, found = convert.convert_by_first_record(rows, "line", "i")
    assert found == fmt
    assert [r.conv and [tuple(t) for t in r.conv] for r in converted.orderBy("i").collect()] == expected
