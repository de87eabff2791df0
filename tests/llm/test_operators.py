"""The ten operators on small tables: brute force, exact cases, and every awkward row."""

import collections
import itertools
import json
import math
import random
import time
import tracemalloc
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from loomstone.llm import (
    components, decontaminate, html_text, language_id, language_model, mixing, near_dedup, nearest, quality, tool_calls, toxicity,
)
from loomstone.llm.common import Scratch

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, node bigint, size string, score string"


def frame(spark, rows):
    """Documents from (doc_id, text, lang, source), with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, "s", "y") for r in rows], DOCS)


AWKWARD = [
    (1, "A b c d e f g", "en", "s1"), (2, None, None, None), (3, "", "en", "s1"), (4, "A b c d e f g", "en", "s1"), (4, "A b c d e f g", "en", "s1"),
    (None, "A b c d e f g", "de", None), (5, "one two", "de", "s2"), (6, "ONE\ttwo ", "de", ""), (7, "\x0b \n", "de", "é"), (8, "word " * 60000, "en", "s1"), (9, "12 ... 34", None, "s2"),
]


def words(text):
    return (text or "").encode().lower().split()


def sets_of(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = collections.defaultdict(list)
    for key, text in rows:
        sets[key].append(sets_of(text))
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def near_copies(seed, groups=6, size=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([5, 30, 90]))
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows) + 1, " ".join(text), "en", "s"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = near_copies(seed)
    got = {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    want = brute_components([(r[0], r[1]) for r in rows])
    assert got == {k: (c, len(sets_of(dict((r[0], r[1]) for r in rows)[k])), c == k) for k, c in want.items()}


def test_near_duplicates_awkward_rows(spark):
    got = near_dedup.near_duplicates(frame(spark, AWKWARD)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(AWKWARD)
    assert by[4].component_id == 1 and not by[4].kept and by[6].component_id == 5
    assert by[2].n_shingles == by[3].n_shingles == by[7].n_shingles == 0 and by[2].kept and by[7].component_id == 7
    assert by[None].component_id is None and by[None].kept and by[8].n_shingles == 1
    assert near_dedup.near_duplicates(frame(spark, [])).collect() == []


def test_tiles_across_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE_ROWS", 3)
    rows = near_copies(5, groups=2, size=25)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components([(r[0], r[1]) for r in rows])


def test_estimate_is_corrected_for_collisions():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = base[:2000], base[500:2500]  # similarity 0.6
    equal = sum(int(x == y) for x, y in zip(near_dedup.minima(a), near_dedup.minima(b)))
    packed = near_dedup.pack(near_dedup.minima(a)) ^ near_dedup.pack(near_dedup.minima(b))
    same = sum(1 for w in packed.tolist() for i in range(16) if not w >> 4 * i & 15)
    assert abs(equal / near_dedup.HASHES - 0.6) < 0.12
    assert abs((same / near_dedup.HASHES - 1 / 16) / (15 / 16) - 0.6) < 0.12


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400), (7, 7), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.comp for r in components.components(edges, Scratch(spark, "chain"), "c").collect()}
    assert got == {**{i: 0 for i in range(101)}, 400: 400, 500: 400}


# -- mixing


def brute_targets(sizes):
    keys = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(keys)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [k for k in keys if k not in capped]
        left = total - sum(2 * sizes[k] for k in capped)
        target = {k: 2 * sizes[k] if k in capped else left * weight[k] / sum(weight[f] for f in free) for k in keys}
        over = {k for k in free if target[k] > 2 * sizes[k]}
        if not over:
            return target
        capped |= over


def test_mixture_meets_targets_and_repeats(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 900), "en", rng.choice(["a", "b", "B", "é", None, "a", "a"])) for i in range(400)] + [(7, "w w", "en", "a")]
    run = lambda: mixing.taken_words(mixing.mix_sources(frame(spark, rows), Scratch(spark, "mix"), shard=8)).collect()
    got = run()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, run()))
    sizes, taken = collections.Counter(), collections.Counter()
    for r in got:
        assert r.taken <= 2 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * mixing.BLOCK


def test_mixture_awkward_rows(spark):
    run = lambda rows: mixing.taken_words(mixing.mix_sources(frame(spark, rows), Scratch(spark, "mix"))).collect()
    got = run(AWKWARD)
    assert len(got) == len(AWKWARD)
    assert {r.doc_id: r.size for r in got}[8] == 60000 and {r.doc_id: r.size for r in got}[2] == 0
    assert run([]) == []
    assert [r.target for r in run([(1, None, None, "s")])] == [0.0]


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_permutation_is_one(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3), F.lit("key")).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))


def test_slots_hold_every_block_as_often_as_the_quota_asks(spark):
    rows = [(i, "w " * 640, "en", "a" if i % 3 else "b") for i in range(60)]
    plan = mixing.mix_sources(frame(spark, rows), Scratch(spark, "mix"), shard=16)
    sources = {r.key: r for r in plan.sources.collect()}
    times = collections.defaultdict(collections.Counter)
    for r in plan.slots.collect():
        times[r.key][r.block] += 1
    for key, s in sources.items():
        assert sum(times[key].values()) == s.quota
        low = s.quota // s.blocks
        assert set(times[key].values()) <= {low, low + 1} and all(0 <= b < s.blocks for b in times[key])


# -- decontamination


def edit_distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_items_equal_brute_force(spark):
    rng = random.Random(8)
    alphabet = "abcdef g"
    items = [(i, "".join(rng.choices(alphabet, k=rng.choice([5, 20, 60, 120])))) for i in range(12)]
    docs = []
    for d in range(60):
        text = list("".join(rng.choices(alphabet, k=150)))
        if d % 2:
            part = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 9)):
                kind, at = rng.randrange(3), rng.randrange(len(part))
                part[at : at + (kind != 0)] = [] if kind == 1 else [rng.choice(alphabet)]
                part = part or ["a"]
            text[70:70] = part
        docs.append((d, "".join(text), "en", "s"))
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_items(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"), pass_chars=200).collect()}
    want = {}
    for d, text, *_ in docs:
        for i, item in items:
            item = decontaminate.normal(item)
            distance = edit_distance_in(item, decontaminate.normal(text))
            if distance <= int(len(item) * decontaminate.RATE):
                want[d, i] = distance
    assert set(got) == set(want) and all(want[k] <= v for k, v in got.items())


def test_items_awkward_rows(spark):
    items = spark.createDataFrame([(1, "A  B c"), (2, None), (None, "one two"), (3, ""), (4, "ONE two"), (5, "one two")], "item_id bigint, text string")
    got = decontaminate.find_items(frame(spark, AWKWARD), items).collect()
    assert collections.Counter((r.doc_id, r.item_id) for r in got) == {(1, 1): 1, (4, 1): 2, (None, 1): 1, (5, 4): 1, (6, 4): 1, (5, 5): 1, (6, 5): 1}
    assert decontaminate.find_items(frame(spark, []), items).collect() == []
    assert decontaminate.find_items(frame(spark, AWKWARD), items.limit(0)).collect() == []


def test_an_item_id_with_several_texts_finds_each(spark):
    texts = ["the quick brown fox jumps over it", "zebras graze where no river runs"]
    items = spark.createDataFrame([(7, t) for t in texts], "item_id bigint, text string")
    docs = [(0, f"a {texts[0]} b", "en", "s"), (1, f"a {texts[1]} b", "en", "s"), (2, f"{texts[0][:-2]}at {texts[1]}", "en", "s"), (3, "none", "en", "s")]
    got = decontaminate.find_items(frame(spark, docs), items).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == [(0, 7, 0), (1, 7, 0), (2, 7, 0)]


# -- learned scores


def corpus(spark, n=300):
    rng = random.Random(6)
    rows, quality_rows, toxic_rows = [], [], []
    for i in range(n):
        lang = ("en", "de", "es", "fr")[i % 4]
        own = {"en": "the of and thing", "de": "der und nicht schön", "es": "el los como ción", "fr": "le les être où"}[lang].split()
        text = [rng.choice(own) + rng.choice(["", "a", "er", "in"]) for _ in range(rng.randint(40, 200))]
        bad, toxic = i % 5 == 0, i % 6 == 1
        if bad:
            text = [w.upper() + "$$$" for w in text]
        if toxic:
            for _ in range(1 + i % 9):
                text.insert(rng.randrange(len(text)), rng.choice(["grumpwit", "grumpface", "snortling"]))
        rows.append((i, " ".join(text), lang, "s"))
        quality_rows.append((i, 0 if bad else 1))
        toxic_rows.append((i, int(toxic)))
    return rows, quality_rows, toxic_rows


def test_quality_separates_and_gradients_are_right(spark):
    rows, labels, _ = corpus(spark)
    known = spark.createDataFrame([x for x in labels if x[0] % 3] + [(None, 1), (5, None), (1, labels[1][1])], "doc_id bigint, label int")
    network = quality.fit(frame(spark, rows), known)
    got = {r.doc_id: r for r in quality.score(frame(spark, rows), network).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert sum(got[i].predicted == y for i, y in labels) >= 295
    x = np.random.default_rng(1).normal(size=(9, quality.FEATURES)).astype(np.float32)
    first, y = np.array([0, 4, 5, 9]), np.array([1.0, 0.0, 1.0], np.float32)
    small = quality.Network(np.zeros(quality.FEATURES, np.float32), np.ones(quality.FEATURES, np.float32))
    loss = lambda: -np.mean(np.log(np.where(y > 0, small.score(x, first), 1 - small.score(x, first))))
    gradient = small.gradient(x, first, y)
    for name in small.p:
        at = tuple(0 for _ in small.p[name].shape)
        was = small.p[name][at]
        small.p[name][at] = was + 1e-2
        up = loss()
        small.p[name][at] = was - 1e-2
        down = loss()
        small.p[name][at] = was
        assert abs((up - down) / 2e-2 - gradient[name][at]) < 2e-3


def test_severity_separates_grades(spark):
    rows, _, labels = corpus(spark)
    known = spark.createDataFrame([x for x in labels if x[0] % 3] + [(None, 1), (5, None)], "doc_id bigint, grade int")
    model = toxicity.fit(frame(spark, rows), known)
    got = {r.doc_id: r for r in toxicity.severity(frame(spark, rows), model).collect()}
    assert sum(got[i].toxic == bool(y) for i, y in labels) >= 290
    assert (np.diff(model.cuts) > 0).all()
    assert all(0 <= r.expected_severity <= toxicity.GRADES - 1 for r in got.values())


def test_language_by_family_and_pair(spark):
    rows, *_ = corpus(spark)
    machines = language_id.fit(frame(spark, [r for r in rows if r[0] % 3] + AWKWARD[:2]))
    got = {r.doc_id: r for r in language_id.predict(frame(spark, rows), machines).collect()}
    assert sum(got[r[0]].lang_pred == r[2] for r in rows) >= 295
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = {r.doc_id: r for r in language_id.predict(frame(spark, AWKWARD), machines).collect()}
    assert odd[2].lang_pred == odd[3].lang_pred == odd[7].lang_pred == odd[9].lang_pred == "und" and odd[1].lang_pred != "und"


def test_margins_do_not_depend_on_slices(monkeypatch):
    machines = language_id.Machines(["de", "en", "fr"])
    machines.weights[:] = np.random.default_rng(2).normal(size=machines.weights.shape)
    texts = ["hello über world", "", "x", "ça va bien " * 40]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    whole = machines.margins(data, offsets)
    monkeypatch.setattr(language_id, "SLICE_BYTES", 7)
    assert np.allclose(whole, machines.margins(data, offsets))
    for i, t in enumerate(texts):
        alone = np.frombuffer(t.encode(), np.uint8)
        assert np.allclose(whole[i], machines.margins(alone, np.array([0, len(alone)]))[0])


def test_learned_scores_awkward_rows(spark):
    rows, q, t = corpus(spark, 120)
    docs, none = frame(spark, AWKWARD), frame(spark, [])
    network = quality.fit(frame(spark, rows), spark.createDataFrame(q, "doc_id bigint, label int"))
    model = toxicity.fit(frame(spark, rows), spark.createDataFrame(t, "doc_id bigint, grade int"))
    assert quality.score(docs, network).count() == toxicity.severity(docs, model).count() == len(AWKWARD)
    assert quality.score(none, network).count() == toxicity.severity(none, model).count() == language_id.predict(none, None).count() == 0
    one = spark.createDataFrame([(1, 1)], "doc_id bigint, label int")
    assert quality.fit(docs, one) is None and {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert toxicity.fit(docs, one.withColumnRenamed("label", "grade")) is None
    assert not any(r.toxic for r in toxicity.severity(docs, None).collect())
    assert language_id.fit(none) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


# -- language model


def test_base_and_model_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language_model, "PART_KEYS", 50)
    rows = near_copies(9, groups=5, size=10) + [(100, None, "en", "s"), (101, "new WORDS here", "en", "s")]
    learned = lambda i: i % 7 != 2
    held = lambda i: learned(i) and i % 10 == 0
    df = frame(spark, rows)
    seen = {}
    real = language_model.learn_weights
    monkeypatch.setattr(language_model, "learn_weights", lambda bins, v: seen.setdefault("w", real(bins, v)))
    got = {r.doc_id: r for r in language_model.score(df, F.col("doc_id") % 7 != 2, F.col("doc_id") % 10 == 0).collect()}
    uni, bi = collections.Counter(), collections.Counter()
    chain = lambda t: ["<s>", *words(t), "</s>"]
    for i, t, *_ in rows:
        if learned(i):
            uni.update(chain(t)[1:])
            uni["<s>"] += 1
            bi.update(zip(chain(t), chain(t)[1:]))
    n, v = sum(uni.values()) - uni["<s>"], len(uni) - 1
    assert np.allclose(seen["w"].sum(axis=1), 1)
    for i, t, *_ in rows:
        tokens = chain(t)
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in tokens[1:])
        model = 0.0
        for a, b in zip(tokens, tokens[1:]):
            l = seen["w"][min(language_model.BUCKETS - 1, math.ceil(math.log2(uni[a] + 1)))]
            model += math.log10(l[0] * (bi[a, b] / uni[a] if uni[a] else 0) + l[1] * uni[b] / n + l[2] / (v + 1))
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens) - 1, sum(uni[w] > 0 for w in tokens[1:]), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, model, rel_tol=1e-9)


def batches_of(monkeypatch, texts, roles):
    """The batches of one task, without Spark."""
    monkeypatch.setattr(language_model, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(roles, pa.int32()), pa.array(texts, pa.string())], names=["id", "role", "text"])
    return list(language_model._batches([rows]))


def answered(asked):
    """What all parts answer to one batch."""
    table = pa.Table.from_batches(asked)
    return pa.concat_tables([language_model._answer(table.filter(pc.equal(table["part"], p))) for p in pc.unique(table["part"]).to_pylist()])


def test_language_model_memory_of_a_batch(monkeypatch):
    rng = np.random.default_rng(3)
    lines = [" ".join(f"w{x}" for x in rng.zipf(1.3, 2000) % 50000) for _ in range(300)]
    taken = {}
    batches_of(monkeypatch, ["a b"], [language_model.FOLD])  # what loads once

    def traced(step, make):
        tracemalloc.start()
        out = make()
        taken[step] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out

    tokens = 300 * 2001
    for held, roles in ((True, [language_model.FOLD] * 300), (False, [language_model.TRAIN, language_model.SCORED] * 150)):
        (rows,) = traced("batches", lambda: batches_of(monkeypatch, lines, roles))
        assert rows["n"][0].as_py() == tokens
        asked = traced("ask", lambda: list(language_model._ask(40)([rows])))
        back, left = answered(asked), pa.Table.from_batches([rows])
        if held:
            traced("bins", lambda: language_model._held_out_bins(40, 1000)(left, back))
        else:
            traced("scores", lambda: language_model._scores(40, tokens, 50000, np.full((language_model.BUCKETS, 3), 1 / 3))(left, back))
        for step, most in taken.items():
            assert most < 60 * tokens, (step, most / tokens)


def test_language_model_pieces_join(monkeypatch):
    texts = ["a b A c", None, "", "b", "\x0b \n", "word " * 40, "é b a", " ".join(f"x{i % 7}" for i in range(90)), "b"]
    fold, rest = [language_model.FOLD] * len(texts), [language_model.TRAIN, language_model.SCORED, language_model.TRAIN] * 3
    weights = np.random.default_rng(1).dirichlet(np.ones(3), language_model.BUCKETS)

    def run(piece):
        for name in ("PIECE", "SPLIT_BYTES", "ASKED_ROWS"):
            monkeypatch.setattr(language_model, name, piece)
        out = []
        for roles in (fold, rest):
            (rows,) = batches_of(monkeypatch, texts, roles)
            asked = list(language_model._ask(5)([rows]))
            back, left = answered(asked), pa.Table.from_batches([rows])
            out += [rows.to_pylist(), pa.Table.from_batches(asked).to_pylist()]
            out += [language_model._held_out_bins(5, 50)(left, back).to_pylist(), language_model._scores(5, 100, 20, weights)(left, back).to_pylist()]
        return out

    whole = run(1 << 20)
    assert [r["n_tokens"] for r in whole[3]] == [len(words(t)) + 1 for t in texts]
    assert sum(r["n"] for r in whole[2]) == sum(len(words(t)) + 1 for t in texts) and not whole[6]
    assert run(1) == run(3) == run(64) == whole


def test_weights_favour_what_predicts():
    step = language_model.STEPS_PER_OCTAVE
    weights = language_model.learn_weights([(3, -step, -9 * step, 900), (3, language_model.NEVER, -9 * step, 100), (5, language_model.NEVER, language_model.NEVER, 10)], 1000)
    assert 0.8 < weights[3, 0] < 0.95 and weights[5, 2] > 0.99 and np.allclose(weights.sum(axis=1), 1)


def test_language_model_awkward_rows(spark):
    run = lambda rows: language_model.score(frame(spark, rows), F.col("doc_id") > 1, F.col("doc_id") == 4).collect()
    got = run(AWKWARD)
    assert len(got) == len(AWKWARD) and all(math.isfinite(r.score) for r in got)
    assert {r.doc_id: r.n_tokens for r in got}[2] == 1
    assert run([]) == []
    assert all(r.train_tokens == 0 and math.isfinite(r.score) for r in run([(1, "a b", "en", "s")]))


# -- pages


def test_main_text_keeps_the_article():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><div class='ad box'>buy</div><article><h1>Head &amp; line</h1>"
        "<p>One  <b>two</b>\n three.<br>Four<p>5 &lt; 6&nbsp;x</p><aside>no</aside><form>f</form><p>Sh.</p><script>var t='</p>';</script><!-- <p>c</p> -->"
        "<section id=comments><p>reader</p></section></article><footer>&copy; me</footer>"
    )
    assert html_text.main_text(page) == "Head & line\nOne two three.\nFour\n5 < 6 x\nSh."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p>x</p>") == ""
    assert html_text.main_text("<div class=menu><article><p>Kept &am") == "Kept &am"


def test_main_text_without_an_article_surges_and_dives():
    long = "word " * 30
    page = f"<ul><li><a href=x>one</a><li><a href=y>two</a></ul><div>{long}</div><p>short</p><div>{long}</div><ul><li><a>n</a><li><a>m</a><li><a>o</a><li><a>p</a></ul><p>tail"
    assert html_text.main_text(page) == "\n".join([long.strip(), "short", long.strip()])


def test_main_text_of_unmarked_pages():
    short = [f"Line {i} of it." for i in range(40)]
    page = "<div>" + "".join(f"<p>{t}</p>" for t in short) + "</div>"
    assert html_text.main_text(page) == "\n".join(short)  # no three lines reach 86 characters
    prose = [f"Sentence {i} " + "with a good many words in it " * (2 + i % 5) for i in range(12)]
    cards = "".join(f"<div><a href=/{i}>A headline that leads elsewhere {i}</a><p>Some words about it</p><a href=/{i}>Read more</a></div>" for i in range(30))
    page = f"<div>{cards}</div><div>{''.join(f'<p>{t}</p>' for t in prose)}</div><div>{cards}</div>"
    got = html_text.main_text(page).split("\n")
    assert [t for t in got if t != "Some words about it"] == [t.strip() for t in prose]
    assert len(got) <= len(prose) + 2  # of 60 cards only those within a window of the text


def test_main_text_decides_by_blocks_beside_a_marked_article():
    body, long = "word " * 40, "other " * 400
    inside = f"<article><h1>Head</h1><p>{body}</p><p>{body}</p><p>End.</p></article>"
    kept = "\n".join(["Head", body.strip(), body.strip(), "End."])
    far = "<a href=x>leads away from here</a><hr>" * 4
    assert html_text.main_text(f"<p>Printed today</p>{inside}<p>Filed under words</p>") == kept
    # The mark alone does not decide: a text that outweighs the raised lines counts.
    teaser = "<article><p>Short teaser</p></article>"
    assert long.strip() in html_text.main_text(teaser + far + f"<p>{long}</p><p>{long}</p>").split("\n")


def brute_main_text(page):
    found = html_text.lines(page)
    n, w = len(found), [8 * len(x.text) if x.article else len(x.text) - 2 * x.linked for x in found]
    block = []
    for i in range(n):
        sums = [sum(w[j] for j in range(s, s + 3) if 0 <= j < n) for s in (i - 2, i - 1, i)]
        block.append(max(0, *sums, w[i] if found[i].article else 0))
    level = sorted(b for b in block if b)
    if not level:
        return ""
    middle = float(np.median(level))
    surge = max(1, math.sqrt(level[-1] * middle) / 2)
    runs = [list(g) for on, g in itertools.groupby(range(n), lambda i: block[i] > middle / 64) if on]
    runs = [run for run in runs if max(block[i] for i in run) > surge]
    keep, before = set(), None
    for run in runs:
        marked = any(found[i].article for i in run)
        strong = [i for i in run if found[i].article or w[i] * 3 > surge or not marked and found[i].prose]
        keep |= set(range(strong[0], strong[-1] + 1)) if strong else set()
        # Prose without links between two runs outside articles is kept.
        if before and strong and not marked and not before[1]:
            gap = range(before[0] + 1, strong[0])
            keep |= set(gap) if all(found[i].prose and w[i] > 0 for i in gap) else set()
        before = (strong[-1], marked) if strong else before
    keep = {i for i in keep if w[i] > 0}
    whole = {found[i].article for i in keep} - {0}
    return "\n".join(x.text for i, x in enumerate(found) if i in keep or x.article in whole)


def test_main_text_equals_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        parts, marks = [], rng.random() < 0.5
        for _ in range(rng.randint(0, 40)):
            t = "ab " * rng.choice([1, 2, 5, 20, 100, 600])
            t = f"<a href=x>{t}</a>" if rng.random() < 0.3 else t
            parts.append(f"<article><p>{t}</p></article>" if marks and rng.random() < 0.3 else f"<p>{t}</p>")
        page = "".join(parts)
        assert html_text.main_text(page) == brute_main_text(page)


PROSE = "<h1>Title</h1>" + "".join(f"<p>{f'Sentence {i} of it. ' * 20}</p>" for i in range(6))
PLAIN = "\n".join(["Title", *((f"Sentence {i} of it. " * 20).strip() for i in range(6))])


@pytest.mark.parametrize(
    "start",
    ["main class='page no-sidebar'", "article class='post share-enabled'", "div class='layout has-sidebar'", "div class='post category-social'",
     "div id='search-results-page'", "div class=widget", "form id=whole", "body class=comments-open", "article title=don't"],
)
def test_names_of_wrappers_drop_no_article(start):
    assert html_text.main_text(f"<nav>Home</nav><{start}>{PROSE}</{start.split()[0]}><footer>f</footer>") == PLAIN


@pytest.mark.parametrize(
    "other",
    ["<aside class=related><article><p>Teaser</p></article></aside>", "<section class=comments><article><p>" + "reader " * 900 + "</p></article></section>",
     "<div id=comment-list>" + "<p>one reader's words</p>" * 90 + "</div>", "<div class=site-footer>Imprint", "<p hidden>unseen", "<div style='display: none'>unseen</div>",
     "<span class=ad>buy <span>this</span> now</span>", "<div class=comments><p>left open<article>reader</article>"],
)
def test_what_stands_beside_an_article_goes(other):
    assert html_text.main_text(f"<article>{PROSE}</article>{other}") == PLAIN


def test_implied_end_tags():
    assert html_text.main_text(f"<head><title>t</title><p class=notice>We use cookies{PROSE}") == PLAIN
    assert html_text.main_text(f"<ul><li class=ad>Buy<li>{'An entry of words ' * 9}</ul>{PROSE}").split("\n")[0] == ("An entry of words " * 9).strip()
    assert html_text.main_text(f"<a name=top>{PROSE}") == PLAIN  # a place, not a link
    assert len(html_text.main_text(f"<p><a href=x>left open</p>{PROSE}").split("\n")) == 7  # a link left open ends with its block


def test_menu_lines_of_unmarked_pages_go_and_short_paragraphs_stay():
    menu, legal = "<div>Home</div><div>About us</div><div>Contact</div>", "<div>Imprint</div><div>Terms</div>"
    assert html_text.main_text(menu + PROSE + legal) == PLAIN
    short = "<p>Ok.</p><p>So.</p><p>Hm.</p><p>Yes.</p><p>No.</p>"
    assert html_text.main_text(menu + PROSE + short + PROSE + legal) == "\n".join([PLAIN, "Ok.", "So.", "Hm.", "Yes.", "No.", PLAIN])
    assert html_text.main_text(f"<article>{PROSE}{short}{PROSE}</article>") == "\n".join([PLAIN, "Ok.", "So.", "Hm.", "Yes.", "No.", PLAIN])
    assert html_text.main_text("<div class=ad>Buy this now, it is cheap</div>") == ""


@pytest.mark.parametrize("part", ['<a "', '<a b="', "<a b='><p>x", "</script", "<!--", "<div>", "<p><span class=ad>", "<b class=ad></i>", "<"])
@pytest.mark.parametrize("end", ["", ">", '">'])
def test_broken_markup_of_megabytes_is_read_once(part, end):
    started = time.monotonic()
    html_text.main_text(part * (2_000_000 // len(part)) + end)
    assert time.monotonic() - started < 20


def test_pages_awkward_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article>é</article>", "x"), (1, "u", "<article>é</article>", "x"), (None, None, None, None), (2, "u", "<article>" + "<p>w</p>" * 50000, "x")], "page_id bigint, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert sorted(r.n_chars for r in got) == [0, 1, 1, 99999]
    assert html_text.extract(pages.limit(0)).collect() == []


# -- nearest neighbours


def test_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 64)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[50:120] = x[50]  # ties
    x[3] *= 1000
    rows = [(i, x[i].tolist(), "e") for i in range(400)]
    rows += [(500, None, "e"), (520, [0.0] * 8, "e"), (540, [float("nan")] + [1.0] * 7, "e"), (560, [1.0, 2.0], "e"), (561, [3.0, 1.0], "e"), (None, [1.0] * 8, "e"), (580, [None] + [1.0] * 7, "e"), (600, [], "e")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id string")
    got = collections.defaultdict(list)
    for r in nearest.nearest(df, lambda c: c % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    wide = x.astype(np.float64)
    for q in range(0, 400, 20):
        score = wide @ wide[q]
        order = sorted((i for i in range(400) if i != q), key=lambda i: (-np.einsum("i,i->", wide[q], wide[i]), i))[:20]
        assert [g[1] for g in got[q]] == order and [g[0] for g in got[q]] == list(range(1, 21))
        assert np.allclose([g[2] for g in got[q]], score[order], rtol=1e-12)
    assert got[560] == [(1, 561, 5.0)]
    assert set(got) == set(range(0, 400, 20)) | {560}
    assert nearest.nearest(df.limit(0), lambda c: c % 20 == 0).collect() == []


# -- tool calls


def call(key, name, arguments, *depends):
    return {"id": key, "function": {"name": name, "arguments": arguments}, "depends_on": list(depends)}


def test_tool_calls_are_linked_ordered_and_validated(spark):
    schemas = spark.createDataFrame([("f", json.dumps({"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "minimum": 1}}, "additionalProperties": False}))], "name string, schema string")
    rows = [
        (1, 1, "assistant", json.dumps({"tool_calls": [call("b", "f", '{"x": 2, "y": 1}', "a"), call("a", "f", '{ "x" : 1 }'), call("p", "f", '{"x":0}', "q"), call("q", "g", "{", "p")]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "é\n"})), (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": "again"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": "lost"})), (1, 5, "assistant", json.dumps({"tool_calls": [call("c", "f", None, "b", "gone"), call(None, "f", "{}")]})),
        (2, 1, "assistant", "no json"), (2, 2, "user", None), (None, 1, "assistant", json.dumps({"tool_calls": [call("a", "f", "{}")]})),
    ]
    messages = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, level string")
    calls, results = tool_calls.parse_messages(messages)
    got = {r["call"]: r for r in tool_calls.link(calls, results, schemas, Scratch(spark, "calls")).collect()}
    assert set(got) == {"a", "b", "c", "p", "q", "zz"}
    assert [got[k]["level"] for k in "abcpq"] == [0, 1, 2, None, None]
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1]["order_no"])][:3] == ["a", "b", "c"]
    assert got["a"]["canonical"] == '{"arguments":{"x":1},"depends_on":[],"id":"a","name":"f","result":"é\\n"}'
    assert got["a"]["valid"] and got["a"]["n_results"] == 2 and got["a"]["status"] == "linked"
    assert got["b"]["errors"] == "$.y: not allowed" and got["p"]["errors"] == "$.x: range" and got["q"]["errors"] == "$: not JSON"
    assert got["c"]["missing"] == 1 and got["c"]["status"] == "no_result" and got["zz"]["status"] == "no_call" and not got["zz"]["valid"]
    empty = tool_calls.parse_messages(messages.limit(0))
    assert tool_calls.link(*empty, schemas, Scratch(spark, "calls")).collect() == []


def test_texts_above_20_million_characters_are_linked(spark):
    args = F.concat(F.lit('{"tool_calls": [{"id": "a", "function": {"name": "f", "arguments": "'), F.repeat(F.lit("x"), 21_000_000), F.lit('"}}]}'))
    content = F.concat(F.lit('{"tool_call_id": "a", "content": "'), F.repeat(F.lit("y"), 21_000_000), F.lit('"}'))
    base = spark.createDataFrame([("c", 0, "assistant"), ("c", 1, "tool")], "conv_id string, turn bigint, role string")
    calls, results = tool_calls.parse_messages(base.withColumn("text", F.when(F.col("role") == "tool", content).otherwise(args)))
    assert calls.select("call", F.length("arguments")).collect() == [("a", 21_000_000)]
    assert results.select("call", F.length("content")).collect() == [("a", 21_000_000)]


def test_schema_keywords():
    bad = tool_calls.violations
    assert bad(1.0, {"type": "integer"}) == [] and bad(True, {"type": "integer"}) == ["$: not integer"]
    assert bad([1, "a"], {"type": "array", "items": {"type": "string"}, "maxItems": 1}) == ["$: number of items", "$[0]: not string"]
    assert bad("ab", {"enum": ["a"], "pattern": "^b"}) == ["$: not in enum", "$: pattern"]
    assert bad({"a": None}, {"required": ["b"], "properties": {"a": {"type": ["null", "string"]}}}) == ["$.b: missing"]
