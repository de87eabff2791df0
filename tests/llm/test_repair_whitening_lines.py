"""Structure repair, whitening and line dedup against brute force, and every awkward row."""

import collections
import hashlib
import heapq
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from loomstone.llm import line_dedup, queries, structure_repair as sr, whitening
from loomstone.llm.common import Scratch

# ---- structure repair ------------------------------------------------------------

WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Least (cost, audit) by search over (rows taken, point); rows are (initial, must go, truncated)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, point = heapq.heappop(heap)
        if (at, point) in done:
            continue
        done.add((at, point))
        if at == len(rows) and point in ("", "a"):
            return cost, audit
        for role in "ua":
            if (point, role) in step:
                heapq.heappush(heap, (cost + 2, audit + "I", at, step[point, role]))
        if at < len(rows):
            initial, must_go, open_ = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, point))
            if not must_go:
                if (point, initial) in step:
                    heapq.heappush(heap, (cost + open_, audit + "K", at + 1, step[point, initial]))
                for role in "ua":
                    if (point, role) in step:
                        heapq.heappush(heap, (cost + 2 + open_, audit + "R", at + 1, step[point, role]))
    raise AssertionError


def brute_repair(rows):
    """Rows (conv, turn, role, text) as given to the contract's result, one conversation after another."""
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(name.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        convs[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults, states = set(), collections.Counter(), []
        for _, role, text in turns:
            inner = text.rstrip(WHITE)
            fault = "blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else ""
            faults[fault] += 1
            seen.add((role, text))
            states.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(states, states[1:]))
        cost, audit = cheapest(states) if states else (0, "")
        length, lines, at = len(audit.replace("D", "")), [], 0
        for edit in audit:
            if edit != "I":
                _, role, text = turns[at]
                at += 1
            if edit != "D":
                place = len(lines)
                meant = "system" if length % 2 and not place else ("user", "assistant")[(place - length % 2) % 2]
                lines.append(f"{role}:{text}" if edit == "K" else f"{meant}:" + (text if edit == "R" else ""))
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(spark, rows):
    df = spark.createDataFrame([(*r, "k", 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, key string, part int, digest string")
    out = sr.repair(sr.damage(df), Scratch(spark, "test-repair"), df.selectExpr("conv_id AS conv")).collect()
    assert len(out) == len({r[0] for r in rows})
    return {r.conv: tuple(r)[1:] for r in out}


def test_cells_equal_search_on_random_spans():
    rng = random.Random(3)
    kinds = [(i, g, o) for i in ("s", "u", "a", "t", "") for g in (False, True) for o in (False, True)]
    for _ in range(600):
        rows = [rng.choice(kinds) for _ in range(rng.randint(1, 24))]
        assert sr.best_repair(sr.span_cells(rows)) == cheapest(rows)


def test_every_split_of_a_span_gives_the_same_cells():
    rng = random.Random(4)
    for _ in range(60):
        rows = [(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(2, 12))]
        cells = sr.span_cells(rows)
        for cut in range(1, len(rows)):
            assert sr.join(sr.span_cells(rows[:cut]), sr.span_cells(rows[cut:])) == cells


def test_repair_equals_brute_force_on_random_conversations(spark):
    rng = random.Random(5)
    texts = ["One.", "two", "Three! ", "four?\n", "", " \t", "One.", "…", "a. ", "Wait... what"]
    rows = [
        (conv if conv else None, rng.choice([None, *range(8)]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "User", None]), rng.choice([*texts, None]))
        for conv in range(60)
        for _ in range(rng.randint(1, 9))
    ]
    rows += [(99, None, None, None)] * 4 + [(98, i, "user", "Same text.") for i in range(40)]
    assert repaired(spark, rows) == brute_repair(rows)


def test_long_conversation_is_cut_into_stretches_and_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(sr, "STRETCH", 8)
    monkeypatch.setattr(sr, "FAN_OUT", 3)
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"Text {t}.", f"open {t}", "Again.", ""])) for t in range(700)]
    rows += [(2, 0, "user", "long " * 400_000 + "."), (2, 1, "assistant", "Yes.")] + [(3, 5, "user", "Hot.")] * 300
    assert repaired(spark, rows) == brute_repair(rows)


def test_conversation_without_rows_left_and_empty_table(spark):
    gone = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repaired(spark, []) == {}


def test_op11_query_equals_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_structure_repair(spark, data).collect()}
    assert got == brute_repair([tuple(r) for r in rows])


# ---- whitening ------------------------------------------------------------------


def test_characteristic_polynomial_equals_exact_one(spark):
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 9):
        x = rng.integers(-50, 50, (d + 3, d)).astype(object)
        a = x.T @ x
        poly = whitening.characteristic_polynomial(spark, a)
        c, m = [1], np.zeros((d, d), dtype=object)  # Faddeev-LeVerrier
        for k in range(1, d + 1):
            m = a @ m + c[-1] * np.eye(d, dtype=int).astype(object)
            c.append(-int(np.trace(a @ m)) // k)
        assert poly == c[::-1]


def test_roots_with_multiplicity_and_zero():
    poly = [1]
    roots = [0, 0, 3, 7, 7, 7, 1000]
    for r in roots:
        poly = [(poly[i - 1] if i else 0) - r * (poly[i] if i < len(poly) else 0) for i in range(len(poly) + 1)]
    assert whitening.largest_roots(poly, 8, 2000) == [(1000, 1), (7, 3), (3, 1)]
    assert whitening.largest_roots(poly, 3, 2000) == [(1000, 1), (7, 2)]


def whitened(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, id int, vector string")
    return whitening.whiten(df, **kw).collect()


def check_whitened(rows, out):
    """Rows of one length against numpy in doubles, up to the signs of components and the turn of equal ones."""
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in rows])
    n, d = x.shape
    v = np.cov(x.T, bias=True).reshape(d, d)
    values = np.linalg.eigvalsh(v)[::-1]
    k = sum(e > 1e-9 * values[0] for e in values[:8])
    assert len(out) == n * k
    got = {}
    for r in out:
        got.setdefault(r.vec_id, []).append(r)
        assert r.n == n and r.identity_error < 1e-9
        assert abs(r.explained - values[r.component - 1] / np.trace(v)) <= 1e-9
    order = [key for key, _ in rows]
    y = np.array([[r.whitened for r in sorted(got[key], key=lambda r: r.component)] for key in order])
    assert np.abs(y.T @ y / n - np.eye(k)).max() < 1e-8
    # Each whitened component, correlated with the entries, is an eigenvector.
    loads = (x - x.mean(0)).T @ y / n
    assert np.abs(v @ loads - loads * values[:k]).max() < 1e-7 * values[0] ** 1.5
    for (key, _), row in zip(rows, x):
        s = sum(int(n * a - b) ** 2 for a, b in zip(row, x.sum(0)))
        assert {r.deviation for r in got[key]} == {s}


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(2)
    for d in (1, 3, 12):
        x = rng.normal(size=(60, d)) * np.linspace(1, 3, d)
        check_whitened(rows := [(i, v.tolist()) for i, v in enumerate(x)], whitened(spark, rows))


def test_whitening_of_equal_eigenvalues_and_low_rank(spark):
    corners = [(i, [float(a), float(b), float(c), 5.0]) for i, (a, b, c) in enumerate(itertools.product((0, 1), repeat=3))]
    check_whitened(corners, whitened(spark, corners))
    line = [(i, [float(i), 2.0 * i, -float(i)]) for i in range(9)]
    check_whitened(line, whitened(spark, line))


def test_whitening_of_nearly_equal_eigenvalues_keeps_components_apart(spark):
    # Two variances that differ by two parts in a million.
    rows, at = [], 0
    for axis, size in ((0, 1024 * 1000), (1, 1024 * 1000 + 1), (2, 1024 * 400)):
        for sign in (1, -1):
            rows.append((at, [sign * size / 1024 if i == axis else 0.0 for i in range(3)]))
            at += 1
    out = {(r.vec_id, r.component): r.whitened for r in whitened(spark, rows)}
    assert abs(abs(out[2, 1]) - 3**0.5) < 1e-12 and abs(out[0, 1]) < 1e-9
    assert abs(abs(out[0, 2]) - 3**0.5) < 1e-12 and abs(out[2, 2]) < 1e-9


def test_whitening_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    base = [(i, [float(i % 3), float(i % 5), 1.0 * i]) for i in range(12)]
    odd = [(20, None), (21, []), (22, [1.0, None, 2.0]), (23, [nan, 0.0, 0.0]), (24, [0.0, -inf, 0.0])]
    same = [(3, [3.0 % 3, 3.0 % 5, 3.0])]
    out = whitened(spark, base + odd + same + [(None, [9.0, 9.0, 9.0])])
    assert {r.vec_id for r in out} == {*range(12), None} and {r.n for r in out} == {14}
    assert len([r for r in out if r.vec_id == 3]) == 6
    two = whitened(spark, base + [(i + 50, [float(i * i), 1.0 * (i % 2)]) for i in range(7)])
    check_whitened(base, [r for r in two if r.vec_id < 50])
    assert {r.n for r in two if r.vec_id >= 50} == {7}
    assert whitened(spark, []) == [] and whitened(spark, odd) == [] and whitened(spark, [(1, [1.0, 2.0])]) == []
    huge = whitened(spark, [(i, [1e300 * (i % 2), float(i)]) for i in range(6)])
    assert {r.deviation for r in huge} == {None} and all(int(r.deviation_digits) > 2**63 for r in huge)
    assert len(huge) == 12 and max(r.identity_error for r in huge) < 1e-4


def test_op12_query_equals_numpy(spark, data):
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r.vec_id, [float(v) for v in r.embedding]) for r in df.collect()]
    check_whitened(rows, queries.op12_whitening(spark, data).collect())


# ---- line dedup -------------------------------------------------------------------


def brute_lines(rows, min_chars=20, min_docs=3):
    lower = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    key = lambda line: line.strip(WHITE).translate(lower)
    holds = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= min_chars:
                holds[key(line)].add(doc)
    gone = {k: max(docs) for k, docs in holds.items() if len(docs) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if doc is None or gone.get(key(line), doc) == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def deduped(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], "doc_id bigint, text string, doc string, line int, id string, text_hash int")
    return sorted((tuple(r) for r in line_dedup.drop_repeated_lines(df, Scratch(spark, "test-lines"), **kw).collect()), key=repr)


def test_perfect_hash_is_minimal_and_survives_storage():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 5000):
        first, second = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
        perfect = line_dedup.PerfectHash.load(line_dedup.PerfectHash.build(first, second).dump())
        assert sorted(perfect.number(first, second)) == list(range(n))
        strangers = perfect.number(second, first + np.uint64(1))
        assert ((-1 <= strangers) & (strangers < max(n, 1))).all()


def test_perfect_hash_keeps_keys_whose_mixtures_coincide(monkeypatch):
    monkeypatch.setattr(line_dedup, "_joined", lambda a, b: a >> np.uint64(2))
    first, second = np.arange(16, dtype=np.uint64), np.arange(16, dtype=np.uint64)
    perfect = line_dedup.PerfectHash.load(line_dedup.PerfectHash.build(first, second).dump())
    assert len(perfect.left) and sorted(perfect.number(first, second)) == list(range(16))


def test_lines_equal_brute_force_on_random_documents(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PACK", 8)
    monkeypatch.setattr(line_dedup, "PACKS_PER_COPY", 2)
    monkeypatch.setattr(line_dedup, "LEAST_KEYS", 4)
    rng = random.Random(7)
    pool = [f"The line of number {i} is {'very ' * (i % 4)}long" for i in range(60)] + ["short", "", "é" * 20, "é" * 19, "ÄÖ" * 10 + "AZ", "x" * 19 + " "]
    dress = [lambda s: s, str.upper, lambda s: f" \t{s}\r", lambda s: s + "\x0b"]
    rows = [(i, "\n".join(rng.choice(dress)(rng.choice(pool)) for _ in range(rng.randint(0, 9)))) for i in range(200)]
    assert deduped(spark, rows) == brute_lines(rows)
    assert deduped(spark, rows, min_chars=5, min_docs=2) == brute_lines(rows, 5, 2)


def test_lines_awkward_rows(spark):
    line = "a line that many documents share"
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, f"{line}\n{line}"), (None, None)] + [(i, f"{line}\nown {i}\n{line}") for i in range(4, 9)]
    rows += [(8, f"{line}\nown 8\n{line}"), (8, f"other\n{line.upper()}  "), (-5, line), (9, ("word " * 30 + "\n") * 20_000 + line)]
    assert deduped(spark, rows) == brute_lines(rows)
    two = [(1, f"{line}"), (1, f"{line} "), (2, line)]  # three rows, but two documents
    assert deduped(spark, two) == brute_lines(two)
    assert deduped(spark, []) == []


def test_op13_query_equals_brute_force(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    expected = [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, t, n, k in brute_lines(rows)]
    assert sorted(tuple(r) for r in queries.op13_line_dedup(spark, data).collect()) == sorted(expected)
