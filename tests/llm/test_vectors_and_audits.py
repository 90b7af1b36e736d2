"""Nearest neighbours, fill-in-the-middle and the filter audit against plain versions."""

import collections
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlake.llm import fill_in_middle as fim
from offerlake.llm import filter_audit, nearest
from offerlake.llm.queries import QUERIES

from . import brute

rng = np.random.default_rng(3)
CENTRES = rng.normal(size=(5, 24))
VECTORS = [(i, (CENTRES[i % 5] + rng.normal(size=24) * 0.2).astype(np.float32).tolist()) for i in range(400)]
VECTORS += [(400 + i, VECTORS[7][1]) for i in range(150)]  # copies: more than a heap holds
VECTORS += [(600, None), (610, [0.0] * 24), (620, [float("nan")] + [1.0] * 23), (630, [float("inf")] * 24), (640, [None] + [1.0] * 23), (650, []), (None, [1.0] * 24), (660, [2.0] * 3), (661, [1.0, 2.0, 2.5]), (670, [5.0] * 7), (20, VECTORS[7][1]), (680, [float(np.float32(1e-40))] * 24), (690, [float(np.float32(3e38)), float(np.float32(-3e38))] * 12)]


def nearest_plain(rows, k, asks):
    good = [(n, i, np.array(v, float)) for n, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for n, i, v in good:
        if asks(i):
            found = []
            for m, j, w in good:
                if m != n and len(w) == len(v):
                    total = 0.0
                    for x in (v - w).tolist():
                        total += x * x
                    found.append((math.sqrt(total), j))
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"k": 3, "block_bytes": 2000, "query_bytes": 3000, "cell_pairs": 500}, {"k": 700, "block_bytes": 9000}])
def test_nearest(spark, how):
    rows = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("id", "block", "vector", "rank", "score", "group")}).repartition(3)
    got = nearest.nearest(rows, F.col("vec_id") % 10 == 0, **how).collect()
    assert sorted(map(tuple, got)) == nearest_plain(VECTORS, how.get("k", 10), lambda i: i % 10 == 0)


def test_nearest_of_doubles_and_nothing(spark):
    rows = [(i, [float(x) * (1e200 if i == 4 else 1) for x in rng.normal(size=6)]) for i in range(40)]
    frame = spark.createDataFrame(rows, "name int, v array<double>")
    got = nearest.nearest(frame, F.col("name") < 5, k=4, id_col="name", vec_col="v").collect()
    assert sorted(map(tuple, got)) == nearest_plain(rows, 4, lambda i: i < 5)
    assert nearest.nearest(frame.limit(0), F.lit(True), id_col="name", vec_col="v").count() == 0
    assert nearest.nearest(frame.limit(1), F.lit(True), id_col="name", vec_col="v").count() == 0
    with pytest.raises(ValueError):
        nearest.nearest(frame.withColumn("name", F.lit("a")), F.lit(True), id_col="name", vec_col="v")


def test_bounds_hold_and_prune():
    """No distance lies outside its bounds, whatever the scales, and few pairs of many are computed again."""
    x = rng.normal(size=(600, 48)) * np.exp(rng.normal(size=(600, 1)) * 4)
    x[:50] = x[50:100] * (1 + 1e-9)
    b = nearest.Block(1, 48, np.arange(600), x, *nearest.quantised(x))
    low, high = nearest.bounds(b, b)
    true = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert (low <= true).all() and (true <= high).all()
    y = rng.normal(size=(4000, 48))
    c = nearest.Block(2, 48, np.arange(4000), y, *nearest.quantised(y))
    q = c.some(slice(0, 100))
    q.block = 3
    assert nearest.search(q, c, [nearest.Heap(10) for _ in q.ids], 10) < 100 * 4000 / 50


ODD = ["", None, "a", "é😀ñ" * 30, "<P>", "x <S> y", "<M", "a<P" * 9, "<" * 50, ">" * 50, "one\ntwo\r\n three", "S>" * 20, "z" * 300_000, "é" * 40]


def test_fill_in_middle(spark):
    rows = [(i, ODD[i % len(ODD)]) for i in range(280)] + [(3, "again"), (3, "again"), (None, "no id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n", "h", "units", "cut", "end", "form", "output")})
    made = fim.fill_in_middle(frame).withColumn("back", fim.restored(F.col("output"), F.col("form"))).withColumn("text", F.col("back"))
    want = []
    for i, text in rows:
        t = text or ""
        digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
        p, m, s = t[:a], t[a:b], t[b:]
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            want.append((i, len(t), "plain", None, None, t, t))
        else:
            spm = h[3] % 100 < 20
            want.append((i, len(t), "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", t))
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in made.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(frame.limit(0)).count() == 0


def test_fill_in_middle_runs_no_python(spark):
    plan = QUERIES["op12_fill_in_middle"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def audit_plain(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    rows = []
    for i, t, source in docs:
        t = t or ""
        w = brute.WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        rows.append((source or "", {f for f, x in fails.items() if x}, i is not None and i in good, i is not None and i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                c = collections.Counter()
                for p, fails, g, x in rows:
                    if p != part:
                        continue
                    gone, before = f in fails, bool(fails & set(order[: step - 1]))
                    c["kept"] += not before and not gone
                    c["redundant"] += gone and before
                    c["unique"] += fails == {f}
                    if gone and not before:
                        c["removed"] += 1
                        c["good"] += g
                        c["toxic"] += x
                out[part, "".join(order), step] = [c[x] for x in ("kept", "removed", "redundant", "unique", "good", "toxic")]
                shapley[f] += c["removed"]
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return out


def test_filter_audit(spark):
    r = random.Random(4)
    texts = [" ".join("w%d" % r.randrange(n) for _ in range(m)) for n in (20, 5000) for m in (10, 250)] + ["ABC DEF # x", "", None, " \t\n", "X" * 9 + " y" * 300, "a|b", "o " * 50_000]
    docs = [(i, r.choice(texts), r.choice(["s1", "s1", "s2", None, ""])) for i in range(90)] + [(5, texts[0], "s1"), (5, texts[0], "s1"), (None, texts[1], "s2"), (None, "", None)]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 95, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("part", "A", "good", "step", "digest", "words", "fails")}).repartition(3)
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = filter_audit.interactions(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(x.part, x.filter_order, x.step): [x[n] for n in names] for x in got} == audit_plain(docs, labels)
    assert len(got) == 3 * 600
    assert filter_audit.interactions(frame.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_replay_of_other_filters(spark):
    flags = spark.createDataFrame([("p", True, False, True), ("p", None, True, True), ("p", False, False, False)], "part string, X boolean, Y boolean, bad boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.bad_lost, r.shapley) for r in filter_audit.replay(flags, filters="XY", lost={"bad_lost": "bad"}).collect()}
    assert got == {("XY", 1): (2, 1, 1, 2), ("XY", 2): (1, 1, 1, 2), ("YX", 1): (2, 1, 1, 2), ("YX", 2): (1, 1, 1, 2)}
    with pytest.raises(ValueError):
        filter_audit.replay(flags, filters="XX")
