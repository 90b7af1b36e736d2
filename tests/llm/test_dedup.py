"""Near-duplicates, repeated passages, lines and contamination against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from offerlake.llm import decontaminate, line_dedup, near_dedup, substring_dedup
from offerlake.llm.components import components

from . import brute

rng = random.Random(5)
VOCAB = ["w%d" % i for i in range(4000)] + ["Été", "ñu,", "THE", "the"]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def changed(text, share):
    return " ".join(rng.choice(VOCAB) if rng.random() < share else w for w in text.split(" "))


PASSAGE, COMMON = prose(60), prose(40)
BASES = [prose(n) for n in (8, 60, 150, 400)]
TEXTS = [changed(b, s) for b in BASES for s in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.06, 0.1)]
TEXTS += [prose(rng.randrange(30, 200)) + " " + COMMON + " " + prose(50) for _ in range(40)]
TEXTS += [prose(50) + "\n" + PASSAGE + "\t" + prose(20) for _ in range(3)] + [PASSAGE + " " + prose(9) + " " + PASSAGE, "a b", "A  B", "a b c d e", "", None, " \n\t", "x" * 300_000, "o " * 30_000, "o " * 20_000]
ROWS = [(i, t, f"s{i % 7}" if i % 11 else None) for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    # other columns, with names that the operators use themselves
    clash = ["n", "key", "h1", "sketch", "component", "component_id", "kept", "words", "row", "places", "value", "u", "id", "pos", "line"]
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in clash}).repartition(3)


def test_ids_of_other_types(spark):
    rows = [("b", PASSAGE), ("a", PASSAGE), (None, "x"), ("c", None), (None, "c")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("source", F.lit("s"))
    near = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert near == {("b", "a", False), ("a", "a", True), (None, None, True), ("c", "c", True)}
    assert sorted((r.doc_id or "", r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()) == [("", 0), ("", 0), ("a", 60), ("b", 60), ("c", 0)]
    assert line_dedup.remove_boilerplate(docs).count() == 5


def test_hot_keys_are_dealt(spark):
    from offerlake.operators.joins import spread_join

    rows = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)] + [(None, 1)], "k int, x int")
    facts = rows.groupBy("k").agg(F.count("*").alias("size"), F.max("x").alias("top"))
    got = spread_join(rows, facts, ["k"], "size", ["x"], parts=20)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(facts, "k").select("k", "x", "size", "top").collect()))
    dealt = got.withColumn("t", F.spark_partition_id()).where("k = 1").groupBy("t").count().collect()
    assert len(dealt) > 1


def test_components_of_a_large_graph(spark, monkeypatch):
    from offerlake.llm import components as module

    monkeypatch.setattr(module, "ONE_TASK", 10)
    links = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(400, 460)]
    want = brute.components({x for e in links for x in e}, links)
    assert {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()} == want


def test_components(spark):
    for links in ([(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)], [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], [], [(1, 1), (None, 2)]):
        edges = spark.createDataFrame(links, "u long, v long")
        real = [(a, b) for a, b in links if a is not None and a != b]
        want = brute.components({x for e in real for x in e}, real)
        assert {r.node: r.component for r in components(edges).collect()} == want


def test_near_duplicates(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    want = brute.near([(i, t) for i, t, _ in ROWS])
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}
    assert len({c for _, c in want.values()}) < len(want) - 10


def test_near_duplicates_long_lists(docs, monkeypatch, spark):
    """The same with every list a long one and small tiles."""
    monkeypatch.setattr(near_dedup, "SHORT", 1)
    base, other = prose(120), prose(120)
    rows = [(i, changed(base if i % 3 else other, 0.005 * (i % 12))) for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tile=8).collect()}
    assert got == brute.near(rows)


def test_near_duplicates_odd_rows(spark):
    same = prose(40)
    rows = [(3, same), (3, same), (9, same), (None, same), (4, None), (4, ""), (5, "one"), (6, "one")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(3, 36, 3, True), (3, 36, 3, True), (9, 36, 3, False), (None, 36, 3, False), (4, 0, 4, True), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False)], key=str)
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_passages(docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == dict(zip([r[0] for r in ROWS], brute.repeats([r[1] for r in ROWS])))
    assert sum(n for _, n, _ in got.values()) > 500


def test_repeated_passages_odd_rows(spark):
    rows = [(1, PASSAGE), (1, PASSAGE), (None, PASSAGE), (2, None), (2, prose(34))]
    got = sorted((r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (34, 0), (60, 60), (60, 60), (60, 60)]
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_equal_rows(spark):
    """Rows that repeat id and text cost as many places as one of them, whatever their number."""
    other = prose(30) + " " + PASSAGE[: len(PASSAGE) // 2]
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(PASSAGE).alias("text")).unionByName(spark.createDataFrame([(1, other), (2, prose(50))], "doc_id long, text string"))
    got = {(r.doc_id, r.n_words, r.n_removed, r["count"]) for r in substring_dedup.remove_repeats(rows.repartition(6)).groupBy("doc_id", "n_words", "n_removed").count().collect()}
    words = len(other.split())
    shared = brute.repeats([PASSAGE, PASSAGE, other])[2][1]
    assert got == {(None, 60, 60, 100_000), (1, words, shared, 1), (2, 50, 0, 1)}


def test_places_of_equal_rows_are_told_once(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FLUSH", 200)
    text = PASSAGE + " " + prose(300)
    rows = spark.createDataFrame([(7, text)] * 40 + [(8, text)] * 3 + [(9, prose(40) + " " + PASSAGE)], "doc_id long, text string").repartition(5)
    named = rows.select(F.xxhash64("doc_id").alias("key"), F.hash("doc_id").alias("key2"), "text")
    found = substring_dedup._repeated(substring_dedup._hashed(named, lambda h, _: substring_dedup.anchors(h, 35), 4), 4).collect()
    assert len(found) == 3 and all(list(r.places) == sorted(set(r.places)) for r in found)
    want = brute.repeats([r.text for r in rows.collect()])
    assert sorted((r.n_words, r.n_removed, r.text) for r in substring_dedup.remove_repeats(rows).collect()) == sorted(want)


def test_difference_cover():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(substring_dedup.PERIOD))


ITEMS = [(1, prose(30)), (2, "Q: " + " ".join(BASES[1].split(" ")[5:40])), (10, "Été the"), (3, None), (4, "!?"), (2, prose(13)), (11, PASSAGE.upper())]


def contaminated(docs, items, **how):
    got = decontaminate.contamination(docs, items, **how).collect()
    digest = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    return sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, digest(r["items"]), r.contaminated) for r in got), got


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 20])
def test_contamination(spark, docs, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got, rows = contaminated(docs, items, block_words=block)
    assert got == sorted(brute.contaminated([(i, t) for i, t, _ in ROWS], ITEMS))
    text = dict((i, t) for i, t, _ in ROWS)
    hit = next(r for r in rows if r.n_items and r.doc_id < 40)
    first = text[hit.doc_id][hit.spans[0].begins : hit.spans[0].ends]
    assert brute.NORMAL.fullmatch(first.translate(brute.LOWER))
    kept = {r.doc_id for r in decontaminate.decontaminate(docs, items, block_words=block).collect()}
    assert kept == {r[0] for r in got if not r[5]}


def test_contamination_goes_by_row(spark):
    """Whatever the number of blocks: rows of one id, or of none, are judged by their own texts; ids are of any type."""
    item = prose(60)
    rows = [("1", prose(50)), ("1", item), (None, item), (None, "clean"), ("2", item[:200]), ("2", None), ("1", item)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumns({c: F.lit(c) for c in ("row", "ROW_", "_row", "words", "items")})
    items = spark.createDataFrame([("b", item), ("b", item), ("a", " ".join(item.split(" ")[20:33])), (None, "clean"), ("c", "")], "item_id string, text string")
    seen = []
    for block in (1000, 13, 5, 1):
        left = decontaminate.decontaminate(docs, items, block_words=block)
        assert left.columns == docs.columns
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.contamination(docs, items, block_words=block).collect()), key=str)
        seen.append((sorted(((r.doc_id, r.text) for r in left.collect()), key=str), got))
    assert all(s == seen[0] for s in seen)
    assert seen[0][0] == sorted([rows[0], rows[3], rows[5]], key=str)
    assert [g[3] for g in seen[0][1] if g[2] == 60] == [["a", "b"]] * 3


def test_blocks_are_bounded(spark):
    items = spark.createDataFrame([(i, prose(n)) for i, n in enumerate((5, 13, 40, 0, 300, 12))], "item_id long, text string")
    blocks = list(decontaminate.item_blocks(items, "item_id", "text", 50, 13))
    windows = lambda b: [tuple(w[k : k + 13]) for _, w in b for k in range(max(1, len(w) - 12))]
    assert len(blocks) > 5 and all(len(windows(b)) <= 50 for b in blocks)
    whole = list(decontaminate.item_blocks(items, "item_id", "text", 10**6, 13))
    assert len(whole) == 1 and sorted(windows(whole[0])) == sorted(sum(map(windows, blocks), []))


def test_blocks_of_many_words(spark):
    """Windows whose words are all different: a block ends at the alphabet's bound, and results don't change."""
    base = spark.range(90_000).select(F.col("id").alias("item_id"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(12)), lambda k: F.concat(F.lit("w"), (F.col("id") * 13 + k).cast("string"))), " ").alias("text"))
    sizes = [len({w for _, words in b for w in words}) for b in decontaminate.item_blocks(base, "item_id", "text", decontaminate.BLOCK_WORDS, 13)]
    assert len(sizes) == 2 and sizes[0] == 999_999 and sum(sizes) == 1_170_000
    docs = spark.createDataFrame([(1, " ".join("w%d" % i for i in range(13))), (2, "x " + " ".join("W%d" % i for i in range(13 * 89_999, 13 * 90_000))), (3, "w1 w2"), (4, None)], "doc_id long, text string")
    got, _ = contaminated(docs, base)
    assert [(g[0], g[1], g[2], g[3]) for g in got] == [(1, 13, 13, 1), (2, 14, 13, 1), (3, 2, 0, 0), (4, 0, 0, 0)]


def test_letters_are_characters():
    seen = [decontaminate.letter(k) for k in range(decontaminate.BLOCK_NAMES)]
    assert seen[0] == 1 and len(set(seen)) == len(seen) and not any(0xD800 <= c < 0xE000 for c in seen) and seen[-1] < 0x110000


def test_contamination_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    got, _ = contaminated(docs, none)
    assert not any(r[2] for r in got) and len(got) == len(ROWS)
    assert decontaminate.contamination(docs.limit(0), none).count() == 0


SHARED = ["Cookie notice", "  Cookie notice\t", "About us", "", "x"]
PAGES = [(i, "\n".join([prose(5), SHARED[i % 2], prose(4), SHARED[2] if i % 3 == 0 else "own %d" % i, "", SHARED[4]]), f"s{i % 9}" if i % 10 else None) for i in range(60)] + [(100, None, "s1"), (101, "", "s1"), (102, "Cookie notice\nCookie notice", "s2"), (103, " \n\n", None), (104, "y" * 200_000 + "\nAbout us", "s3")]


@pytest.mark.parametrize("sites", [3, 8, 9, 20])
def test_lines(spark, sites):
    rows = spark.createDataFrame(PAGES, SCHEMA).withColumns({c: F.lit(1) for c in ("n_lines", "key", "pos", "line", "h1", "first", "_cut", "_key", "_id", "cut", "id", "own", "own_key", "doc", "_salt")})
    got = line_dedup.remove_boilerplate(rows, sites=sites).collect()
    assert {r.doc_id: r.text for r in got} == brute.lines(PAGES, sites)
    assert all(r.n_removed == (0 if r.text is None else dict((i, t) for i, t, _ in PAGES)[r.doc_id].count("\n") - r.text.count("\n")) or r.text == "" for r in got)


def test_lines_odd_rows(spark):
    rows = spark.createDataFrame([(1, "a\nb", f"s{i}") for i in range(5)] + [(None, "a", "s9")], SCHEMA)
    got = sorted((r.text, r.n_removed) for r in line_dedup.remove_boilerplate(rows, sites=5).collect())
    assert len(got) == 6
    assert line_dedup.remove_boilerplate(rows.limit(0), sites=5).count() == 0


def test_values_of_one_text_leave_no_join(spark, monkeypatch):
    plans, stash = {}, near_dedup.stash

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return stash(df, name)

    monkeypatch.setattr(near_dedup, "stash", seen)
    sketches = [(i, 4, [0, 1 + i // 2, 1001 + i // 2, 2000 + i]) for i in range(300)] + [(i, 1, [0]) for i in range(300, 310)]
    lists = near_dedup.inverted_lists(spark.createDataFrame(sketches, "doc_id long, n long, sketch array<long>"))
    assert {(r.value, r.doc_id, r.lone) for r in lists.collect()} == {(1 + i // 2, i, 1) for i in range(300)} | {(0, i, 0) for i in range(300, 310)}
    assert "LeftOuter" not in plans["near-lists"] and "broadcast" in plans["near-lists"]
