"""Every registered query that has SQL, against DuckDB; and properties of the offers query."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from offerlake.plans import catalog
from offerlake.plans.offers import Columns, OffersQuery

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def plain(frame, cols):
    out = frame[cols].copy()
    for c in cols:
        out[c] = out[c].map(lambda v: "" if v is None or v != v else f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v))
    return sorted(map(tuple, out.to_numpy().tolist()))


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, D).toPandas(), duck.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert plain(got, cols) == plain(want, cols)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


POSTS = [(str(i), f"t{i % 4}", "vps" if i % 2 else "cloud", i % 5 == 0, "Find ME" if i % 3 == 0 else None) for i in range(23)]


@pytest.fixture(scope="module")
def posts(spark):
    return spark.createDataFrame(POSTS, "id string, title string, category string, is_duplicate boolean, raw_text string").withColumn("posted_at", catalog.F.col("id").cast("int"))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(str(i), float(i), "EUR") for i in range(0, 23, 2)] + [("1", None, "USD")], "post_id string, price_monthly double, price_currency string")


def test_pages_join_up_to_the_whole_order(posts, items):
    whole = [r.id for r in OffersQuery(page_size=100, sort="title").page_posts(posts, items).collect()]
    pages = [r.id for p in range(1, 6) for r in OffersQuery(page=p, page_size=5, sort="title").page_posts(posts, items).collect()]
    assert pages == whole and len(whole) == 18
    assert {OffersQuery(page=p, page_size=5).total(posts, items).first()[0] for p in (1, 2)} == {18}


def test_zero_is_a_bound_and_null_prices_never_match(posts, items):
    got = OffersQuery(min_price=0, include_duplicates=True, page_size=100).page_nested(posts, items).collect()
    assert {r.id for r in got} == {str(i) for i in range(0, 23, 2)}
    assert OffersQuery(currency="usd", include_duplicates=True).total(posts, items).first()[0] == 1


def test_search_folds_case_and_takes_signs_literally(posts, items):
    assert OffersQuery(search="find me", include_duplicates=True).total(posts, items).first()[0] == 8
    assert OffersQuery(search="find.me", include_duplicates=True).total(posts, items).first()[0] == 0


def test_unmatched_posts_have_an_empty_array(posts, items):
    got = {r.id: r["items"] for r in OffersQuery(include_duplicates=True, page_size=100).page_nested(posts, items).collect()}
    assert got["3"] == [] and len(got["4"]) == 1


def test_bad_parameters():
    for bad in ({"page": 0}, {"page_size": 101}, {"page_size": 0}, {"min_price": -1}):
        with pytest.raises(ValueError):
            OffersQuery(**bad)
    assert OffersQuery(sort="nope").sort == "posted_at"


def test_filters_reach_the_scan(spark):
    q = OffersQuery(source="O", columns=catalog.C, sorts=catalog.BY_DATE)
    plan = q.page_posts(spark.read.parquet(f"{D}/orders.parquet"), spark.read.parquet(f"{D}/lineitem.parquet"))._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,O)" in plan and "TakeOrderedAndProject" in plan


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert Columns().post_id == "id"


def exactly(spark, name, path, table, rows, schema):
    """The query's rows over one small table beside those of its SQL; null and '' differ."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{table}.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(path))
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.SQL[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


def test_late_events_of_keys_that_no_earlier_batch_has(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    rows = [(i, None if i % 10 == 4 else at(i / 8), i, "view") for i in range(80)] + [(104, at(9), 1, "view"), (108, at(3), 2, "click"), (112, at(9), 2, "click")]
    got, want = exactly(spark, "late_events", tmp_path, "events", rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    assert got == want and 0 < sum(not r[2] for r in want) < 20


def test_minhash_signatures_of_odd_texts(spark, tmp_path):
    texts = [None, "", "a", "ab", "abc", "  ", "aaaa", "\u039f\u0394\u039f\u03a3", "\u0130stanbul", "x" * 300, "a\x00bc", "\U0001f600\U0001f600\U0001f600"]
    got, want = exactly(spark, "minhash_signature", tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    assert got == want and sum(r[1] is None for r in want) == 5


def test_minhash_signatures_go_by_whole_texts(spark, tmp_path):
    head = "".join(chr(97 + i * i % 23) for i in range(200))
    texts = [head, head + "qqq", head + "\U0001f600\u039f\u0394\u039f\u03a3 " * 90, "\u00e9" * 199 + "abcdefgh", "\u00e9" * 199, head * 40 + "zyx", *(f"{head}{i}" for i in range(30))]
    got, want = exactly(spark, "minhash_signature", tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    assert got == want and len({r[1] for r in got}) > 5


def test_minhash_of_texts_is_that_of_their_shingles(spark):
    from offerlake.operators import fingerprints

    words = ["", "ab", "abc", "\U0001f600b\u00e9\x00", *(f"text {i * i} of {i} words \u4e2d\u6587" * (i % 5) for i in range(60))]
    texts = spark.createDataFrame(list(enumerate([*words, None])), "i long, t string").coalesce(1)
    rows = texts.select("t", fingerprints.text_minhash(F.col("t"), 5, at_once=50).alias("got"), fingerprints.minhash(fingerprints.shingles(F.col("t")), 5).alias("want")).collect()
    assert all(r.got == (r.want if len(r.t or "") > 2 else None) for r in rows) and len(rows) == 65
    assert list(fingerprints._least([fingerprints._runs(w) for w in words], 5)) == [x for w in words for x in fingerprints._least([fingerprints._runs(w)], 5)]
