"""Streams of landed files and of owners in state, broken feeds, the text index and SQL functions."""

import re
import time

import pytest
from pyspark.sql import functions as F

from offerlake.functions import sql
from offerlake.functions.text import contains_any_case
from offerlake.operators.tables import Store
from offerlake.operators.trigrams import TextIndex
from offerlake.plans.offers import OffersQuery
from offerlake.sources import feeds
from offerlake.sources.landed import Landed, LandedReader
from offerlake.streaming import owners


def run(stream, checkpoint, put):
    stream.writeStream.option("checkpointLocation", str(checkpoint)).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()


def test_landed_files_are_granted(tmp_path):
    """So many a batch, each once, in order; a batch that is planned again has the same files."""
    (tmp_path / "in").mkdir()
    for k in range(5):
        (tmp_path / "in" / f"f{k}.xml").write_text(f"feed {k}")
        time.sleep(0.01)
    (tmp_path / "in" / ".hidden").write_text("x")
    how = {"path": str(tmp_path / "in"), "ledger": str(tmp_path / "ledger"), "max_files": "2", "settle_seconds": "0", "files_per_task": "1"}
    reader = LandedReader(how)
    assert reader.initialOffset() == {"grant": 0}
    offsets = [LandedReader(how).latestOffset() for _ in range(4)]  # each as after a restart
    assert offsets == [{"grant": k} for k in (1, 2, 3, 3)]
    names = lambda a, b: [r.column(0)[0].as_py() for p in reader.partitions({"grant": a}, {"grant": b}) for r in reader.read(p)]
    assert names(0, 1) == names(0, 1) == ["f0.xml", "f1.xml"] and names(1, 3) == ["f2.xml", "f3.xml", "f4.xml"]
    assert LandedReader(how | {"settle_seconds": "60", "ledger": str(tmp_path / "other")}).latestOffset() == {"grant": 0}
    with pytest.raises(ValueError):
        LandedReader(how | {"max_files": "0"})


def test_landed_stream_restarts(spark, tmp_path):
    spark.dataSource.register(Landed)
    (tmp_path / "in").mkdir()
    seen = []

    def put(batch, number):
        seen.append(sorted((r.path, r.content) for r in batch.collect()))

    for wave in range(3):
        for k in range(2):
            (tmp_path / "in" / f"w{wave}-{k}").write_text(f"{wave}{k} é")
        stream = spark.readStream.format("landed").options(path=str(tmp_path / "in"), ledger=str(tmp_path / "ledger"), max_files="5", settle_seconds="0").load()
        run(stream, tmp_path / "checkpoint", put)
    assert sum(seen, []) == [(f"w{w}-{k}", f"{w}{k} é") for w in range(3) for k in range(2)] and len([s for s in seen if s]) == 3


def test_owners_survive_a_restart(spark, tmp_path):
    rows = [(i, f"f{i % 7}" if i % 5 else None) for i in range(60)]
    for part in (rows[30:45], rows[:30], rows[45:]):
        spark.createDataFrame(part, "k int, fingerprint string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k int, fingerprint string").parquet(str(tmp_path / "in"))
        owners.owned(stream, "k").writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
    got = {r.k: r.is_duplicate for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    first = {}
    for part in (rows[30:45], rows[:30], rows[45:]):
        for k, f in sorted(part):
            first.setdefault(f, k)
    assert got == {k: first[f] != k for k, f in rows if f}


def test_broken_feeds(spark, tmp_path):
    item = "<item><title>t{0}</title><link>https://b.test/?p={0}</link></item>"
    (tmp_path / "good.xml").write_text("<rss>" + item.format(1) + item.format(2) + "</rss>")
    (tmp_path / "broken.xml").write_text("<rss>" + item.format(3) + "<item><title>x</titel></item></rss>")
    (tmp_path / "page.html").write_text("<html>503</html>")
    entries, rejected = feeds.read_feeds(spark, str(tmp_path))
    assert sorted(r.title for r in entries.collect()) == ["t1", "t2", "t3"]
    assert sorted((r.feed.rsplit("/", 1)[1], r.error.split(":")[0]) for r in rejected.collect()) == [("broken.xml", "not well-formed"), ("page.html", "no entries")]


def test_text_index(spark, tmp_path):
    texts = [(i, t, f"Title {i}") for i, t in enumerate(["Cheap VPS in Oslo", "ÉTÉ vps%deal", None, "", "ab", "abcabcabc", "xabc", "VPS\ncheap"])]
    rows = spark.createDataFrame(texts, "id long, body string, title string").repartition(2)
    index = TextIndex(Store(spark, str(tmp_path), buckets=8), "posts", "id", ["body", "title"])
    index.build(rows)
    for term in ("vps", "VPS", "cheap vps", "abcabc", "été", "s%d", "ab", "", "nothing", "s\nc", "title 7", "itle"):
        want = rows.where(contains_any_case(F.col("body"), term) | contains_any_case(F.col("title"), term))
        assert sorted(r.id for r in index.search(term).collect()) == sorted(r.id for r in want.collect()), term
    plan = index.search("oslo")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*_bucket", plan)) == 2 and "PushedFilters: [In(gram, [osl,slo])" in plan


def test_page_and_total_in_one_pass(spark, tmp_path):
    posts = spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit("x").alias("raw_text"), (F.col("id") % 4 == 0).alias("is_duplicate"), F.col("id").alias("posted_at"))
    items = posts.select(F.col("id").alias("post_id"), F.lit(1.0).alias("price_monthly"))
    q = OffersQuery(page=3, page_size=10)
    page, total = q.page_and_total(posts, items)
    assert total == q.total(posts, items).first()[0] == 375
    assert [r.id for r in page.collect()] == [r.id for r in q.page_nested(posts, items).collect()]


def test_sql_functions_are_the_columns(spark):
    names = sql.register(spark)
    rows = spark.createDataFrame([("Price: $5,99/mo VPS 2GB RAM", 12.0, "year"), ("", None, None), (None, 1.0, "month"), ("https://www.a.test/discussion/5/x", 0.5, "one_time")], "c string, amount double, period string")
    rows = rows.selectExpr("*", "c AS currency", "CAST(amount AS INT) AS mb", "CAST(-1 AS INT) AS gb")
    rows.createOrReplaceTempView("offerlake_rows")
    calls = []
    for name in names:
        build, parameters, _ = sql.FUNCTIONS[name]
        args = [p.split()[0] for p in parameters.split(", ")]
        calls.append(f"{name}({', '.join(args)}) AS {name}")
        rows = rows.withColumn(name, build(*map(F.col, args)))
    got = spark.sql(f"SELECT {', '.join(calls)} FROM offerlake_rows")
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.select(*names).collect()))
    assert "Python" not in got._jdf.queryExecution().toString()
