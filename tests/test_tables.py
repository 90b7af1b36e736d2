"""Fingerprints, duplicates, JSON offers, table changes and the stream."""

import json

from pyspark.sql import functions as F

from offerlake.operators import configurations as conf
from offerlake.operators import duplicates, fingerprints, tables
from offerlake.operators.tables import Store
from offerlake.plans import health, ingestion, offers
from offerlake.streaming import ingest
from offerlake.streaming.ingest import ingest_batch, ingest_stream, last_seen


def test_strict_fingerprint(spark):
    rows = spark.createDataFrame([("A.b", 5.99, 0), ("a.B", 5.99, None), ("a.b", 7.99, None)], "d string, p double, r int")
    fp = fingerprints.strict_fingerprint(F.col("d"), F.lit("vps"), F.col("p"), F.lit("USD"), F.lit(None).cast("string"), F.col("r"), F.lit(50), F.lit(-1))
    a, b, c = [r[0] for r in rows.select(fp).collect()]
    assert a == b != c and len(a) == 40


def test_fuzzy_fingerprint(spark):
    rows = spark.createDataFrame([("VPS!!", "a.b", "text 😀 one"), ("vps", "A.B", "text one"), ("x", None, None), (None, None, "")], "t string, d string, b string")
    got = [r[0] for r in rows.select(fingerprints.fuzzy_fingerprint(F.col("t"), F.col("d"), F.col("b"), 8)).collect()]
    assert got[0] == got[1] and got[2] is not None and got[3] is not None
    sim = spark.createDataFrame([("abcd", "abcd"), ("abcd", "abxd"), ("abc", "abcd")], "a string, b string")
    assert [r[0] for r in sim.select(fingerprints.digest_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.75, 0.0]


def test_duplicates_follow_the_order(spark):
    rows = spark.createDataFrame([(1, 3, "x"), (2, 1, "x"), (3, 2, "y"), (4, 4, None), (4, 4, "y")], "post_id int, seq int, fingerprint string")
    got = {r.post_id: r.is_duplicate for r in duplicates.duplicate_flags(rows, order=["seq"]).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}
    assert [r.post_id for r in duplicates.seen_before(rows, rows.where("seq = 2")).orderBy("post_id").collect()] == [3, 4]


ENVELOPE = """```json
{"deals":[{"id":"1","is_valid":true,"locations":["Oslo","Rome"],"configurations":["x",{"name":"a","price":2,"currency":null},{"price":"bad","cpu_cores":2}]},{"id":"","is_valid":true},{"id":"2","is_valid":false},{"id":"3","is_valid":true,"specs":{"ram_mb":512},"price_info":[{"amount":3,"period":"year"}]}]}
```"""


def test_configurations(spark):
    rows = spark.createDataFrame([(1, ENVELOPE), (2, "{bad"), (3, None), (4, '{"deals": 5}')], "k int, e string")
    deals = conf.valid_deals(rows, "e")
    assert [(r.k, r.deal_id) for r in deals.orderBy("deal_id").collect()] == [(1, "1"), (1, "3")]
    got = conf.explode_configurations(deals).orderBy("position").collect()
    assert [(r.position, r.plan_name, r.price_amount, r.price_currency, r.billing_period, r.cpu, r.location, r.is_primary) for r in got] == [(1, "a", 2.0, None, "month", None, "Oslo, Rome", False), (2, None, None, "USD", "month", "2 cores", "Oslo, Rome", False)]
    (old,) = conf.legacy_item(deals).collect()
    assert (old.deal_id, old.price_amount, old.price_currency, old.billing_period, old.ram_mb) == ("3", 3.0, "USD", "year", 512)
    one = spark.range(1)
    assert one.select(conf.first_filled(F.array().cast("array<int>"), F.array(F.lit(1)))).first()[0] == [1]
    block = one.select(conf.prompt_block(F.lit(1), F.lit("t"), F.lit("u"), F.lit("s" * 600), F.lit(None))).first()[0]
    assert block == "Thread 1\nTitle: t\nURL: u\nSummary: " + "s" * 500 + "\n---"


def test_table_changes(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, seen int, v string")
    batch = spark.createDataFrame([("b", 9, "n"), ("c", 8, "n"), ("c", 7, "m")], "k string, seen int, v string")
    assert [tuple(r) for r in tables.new_rows(batch, table, ["k"], [F.col("seen")]).collect()] == [("c", 7, "m")]
    assert {tuple(r) for r in tables.touched(table, batch, ["k"], F.lit(5), "seen").collect()} == {("a", 1, "x"), ("b", 5, "y")}
    up = tables.upserted(table, batch.where("v = 'n'"), ["k"], ["seen"], ["v"])
    assert {tuple(r) for r in up.collect()} == {("a", 1, "x"), ("b", 9, "y"), ("c", 8, "n")}
    assert {tuple(r) for r in tables.assigned(table, F.col("k") == "a", {"v": F.lit("z")}).collect()} == {("a", 1, "z"), ("b", 2, "y")}
    assert tables.repeated_keys(batch, ["k"]).count() == 1 and tables.emptied(table).count() == 0
    sources = spark.createDataFrame([], "name string, base_url string, enabled boolean, created_at timestamp, updated_at timestamp")
    once = tables.seeded(sources, tables.DEFAULT_SOURCES, F.current_timestamp())
    assert once.count() == 5 == tables.seeded(once, tables.DEFAULT_SOURCES, F.current_timestamp()).count()


def test_store_and_stream(spark, tmp_path):
    rows = [(i, f"k{i % 40}", f"f{i % 17}") for i in range(100)]
    for part in range(4):
        spark.createDataFrame(rows[part * 25 : part * 25 + 25], "ts int, key string, fingerprint string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.createDataFrame(rows, "ts int, key string, fingerprint string")
    whole = Store(spark, str(tmp_path / "batch"))
    for number in (0, 0, 1):  # again, under its number and under another: nothing new
        ingest_batch(whole, batch, ["key"], number)
    streamed = Store(spark, str(tmp_path / "tables"))
    stream = spark.readStream.schema("ts int, key string, fingerprint string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest_stream(stream, streamed, ["key"], str(tmp_path / "cp")).awaitTermination()
    a, b = ({(r.key, r.last_seen_at) for r in last_seen(s, ["key"]).collect()} for s in (whole, streamed))
    assert a == b and len(a) == 40
    assert whole.rows("posts").where("not is_duplicate").count() == 17 and streamed.rows("posts").count() == 40
    assert whole.rows("posts", 0).count() == 0 and whole.rows("nothing") is None and whole.rows("posts", 1).count() == 40
    snapshots = Store(spark, str(tmp_path / "snapshots"))
    assert not snapshots.exists("t")
    snapshots.save("t", batch)
    snapshots.save("t", batch.limit(1))
    assert snapshots.read("t").count() == 1


def files_of(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_history_is_read_by_bucket(spark, tmp_path):
    """Only the buckets of a batch's keys are read, and the history is joined where it lies: no shuffle of it, however large."""
    store = Store(spark, str(tmp_path), buckets=32)
    history = spark.range(50_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.lit("text").alias("text"))
    store.append("posts", history, 0, ["key"])
    batch = spark.createDataFrame([("k7",), ("k8",), ("new",), ("new",)], "key string")
    known = store.known("posts", batch, ["key"], 1)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in plan and "LeftSemi" in plan and "SortMergeJoin" not in plan
    assert plan.index("Exchange hashpartitioning") < plan.index("LeftSemi")  # what is shuffled are the keys that were found
    assert "_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "ReadSchema: struct<key:string>" in plan
    assert sorted(r.key for r in known.collect()) == ["k7", "k8"]
    files = lambda rows: rows.select(F.input_file_name()).distinct().count()
    assert files(store.rows("posts", 1, store.buckets_of(batch, ["key"]))) <= 3 < files(store.rows("posts")) == 32
    assert [r.key for r in ingest.fresh(batch, store, "posts", ["key"], ["key"], 1).collect()] == ["new"]
    assert sorted(r.key for r in tables.known_keys(batch, store.rows("posts"), ["key"], most=0).collect()) == ["k7", "k8"]  # too many to be broadcast


def test_a_batch_takes_its_own_place(spark, tmp_path):
    """What a run that failed had written under a batch's number goes, in buckets too that the next run has no rows of; other batches stay."""
    store = Store(spark, str(tmp_path), buckets=8)
    rows = spark.range(100).select(F.col("id").alias("k"))
    store.append("t", rows.where("k >= 50"), 0, ["k"])
    store.append("t", rows.where("k < 50"), 1, ["k"])
    store.append("t", rows.where("k in (1, 2)"), 1, ["k"])
    assert sorted(r.k for r in store.rows("t").collect()) == [1, 2, *range(50, 100)] and store.rows("t", 1).count() == 50
    store.append("t", rows.limit(0), 1, ["k"])
    assert store.rows("t").count() == 50
    store.append("nothing", rows.limit(0), 0, ["k"])
    assert store.rows("nothing").collect() == [] and store.known("nothing", rows, ["k"]).collect() == []
    store.append("t", store.rows("t", 1).select((F.col("k") + 100).alias("k")), 1, ["k"])  # rows made from earlier batches of the table itself
    assert store.rows("t").count() == 100


def test_changes_rewrite_the_buckets_they_touch(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=32)
    store.create("t", spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("v")), ["k"])
    before, batch = files_of(tmp_path / "t"), spark.createDataFrame([(3,), (5,)], "k long")
    hit = store.change("t", ["k"], batch, lambda rows: tables.touched(rows, batch, ["k"], F.lit("new"), "v"))
    after = files_of(tmp_path / "t")
    same = {f for f in before if after.get(f) == before[f]}
    assert 1 <= len(hit) <= 2 and len({f.split("/")[0] for f in same}) == 32 - len(hit)
    assert store.state("t").where("v = 'new'").count() == 2 and store.state("t").count() == 1000
    assert store.change("t", ["k"], F.col("k") < 0, tables.emptied) == []
    one = store.buckets_of(batch.where("k = 3"), ["k"])
    store.change("t", ["k"], store.state("t", one), tables.emptied)  # a bucket without rows goes
    assert store.state("t", one).count() == 0 and store.state("t").count() == sum(r["count"] for r in store.state("t").groupBy("k").count().collect()) < 1000
    try:
        store.change("t", ["k"], batch.where("k = 5"), lambda rows: rows.withColumn("k", F.col("k") + 1))
        raise AssertionError("keys of other buckets must be refused")
    except ValueError:
        assert store.state("t").where("k = 5").count() == 1


def thread(source, url, html, **how):
    return (source, url, how.get("title", "T"), how.get("category", "vps"), how.get("summary"), html)


THREADS = "source_name string, url string, title string, category string, summary string, html string"
PAGE = "<h1>VPS</h1><div class='Message'>Price: $3.00/mo 1GB RAM <a href='https://acme.test/order'>o</a></div>"


def answers(spark, threads):
    rows = [(json.dumps({"deals": [{"id": f"{s}:{u}", "is_valid": True, "provider_name": "P", "highlights": ["h"]}]}),) for s, u, *_ in threads]
    return conf.valid_deals(spark.createDataFrame(rows, "e string"), "e").select("deal_id", "deal")


def test_missing_pages(spark, tmp_path):
    """A summary stands in for a missing page; a thread without either is rejected and tried again; errors stop no other."""
    store, at = Store(spark, str(tmp_path), buckets=4), F.lit("2024-05-01 00:00:00").cast("timestamp")
    first = [
        thread("forum_a", "https://f.test/discussion/1/a", PAGE), thread("forum_a", "https://f.test/discussion/2/b", None, title="By feed", summary="<p>Price: $4/mo 2GB RAM</p> https://acme.test/order/1"),
        thread("forum_a", "https://f.test/discussion/3/c", None), thread("forum_b", "https://f.test/threads/x.4/", None, summary="Price: $4/mo"), thread("nobody", "https://n.test/", PAGE), thread("blog", "https://b.test/?p=9", PAGE),
    ]
    sources = spark.createDataFrame([("forum_a", True), ("forum_b", True), ("nobody", True), ("blog", False)], "name string, enabled boolean")
    frame = lambda rows: spark.createDataFrame(rows, THREADS)
    counts = ingestion.ingest(store, frame(first), answers(spark, first), 0, at, sources=sources)
    assert counts == {"discovered": 5, "valid": 5, "rejected": 3, "ingested": 2}
    posts = {r.source_thread_id: r for r in store.rows("posts").collect()}
    assert set(posts) == {"1", "2"} and posts["1"].raw_html == PAGE and posts["2"].raw_html is None
    assert (posts["2"].title, posts["2"].raw_text, posts["2"].author, posts["2"].posted_at) == ("By feed", "Price: $4/mo 2GB RAM https://acme.test/order/1", None, None)
    items = {r.post_id: r for r in store.rows("items").collect()}
    assert (items[posts["2"].id].price_amount, items[posts["2"].id].ram_mb, items[posts["2"].id].provider_domain) == (4.0, 2048, "acme.test")
    assert sorted(r.error for r in store.rows("rejected").collect()) == ["KeyError: 'nobody'", "the page is missing", "the page is missing"]
    again = [first[0], thread("forum_a", "https://f.test/discussion/3/c", PAGE.replace("3.00", "9.00"))]
    assert ingestion.ingest(store, frame(again), answers(spark, again), 1, at) == {"discovered": 2, "valid": 1, "rejected": 0, "ingested": 1}
    assert sorted(r.source_thread_id for r in store.rows("posts").collect()) == ["1", "2", "3"]
    (shown,) = offers.OffersQuery(search="9.00").page_nested(store.rows("posts"), store.rows("items")).collect()
    assert (shown.provider_name, shown.highlights, shown["items"][0].price_amount) == ("P", ["h"], 9.0) and not set(offers.HIDDEN) & set(shown.asDict())
    assert store.rows("posts").schema["llm_metadata"].dataType.simpleString() == "variant"


def test_extractor_before_ingestion(spark, tmp_path):
    store, at = Store(spark, str(tmp_path), buckets=4), F.lit("2024-05-01 00:00:00").cast("timestamp")
    rows = [thread("forum_a", f"https://f.test/discussion/{i}/a", PAGE + "x" * 9000) for i in range(7)]

    def answer(threads):
        if any(t["url"].endswith("/4/a") for t in threads):
            raise TimeoutError("late")
        assert all(len(t["content"]) == 8000 for t in threads)
        return json.dumps({"deals": [{"id": t["id"], "is_valid": not t["url"].endswith("/1/a")} for t in threads]})

    frame = spark.createDataFrame(rows, THREADS)
    assert ingestion.ingest_extracted(store, frame, answer, 0, at, size=3)["ingested"] == 3  # 0, 2 and 6: one is invalid, 3 to 5 wait
    ok = lambda threads: json.dumps({"deals": [{"id": t["id"], "is_valid": True} for t in threads]})
    assert ingestion.ingest_extracted(store, frame, ok, 1, at, size=3) == {"discovered": 7, "valid": 4, "rejected": 0, "ingested": 4}
    assert store.rows("posts").count() == 7


def test_batches_of_rows_with_other_columns(spark):
    rows = spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("k"), F.col("id").alias("x"), F.lit("text").alias("y")).repartition(16)
    got = conf.batch_numbers(rows, ["k"], 30)
    assert got.columns == ["k", "x", "y", "batch", "place"]
    assert got.where("batch * 30 + place <> k").count() == 0 and got.count() == 200_000


def test_extractor_errors_stay_in_their_batch(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "id int, title string")

    def answer(threads):
        if any(t["id"] == 3 for t in threads):
            raise ValueError("no answer")
        return '{"deals":[' + ",".join('{"id":"%d","is_valid":true}' % t["id"] for t in threads) + "]}"

    got = conf.extracted(rows, answer, order=["id"], size=3)
    assert [(r.batch, r.error) for r in got.orderBy("batch").collect()] == [(0, None), (1, "ValueError: no answer"), (2, None)]
    assert sorted(r.deal_id for r in conf.valid_deals(got, "envelope").collect()) == ["0", "1", "2", "6"]


def test_modified_count(spark):
    rows = spark.createDataFrame([("a", True), ("b", False), ("c", False)], "k string, enabled boolean")
    assert tuple(tables.modified(rows, F.col("k").isin("a", "b"), {"enabled": F.lit(True)}).first()) == (2, 1)


def test_signature_is_the_definition(spark):
    import hashlib

    words = ["abc", "bcd", "é"]
    got = spark.range(1).select(fingerprints.minhash(F.array(*map(F.lit, words)), 5), fingerprints.minhash(F.array().cast("array<string>"), 2)).first()
    h = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in words]
    assert got[0] == [min((x * a + b) % fingerprints.PRIME for x in h) for a, b in map(fingerprints.permutation, range(5))] and got[1] == [None, None]


def test_health(spark):
    rows = spark.createDataFrame([("2024-01-01 23:00:00",), ("2023-12-30 00:00:00",)], "s string").select(F.col("s").cast("timestamp").alias("created_at"))
    at = lambda s: F.lit(s).cast("timestamp")
    assert health.freshness(rows, at("2024-01-02 00:00:00")).first()[1:] == (1, "ok")
    assert health.freshness(rows, at("2024-01-03 12:00:00")).first().status == "stale"
    assert health.freshness(rows.limit(0), at("2024-01-03 00:00:00")).first().status == "no_data"


def test_fingerprints_of_few_bytes_are_many_tasks(spark):
    from offerlake.plans import ingestion

    posts = spark.createDataFrame([("forum_a", f"u{i}", "vps", "t", str(i)) for i in range(200)], "source_name string, canonical_url string, category string, title string, raw_text string")
    kinds = "provider_domain string, price_monthly double, price_currency string, location string, ram_mb int, storage_gb int, bandwidth_gb int, position int"
    items = spark.createDataFrame([("forum_a", f"u{i}", "a.test", 1.0, "USD", None, 1, 1, 1, 0) for i in range(200)], f"source_name string, canonical_url string, {kinds}")
    rows = ingestion.fingerprints(posts, items).withColumn("task", F.spark_partition_id()).where("fingerprint_type = 'fuzzy'").collect()
    assert len(rows) == 200 and len({r.task for r in rows}) > 1
