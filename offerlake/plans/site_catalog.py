"""Registered queries of the ingestion side: pages of five sites, feeds, lists, cards, ids, dates and the whole ingestion.

Pages, feeds and answers are built from ``part`` by one SQL expression that both engines know, so that the SQL beside a
query says what must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import category as cat
from ..functions import display, places, urls
from ..operators import configurations, fingerprints, tables
from ..operators.shared import fresh_path
from ..operators.tables import Store
from ..sources import feeds, pages
from . import health, ingestion, offers
from .catalog import SITES, TITLES, _case, query, t

NOW = 1714521600  # 2024-05-01 00:00:00 UTC
POSTED = 1712052000  # 2024-04-02 10:00:00 UTC
PRICE = "CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING)"
SIGN = "CASE p_size % 3 WHEN 0 THEN '$' WHEN 1 THEN '€' ELSE '£' END"
PER = "CASE WHEN p_size % 2 = 0 THEN '/mo' ELSE '/yr' END"
SIZES = "concat(p_size, 'GB RAM and ', p_size * 10, 'GB SSD, 2TB bandwidth.')"
ORDER = """concat(' <a href="/about">About</a> <a href="/cart/', p_partkey, '">Order now</a>')"""
TIME = '<time datetime="2024-04-02T10:00:00Z">x</time>'
LABELLED = f"concat('Good hosts\n Price: ', {SIGN}, {PRICE}, {PER}, ' with ', {SIZES})"
OFFERED = f"concat('From ', CASE p_size % 3 WHEN 0 THEN concat('$', {PRICE}) WHEN 1 THEN concat('€', {PRICE}) ELSE concat({PRICE}, ' USD') END, {PER}, ' with ', {SIZES}, ' Location: Berlin.')"

#: site -> (url, html, author, text of the post) as SQL.
PAGES = {
    "forum_a": ("concat('https://a.test/discussion/', p_partkey, '/x')", f"""concat('<h1>', {TITLES}, '</h1>{TIME}<span class="Author"><a href="/u">', p_brand, '</a></span><div class="Message">', {LABELLED}, {ORDER}, '</div>')""", "p_brand", f"concat({LABELLED}, ' About Order now')"),
    "blog": ("concat('https://b.test/x/?p=', p_partkey)", f"""concat('<h1 class="entry-title">', {TITLES}, '</h1>{TIME}<div class="entry-content">', {LABELLED}, {ORDER}, '</div>')""", "NULL", f"concat({LABELLED}, ' About Order now')"),
    "forum_b": ("concat('https://c.test/threads/x.', p_partkey, '/')", f"""concat('<h1 class="p-title-value">', {TITLES}, '</h1>{TIME}<a class="message-name">', p_brand, '</a><div class="message-body"><div class="bbWrapper">', {LABELLED}, {ORDER}, '</div></div>')""", "p_brand", f"concat({LABELLED}, ' About Order now')"),
    "forum_c": ("concat('https://d.test/showthread.php?t=', p_partkey)", f"""concat('<h1 class="thread-title">', {TITLES}, '</h1>{TIME}<span class="username">', p_brand, '</span><div class="postcontent">', {OFFERED}, '</div>')""", "p_brand", OFFERED),
    "listings": ("concat('https://e.test/server/s', p_partkey)", f"""concat('<h1>', {TITLES}, '</h1><div class="provider-name">', p_brand, '</div><div class="description">A box</div><div class="price">', {SIGN}, {PRICE}, {PER}, '</div><table><tr><td>Memory</td><td>', p_size, ' GB</td></tr><tr><td>CPU</td><td> 4 cores </td></tr><tr><td>Disk</td><td>', p_size * 10, ' GB SSD</td></tr></table>')""", "p_brand", "'A box'"),
}
ID = {"listings": "concat('s', p_partkey)"}
CURRENCY = "CASE p_size % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END"
YEARLY = "CASE WHEN d * 100 - floor(d * 100) = 0.5 THEN round_even(a / 12, 2) ELSE CAST(round(d, 2) AS DOUBLE) END"
MONTHLY = f"CASE WHEN p_size % 2 = 0 THEN a ELSE {YEARLY} END"
PARTS = "(SELECT *, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS a, CAST(CAST(p_retailprice AS DECIMAL(12,2)) / 12.0 AS DECIMAL(30, 16)) AS d FROM part)"


def site_pages(spark, d, site: str) -> DataFrame:
    url, html, _, _ = PAGES[site]
    return t(spark, d, "part").select(F.expr(url).alias("url"), F.expr(html).alias("html"))


def now():
    return F.timestamp_seconds(F.lit(NOW))


def _posts(site: str):
    url, _, author, text = PAGES[site]
    on = f"concat({url}, ' ', s)" if site == "forum_c" else "s"
    stamp = NOW if site == "listings" else POSTED
    sql = f"""SELECT {url} AS canonical_url, CAST({ID.get(site, 'p_partkey')} AS STRING) AS source_thread_id, s AS title, {author} AS author, CAST({stamp} AS BIGINT) AS posted, {_case(SITES[site], on)} AS category, trim(replace(replace({text}, chr(10), ' '), '  ', ' ')) AS raw_text
FROM (SELECT *, {TITLES} AS s FROM part)"""

    def run(spark, d):
        spec = pages.registry(site)
        rows = pages.posts(pages.walk(site_pages(spark, d, site), spec, want="post"), spec, now())
        return rows.select("canonical_url", "source_thread_id", "title", "author", F.unix_timestamp("posted_at").alias("posted"), "category", "raw_text")

    run.__name__ = f"site_posts_{site}"
    query(sql)(run)


def _items(site: str):
    url, _, _, _ = PAGES[site]
    if site == "forum_c":
        period = "CASE WHEN p_size % 3 < 2 AND p_size % 2 = 1 THEN 'year' ELSE 'month' END"
        extra, monthly, order, domain, wide = "'Berlin' AS location", "NULL", "NULL", "NULL", "2048"
    else:
        period = "CASE WHEN p_size % 2 = 0 THEN 'month' ELSE 'year' END"
        extra, monthly, wide = "NULL AS location", MONTHLY, "2048"
        order = f"concat(regexp_extract({url}, '^https://[a-z.]+', 0), '/cart/', p_partkey)"
        domain = f"regexp_extract({url}, '^https://([a-z.]+)', 1)"
        if site == "listings":
            order, wide = "NULL", "NULL"
    sql = f"""SELECT {url} AS url, a AS price_amount, {CURRENCY.replace('GBP', 'USD') if site == 'forum_c' else CURRENCY} AS price_currency, {period} AS billing_period, CAST({monthly} AS DOUBLE) AS price_monthly, p_size * 1024 AS ram_mb, p_size * 10 AS storage_gb, CAST({wide} AS INT) AS bandwidth_gb, {extra}, {order} AS order_url, {domain} AS provider_domain, true AS is_primary FROM {PARTS}"""

    def run(spark, d):
        spec = pages.registry(site)
        found = pages.items(pages.walk(site_pages(spark, d, site), spec, want="items"), spec)
        text = lambda c: (F.col(c) if c in found.columns else F.lit(None)).cast("string").alias(c)
        monthly = F.col("price_monthly") if "price_monthly" in found.columns else F.lit(None).cast("double")
        return found.select("url", "price_amount", "price_currency", "billing_period", monthly.alias("price_monthly"), "ram_mb", "storage_gb", "bandwidth_gb", text("location"), text("order_url"), text("provider_domain"), "is_primary")

    run.__name__ = f"site_items_{site}"
    query(sql)(run)


for _site in PAGES:
    _posts(_site)
    _items(_site)


@query(f"""WITH e AS (SELECT p_size, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n, {TITLES} AS s FROM part)
SELECT concat('https://a.test/discussion/', p_partkey) AS url, s AS title, {_case(cat.FORUM_A, 's')} AS category, CAST(p_partkey AS STRING) AS source_thread_id, CAST(CASE WHEN p_partkey % 3 = 0 THEN {NOW} ELSE {POSTED} END AS BIGINT) AS posted, CASE WHEN p_partkey % 2 = 0 THEN 'short' ELSE 'long' END AS summary FROM e WHERE n <= 50""")
def feed_threads(spark, d):
    """A feed for each size, of which the first 50 entries count."""
    rows = t(spark, d, "part").select(
        F.expr(f"concat('  ', {TITLES}, ' ')").alias("title"), F.expr("concat('https://a.test/discussion/', p_partkey)").alias("link"),
        F.expr("CASE WHEN p_partkey % 3 = 0 THEN 'soon' WHEN p_partkey % 3 = 1 THEN 'Tue, 02 Apr 2024 10:00:00 +0000' ELSE 'Tue, 2 Apr 2024 12:00:00 +0200' END").alias("pubDate"),
        F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'short' ELSE '' END").alias("description"), F.lit("long").alias("encoded"), F.col("p_size").alias("feed"), F.col("p_partkey").alias("place"),
    )
    got = feeds.threads(feeds.capped(rows, ["feed"], ["place"], feeds.CAPS["forum_b"]), "forum_a", now(), urls.discussion_id, cat.FORUM_A)
    return got.select("url", "title", "category", "source_thread_id", F.unix_timestamp("posted_at").alias("posted"), "summary")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n FROM part)
SELECT CAST(p_size AS STRING) AS forum, concat('https://d.test/showthread.php?t=', p_partkey) AS url, p_name AS title, CAST(p_partkey AS STRING) AS source_thread_id FROM e WHERE n <= 20""")
def list_threads(spark, d):
    """A list page for each size, of which the first 20 threads count; other links of the page don't."""
    one = F.struct("p_partkey", F.concat(F.lit('<a href="/about">x</a><a class="t" href="showthread.php?t='), F.col("p_partkey"), F.lit('">'), F.col("p_name"), F.lit("</a>")).alias("h"))
    lists = t(spark, d, "part").groupBy("p_size").agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["h"]), "\n").alias("html"))
    lists = lists.select(F.col("p_size").cast("string").alias("forum"), F.lit("vps").alias("category"), F.lit("https://d.test/").alias("url"), "html")
    return feeds.list_threads(lists, now()).select(F.col("source_name").alias("forum"), "url", "title", "source_thread_id")


@query(f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS n FROM part)
SELECT concat('https://e.test/server/s', p_partkey) AS url, CASE WHEN p_partkey % 4 = 0 THEN 'Server Offer' ELSE p_name END AS title, {_case(cat.LISTINGS, "CASE WHEN p_partkey % 4 = 0 THEN 'Server Offer' ELSE p_name END")} AS category, concat('s', p_partkey) AS source_thread_id FROM e WHERE n < 50 AND p_partkey % 5 <> 0""")
def card_threads(spark, d):
    """Cards, 50 of a page at most, of which those without a target go."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("p_size").orderBy("p_partkey")) - 1
    href = F.when(F.col("p_partkey") % 5 == 0, "#").otherwise(F.concat(F.lit("/server/s"), F.col("p_partkey")))
    cards = t(spark, d, "part").select(place.alias("position"), href.alias("href"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).alias("title"), F.lit("https://e.test/list").alias("url"))
    return feeds.card_threads(cards, now()).select("url", "title", "category", "source_thread_id")


URLS = "CASE p_size % 8 WHEN 0 THEN concat('https://x.test/discussion/', p_partkey, '/a') WHEN 1 THEN concat('https://x.test/threads/a-b.', p_partkey, '/') WHEN 2 THEN concat('https://x.test/a/?p=', p_partkey) WHEN 3 THEN concat('https://x.test/t/showthread.php?t=', p_partkey) WHEN 4 THEN concat('https://x.test/server/s', p_partkey, '/b') WHEN 5 THEN concat('https://x.test/o/', p_partkey, '/') WHEN 6 THEN 'https://x.test/plain' ELSE '' END"


@query(rf"""WITH x AS (SELECT p_partkey, p_size % 8 AS k, CAST(p_partkey AS STRING) AS i, {URLS} AS u FROM part)
SELECT p_partkey, CASE WHEN k = 0 THEN i ELSE u END AS discussion, CASE WHEN k = 1 THEN i ELSE u END AS thread, CASE k WHEN 0 THEN 'a' WHEN 1 THEN 'a-b.' || i WHEN 2 THEN i WHEN 3 THEN 'showthread.php' WHEN 4 THEN 'b' WHEN 5 THEN i WHEN 6 THEN 'plain' ELSE u END AS blog,
CASE WHEN k IN (0, 1, 3, 5) THEN i END AS shown, CASE WHEN k = 4 THEN 's' || i WHEN k = 5 THEN i ELSE substring(md5(u), 1, 12) END AS listing, CASE WHEN k = 5 THEN i ELSE substring(md5(u), 1, 12) END AS listing_page FROM x""")
def thread_ids(spark, d):
    u = F.col("u")
    rows = t(spark, d, "part").select("p_partkey", F.expr(URLS).alias("u"))
    return rows.select("p_partkey", urls.discussion_id(u).alias("discussion"), urls.threads_id(u).alias("thread"), urls.blog_id(u).alias("blog"), urls.showthread_id(u).alias("shown"), urls.listing_id(u).alias("listing"), urls.listing_page_id(u).alias("listing_page"))


@query(f"""SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN epoch(o_orderdate) WHEN 1 THEN epoch(o_orderdate) WHEN 2 THEN epoch(o_orderdate) - 7200 ELSE {NOW} END AS BIGINT) AS posted FROM orders""")
def posted_dates(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("o_orderkey") % 5
    s = F.when(k == 0, F.concat(day, F.lit("Z"))).when(k == 1, F.concat(day, F.lit("+00:00"))).when(k == 2, F.concat(day, F.lit("+02:00"))).when(k == 3, "yesterday")
    return t(spark, d, "orders").select("o_orderkey", F.unix_timestamp(places.posted_at(s, now())).alias("posted"))


@query("""SELECT o_orderkey, count(l_orderkey) AS n_items FROM orders o LEFT JOIN lineitem l ON l_orderkey = o_orderkey AND l_linestatus = 'O' WHERE o_orderpriority = '1-URGENT' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O') GROUP BY o_orderkey""")
def offers_by_category_and_period(spark, d):
    from .catalog import C

    q = offers.OffersQuery(category="1-URGENT", billing_period="O", columns=C, sorts={"o_orderdate": "desc"})
    posts, items = t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    nested = offers.with_items(q.matching(posts, items), items.where(q.item_filter()), C)
    return nested.select("o_orderkey", F.size("items").cast("long").alias("n_items"))


@query("SELECT p_partkey, p_brand AS provider_name, CASE WHEN p_size % 2 = 0 THEN concat(p_brand, '.test') END AS provider_domain, CASE WHEN p_size % 3 = 0 THEN 'a, b, c' ELSE '' END AS highlights FROM part")
def shown_posts(spark, d):
    """Metadata lifted, heavy and internal columns gone."""
    meta = F.struct(F.col("p_brand").alias("provider_name"), F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit(".test"))).alias("provider_domain"), F.when(F.col("p_size") % 3 == 0, F.array(*map(F.lit, "abcd"))).alias("highlights"))
    rows = offers.shown(t(spark, d, "part").select("p_partkey", meta.alias("metadata"), F.lit("u").alias("canonical_url"), F.lit("h").alias("raw_html"), F.lit("t").alias("raw_text")))
    return rows.select(*[F.array_join(display.highlights(F.col(c)), ", ").alias(c) if c == "highlights" else c for c in rows.columns])


@query("SELECT count(*) AS discovered, count(*) FILTER (WHERE p_size % 3 <> 0) AS valid, count(*) FILTER (WHERE p_size % 3 = 0) AS rejected, count(*) FILTER (WHERE p_size % 6 = 1) AS ingested FROM part")
def batch_counters(spark, d):
    return health.batch_counters(t(spark, d, "part"), F.col("p_size") % 3 != 0, F.col("p_size") % 6 == 1)


_RULES = "[" + ", ".join(f"[{a}, {b}]" for a, b in map(fingerprints.permutation, range(16))) + "]"


@query(rf"""WITH s AS (SELECT p_partkey, concat(lower(p_brand), '.test ', trim(regexp_replace(regexp_replace(lower(p_name), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ', lower(p_type)) AS x FROM (SELECT *, trim(regexp_replace(regexp_replace(p_type, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS pt FROM part)),
g AS (SELECT p_partkey, list_transform(list_distinct(list_transform(range(1, length(x) - 1), lambda i: substring(x, i, 3))), lambda y: CAST('0x' || substring(md5(y), 1, 8) AS BIGINT)) AS h FROM s)
SELECT p_partkey, sha1(array_to_string(list_transform({_RULES}, lambda r: list_min(list_transform(h, lambda y: (y * CAST(r[1] AS BIGINT) + r[2]) % {fingerprints.PRIME}))), ',')) AS fp FROM g""")
def fuzzy_fingerprint(spark, d):
    fp = fingerprints.fuzzy_fingerprint(F.col("p_name"), F.concat("p_brand", F.lit(".TEST")), F.col("p_type"), 16)
    return t(spark, d, "part").select("p_partkey", fp.alias("fp"))


OLD_DEAL = """concat('{"deals":[{"id":"', p_partkey, '","is_valid":true,', CASE p_size % 3 WHEN 0 THEN '"x":1' WHEN 1 THEN concat('"specs":{"ram_mb":', p_size, '}') ELSE concat('"price_info":[{"amount":', p_size, ',"period":"year"},{"amount":1}],"specs":{"storage_gb":7}') END, '}]}')"""


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN CAST(p_size AS DOUBLE) END AS price_amount, 'USD' AS price_currency, CASE WHEN p_size % 3 = 2 THEN 'year' ELSE 'month' END AS billing_period, CASE WHEN p_size % 3 = 1 THEN p_size END AS ram_mb, CASE WHEN p_size % 3 = 2 THEN 7 END AS storage_gb FROM part WHERE p_size % 3 <> 0""")
def legacy_items(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.expr(OLD_DEAL).alias("envelope"))
    out = configurations.legacy_item(configurations.valid_deals(rows, "envelope"))
    return out.select("p_partkey", "price_amount", "price_currency", "billing_period", "ram_mb", "storage_gb")


@query("SELECT count(*) FILTER (WHERE s_nationkey IN (1, 3, 5, 7)) AS matched, count(*) FILTER (WHERE s_nationkey IN (3, 5, 7)) AS modified FROM supplier")
def modified_count(spark, d):
    rows = t(spark, d, "supplier").select("s_nationkey", (F.col("s_nationkey") == 1).alias("enabled"))
    return tables.modified(rows, F.col("s_nationkey").isin(1, 3, 5, 7), {"enabled": F.lit(True)})


ANSWER = """concat('{"deals":[{"id":"forum_b:', url, '","is_valid":', CASE WHEN k % 4 = 0 THEN 'false' ELSE 'true' END, ',"deal_type":"', CASE WHEN k % 2 = 0 THEN 'cloud' ELSE '' END, '","provider_name":"P","provider_domain":"p.test"', CASE WHEN k % 3 = 0 THEN concat(',"configurations":[{"name":"a","price_amount":', k % 7 + 1, ',"ram_mb":512}]') ELSE '' END, '}]}')"""


@query(f"""WITH p AS (SELECT *, {PAGES['forum_b'][0]} AS url, CASE WHEN p_partkey % 2 = 0 THEN 'cloud' ELSE coalesce(nullif({_case(cat.FORUM_B, TITLES)}, ''), 'x') END AS category FROM {PARTS} WHERE p_partkey % 4 <> 0),
f AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN concat_ws('|', 'p.test', category, CAST(CAST(p_partkey % 7 + 1 AS DECIMAL(12, 2)) AS STRING), 'usd', '', '512', '', '') ELSE concat_ws('|', 'c.test', category, CAST(CAST({MONTHLY} AS DECIMAL(12, 2)) AS STRING), lower({CURRENCY}), '', p_size * 1024, p_size * 10, 2048) END AS fp FROM p)
SELECT url AS canonical_url, category, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 7 + 1 AS DOUBLE) ELSE a END AS price_amount, CASE WHEN p_partkey % 3 = 0 THEN 512 ELSE p_size * 1024 END AS ram_mb, CASE WHEN p_partkey % 3 = 0 THEN 'P' END AS provider_name,
  p_partkey % 2 = 0 AS second_batch, min(p_partkey % 2 = 0) OVER w < (p_partkey % 2 = 0) OR (min(CASE WHEN p_partkey % 2 = 1 THEN url END) OVER w < url AND p_partkey % 2 = 1) OR (min(CASE WHEN p_partkey % 2 = 0 THEN url END) OVER w < url AND p_partkey % 2 = 0) AS is_duplicate FROM f WINDOW w AS (PARTITION BY fp)""")
def ingest_full(spark, d):
    """Two batches of threads with the answers to them, into a store; the second repeats the first's threads too."""
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.expr(PAGES["forum_b"][0]).alias("url"), F.expr(PAGES["forum_b"][1]).alias("html"), F.expr(TITLES).alias("title"))
    threads = rows.select("k", F.lit("forum_b").alias("source_name"), "url", "title", cat.categorize(F.col("title"), cat.FORUM_B).alias("category"), F.lit(None).cast("string").alias("summary"), "html")
    deals = configurations.valid_deals(rows.select(F.expr(ANSWER).alias("envelope")), "envelope").select("deal_id", "deal")
    store = Store(spark, fresh_path(spark, "ingest"), buckets=16)
    ingestion.ingest(store, threads.where("k % 2 = 1").drop("k"), deals, 0, now())
    ingestion.ingest(store, threads.drop("k"), deals, 1, now())
    items = store.rows("items").select(F.col("post_id").alias("id"), "price_amount", "ram_mb", "provider_name")
    posts = store.rows("posts").select("id", "canonical_url", "category", "is_duplicate", (F.regexp_extract("source_thread_id", r"(\d+)", 1).cast("long") % 2 == 0).alias("second_batch"))
    return posts.join(items, "id").select("canonical_url", "category", "price_amount", "ram_mb", "provider_name", "second_batch", "is_duplicate")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 10 < 7 AND o_orderkey % 83 <> 0 AS kept FROM orders)
SELECT k AS o_orderkey, CASE WHEN k % 79 = 0 THEN 'upserted' WHEN k % 89 = 0 THEN 'assigned' WHEN k % 97 = 0 THEN 'touched' ELSE 'kept' END AS state, CAST(k % 79 = 0 AND NOT kept AS INTEGER) AS born FROM o WHERE kept OR k % 79 = 0""")
def changed_buckets(spark, d):
    """A keyed table after a touch, an update, a delete and an upsert, each of which rewrites the buckets of its own keys."""
    key, orders = ["o_orderkey"], t(spark, d, "orders").select("o_orderkey", F.lit("kept").alias("state"), F.lit(0).alias("born"))
    store = Store(spark, fresh_path(spark, "changes"), buckets=16)
    store.create("orders", orders.where("o_orderkey % 10 < 7"), key)
    part = lambda n: orders.select("o_orderkey").where(f"o_orderkey % {n} = 0")
    store.change("orders", key, part(97), lambda rows: tables.touched(rows, part(97), key, F.lit("touched"), "state"))
    hit = F.col("o_orderkey") % 89 == 0
    store.change("orders", key, hit, lambda rows: tables.assigned(rows, hit, {"state": F.lit("assigned")}))
    store.change("orders", key, part(83), lambda rows: tables.without(rows, part(83), "o_orderkey", "o_orderkey"))
    new = part(79).withColumns({"state": F.lit("upserted"), "born": F.lit(1)})
    store.change("orders", key, new, lambda rows: tables.upserted(rows, new, key, ["state"], ["born"]))
    return store.state("orders")


@query("""WITH e AS (SELECT event_id, user_id % 20 AS u, event_id % 3 AS batch FROM events), f AS (SELECT *, min(batch) OVER (PARTITION BY event_id // 2) AS first_batch, min(event_id) OVER (PARTITION BY event_id // 2, batch) AS first_event FROM e)
SELECT event_id // 2 AS key, batch FROM f WHERE batch = first_batch AND event_id = first_event""")
def fresh_keys(spark, d):
    """Three batches of keys, of which a later one holds many of an earlier one: new keys only, checked in the batch's buckets."""
    from ..streaming.ingest import fresh

    rows = t(spark, d, "events").select(F.expr("event_id div 2").alias("key"), (F.col("event_id") % 3).cast("long").alias("batch"))
    store = Store(spark, fresh_path(spark, "keys"), buckets=16)
    for number in range(3):
        store.append("keys", fresh(rows.where(F.col("batch") == number), store, "keys", ["key"], ["batch"], number), number, ["key"])
    return store.rows("keys")


SOURCE = "CASE WHEN p_partkey % 11 = 0 THEN 'blog' WHEN p_partkey % 7 = 0 THEN 'nobody' ELSE 'forum_a' END"
SUMMARY = f"concat('<p>Price: $', {PRICE}, '/mo</p> https://s', p_partkey % 40, '.test/order/1')"
DEAL = f"""concat('{{"deals":[{{"id":"', {SOURCE}, ':', {PAGES['forum_a'][0]}, '","is_valid":', CASE WHEN p_partkey % 4 = 0 THEN 'false' ELSE 'true' END, ',"provider_name":"P', p_partkey % 5, '","highlights":', CASE WHEN p_partkey % 3 = 0 THEN '["x","y"]' ELSE 'null' END, '}}]}}')"""


@query(f"""WITH p AS (SELECT *, {PAGES['forum_a'][0]} AS url, {TITLES} AS title, p_partkey % 10 = 0 AS told FROM {PARTS} WHERE {SOURCE} = 'forum_a' AND p_partkey % 4 <> 0),
i AS (SELECT *, CASE WHEN p_partkey % 5 = 0 AND NOT told THEN 2 ELSE p_partkey % 3 END AS batch, CASE WHEN told THEN 'USD' ELSE {CURRENCY} END AS currency, CASE WHEN told THEN a ELSE {MONTHLY} END AS monthly, CASE WHEN told THEN concat('s', p_partkey % 40, '.test') ELSE 'a.test' END AS domain FROM p),
f AS (SELECT *, concat_ws('|', domain, 'vps', CAST(CAST(monthly AS DECIMAL(12, 2)) AS STRING), lower(currency), '', CASE WHEN told THEN '' ELSE CAST(p_size * 1024 AS STRING) END, CASE WHEN told THEN '' ELSE CAST(p_size * 10 AS STRING) END, CASE WHEN told THEN '' ELSE '2048' END) AS fp FROM i),
g AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY batch, url) AS place FROM f),
m AS (SELECT *, sha1(concat('forum_a', chr(10), url)) AS id, count(*) OVER () AS total FROM g WHERE place = 1 AND currency = 'USD' AND monthly >= 50)
SELECT id, title, 'forum_a' AS source, concat('P', p_partkey % 5) AS provider_name, CASE WHEN p_partkey % 3 = 0 THEN 'x, y' ELSE '' END AS highlights, a AS price, 1 AS n_items, told AS from_summary, total FROM m ORDER BY title, id LIMIT 100""")
def ingest_and_page(spark, d):
    """Three batches of threads into a store, with pages that are missing (some have a summary, others come again later), a source without rules
    and one that is not enabled; then the offers query, by its own default columns, over what was ingested."""
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.expr(SOURCE).alias("source_name"), F.expr(PAGES["forum_a"][0]).alias("url"), F.expr(TITLES).alias("title"), F.lit("vps").alias("category"), F.expr(f"CASE WHEN p_partkey % 10 = 0 THEN {SUMMARY} END").alias("summary"), F.expr(PAGES["forum_a"][1]).alias("html"), F.expr(DEAL).alias("envelope"))
    missing = rows.withColumn("html", F.when(F.col("k") % 5 != 0, F.col("html")))
    deals = configurations.valid_deals(rows.select("envelope"), "envelope").select("deal_id", "deal")
    sources = spark.createDataFrame([("forum_a", True), ("nobody", True), ("blog", False)], "name string, enabled boolean")
    store = Store(spark, fresh_path(spark, "ingest"), buckets=8)
    for number in range(3):
        batch = missing.where(F.col("k") % 3 == number)
        batch = batch.where("k % 5 <> 0 or k % 10 = 0").unionByName(rows.where("k % 5 = 0 and k % 10 <> 0")) if number == 2 else batch
        ingestion.ingest(store, batch, deals, number, now(), sources=sources)
    posts, items = store.rows("posts"), store.rows("items")
    q = offers.OffersQuery(page_size=100, currency="usd", min_price=50, sort="title")
    page = q.page_nested(posts, items, sources).crossJoin(q.total(posts, items))
    return page.select("id", "title", F.col("source.name").alias("source"), "provider_name", F.array_join("highlights", ", ").alias("highlights"), F.get("items", 0)["price_amount"].alias("price"), F.size("items").alias("n_items"), F.get("items", 0)["provider_domain"].startswith("s").alias("from_summary"), "total")


@query("""SELECT n_name AS name, n_nationkey % 3 <> 0 AS enabled, count(*) FILTER (WHERE n_nationkey % 3 <> 0) OVER () AS n_enabled FROM nation""")
def sources_listed(spark, d):
    """Sources as a capped list, and how many of them a run takes."""
    sources = t(spark, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 3 != 0).alias("enabled"))
    n = ingestion.listed_sources(sources, enabled=True).agg(F.count("*").alias("n_enabled"))
    return ingestion.listed_sources(sources).crossJoin(n)


@query("""SELECT 'seeded' AS step, count(*) AS n FROM (SELECT n_name FROM nation WHERE n_nationkey < 9 UNION SELECT unnest(['forum_a', 'blog', 'forum_b', 'forum_c', 'listings']))
UNION ALL SELECT 'again', count(*) FROM (SELECT n_name FROM nation WHERE n_nationkey < 9 UNION SELECT unnest(['forum_a', 'blog', 'forum_b', 'forum_c', 'listings'])) UNION ALL SELECT 'repeated', 0 UNION ALL SELECT 'repeated_regions', count(*) FROM (SELECT n_regionkey FROM nation GROUP BY n_regionkey HAVING count(*) > 1) UNION ALL SELECT 'emptied', 0""")
def seeds_and_keys(spark, d):
    """Default sources are added where they are absent, once; keys that break uniqueness; a table after all its rows went."""
    none = F.lit(None)
    sources = t(spark, d, "nation").where("n_nationkey < 9").select(F.col("n_name").alias("name"), none.cast("string").alias("base_url"), F.lit(True).alias("enabled"), none.cast("timestamp").alias("created_at"), none.cast("timestamp").alias("updated_at"))
    once = tables.seeded(sources, tables.DEFAULT_SOURCES, now())
    steps = {"seeded": once, "again": tables.seeded(once, tables.DEFAULT_SOURCES, now()), "repeated": tables.repeated_keys(once, ["name"]), "repeated_regions": tables.repeated_keys(t(spark, d, "nation"), ["n_regionkey"]), "emptied": tables.emptied(once)}
    out = [rows.agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), "n") for step, rows in steps.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


@query("""SELECT concat('{"total":', count(*) OVER (), ',"page":1,"page_size":100,"pages":', CAST(greatest(ceil(count(*) OVER () / 100.0), 1) AS BIGINT), ',"item":{"id":"', n_nationkey, '","title":"', n_name, '","items":[{"price":', n_regionkey, '}]}}') AS json FROM nation ORDER BY n_name LIMIT 100""")
def json_responses(spark, d):
    """A page as JSON text; ids are strings."""
    n = t(spark, d, "nation")
    posts = n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title"))
    items = n.select(F.col("n_nationkey").cast("string").alias("post_id"), F.col("n_regionkey").alias("price"))
    q = offers.OffersQuery(page_size=100, sort="title", include_duplicates=True)
    page, total = q.page_and_total(posts, items)
    return offers.responses(page, total, 1, 100)
