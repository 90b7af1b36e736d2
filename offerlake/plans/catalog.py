"""The registered queries over the driver tables, each with its SQL.

Posts are ``orders``, items ``lineitem``, sources nations; texts are ``documents``, ``pages`` and texts built from
``part``. Results are flat scalar columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import category as cat
from ..functions import display, money, places, specs, urls
from ..functions.text import clean_text, contains_any_case, fingerprint_text, lower_each
from ..operators import configurations, duplicates, fingerprints, tables
from ..sources import feeds
from . import health, offers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SPACES = r"[\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


C = offers.Columns(post_id="o_orderkey", item_post="l_orderkey", duplicate=None, category="o_orderpriority", source="o_orderstatus", source_name="n_name", text=["o_orderpriority"], price="l_extendedprice", currency="l_returnflag", period="l_linestatus", location="l_linestatus")
BY_DATE = {"o_orderdate": "desc"}


def _flagship(**how) -> offers.OffersQuery:
    return offers.OffersQuery(source="O", min_price=1000, max_price=5000, columns=C, sorts=BY_DATE, **how)


MATCH = "FROM orders o WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_extendedprice BETWEEN 1000 AND 5000)"


@query(f"""SELECT p.o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS posted, o_orderpriority AS category, count(*) AS n_items, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price
FROM (SELECT o.* {MATCH} ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20) p JOIN lineitem l ON l.l_orderkey = p.o_orderkey AND l_extendedprice BETWEEN 1000 AND 5000 GROUP BY ALL""")
def offers_page(spark, d):
    page = _flagship(page=2).page_nested(t(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus"), t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"))
    price = F.transform("items", lambda x: x["l_extendedprice"])
    return page.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("posted"), F.col("o_orderpriority").alias("category"), F.size("items").cast("long").alias("n_items"), F.array_min(price).alias("min_price"), F.array_max(price).alias("max_price"))


@query(f"SELECT count(*) AS total {MATCH}")
def offers_total(spark, d):
    return _flagship().total(t(spark, d, "orders"), t(spark, d, "lineitem"))


@query(f"SELECT total, 1 AS page, 50 AS page_size, CAST(greatest(ceil(total / 50.0), 1) AS BIGINT) AS pages FROM (SELECT count(*) AS total {MATCH})")
def page_envelope(spark, d):
    total = _flagship().total(t(spark, d, "orders"), t(spark, d, "lineitem"))
    return total.select("total", F.lit(1).alias("page"), F.lit(50).alias("page_size"), offers.pages_of(F.col("total"), 50).alias("pages"))


@query("SELECT o_orderkey, count(l_orderkey) AS n_items, coalesce(min(l_extendedprice), 0) AS min_price FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def offers_unfiltered_nested(spark, d):
    nested = offers.with_items(t(spark, d, "orders").select("o_orderkey"), t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), C)
    return nested.select("o_orderkey", F.size("items").cast("long").alias("n_items"), F.coalesce(F.array_min(F.transform("items", lambda x: x["l_extendedprice"])), F.lit(0.0)).alias("min_price"))


def _posts(spark, d) -> DataFrame:
    """Orders with their customer's nation as the source's name."""
    names = t(spark, d, "customer").select("c_custkey", "c_nationkey").join(t(spark, d, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")
    return t(spark, d, "orders").join(names, F.col("o_custkey") == F.col("c_custkey"), "left")


@query("SELECT o_orderkey, n_name AS source_name, n_regionkey AS region FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def offers_with_source(spark, d):
    joined = offers.with_source(_posts(spark, d).select("o_orderkey", "n_name"), t(spark, d, "nation"), C, key="n_name")
    return joined.select("o_orderkey", F.col("source.n_name").alias("source_name"), F.col("source.n_regionkey").alias("region"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS category FROM orders o WHERE o_orderstatus <> 'P' AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def unique_in_currency(spark, d):
    """Without duplicates, as is the default; a currency in lower case."""
    q = offers.OffersQuery(currency="r", columns=replace(C, duplicate="dup"), sorts=BY_DATE)
    posts = t(spark, d, "orders").withColumn("dup", F.col("o_orderstatus") == "P")
    return q.matching(posts, t(spark, d, "lineitem")).select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("category"))


@query("SELECT doc_id, source FROM documents WHERE contains(lower(text), lower('Thing')) OR contains(lower(source), lower('Thing'))")
def search_text(spark, d):
    q = offers.OffersQuery(search="Thing", columns=offers.Columns(post_id="doc_id", duplicate=None, text=["text", "source"]))
    return t(spark, d, "documents").where(q.post_filter()).select("doc_id", "source")


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(n_name), lower('N_1'))")
def location_filter(spark, d):
    nations = t(spark, d, "nation").where(contains_any_case(F.col("n_name"), "N_1")).select("n_nationkey", "n_name")
    return t(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_name END AS title, row_number() OVER (ORDER BY title ASC NULLS FIRST, p_partkey) AS place FROM part ORDER BY title NULLS FIRST, p_partkey LIMIT 100 OFFSET 50")
def sort_title_nulls(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_name")).alias("title"))
    q = offers.OffersQuery(page=1, page_size=100, sort="title", include_duplicates=True, columns=offers.Columns(post_id="p_partkey"), sorts={"title": "asc"})
    page = rows.orderBy(*q.order()).offset(50).limit(100)
    return page.withColumn("place", F.row_number().over(Window.orderBy(*q.order())) + 50)  # a page of 100 rows


@query("SELECT DISTINCT o_orderpriority AS value FROM orders WHERE o_orderpriority <> ''")
def distinct_categories(spark, d):
    return offers.distinct_values(t(spark, d, "orders"), "o_orderpriority").withColumnRenamed("o_orderpriority", "value")


@query("SELECT DISTINCT l_returnflag AS value FROM lineitem WHERE l_returnflag <> ''")
def distinct_currencies(spark, d):
    return offers.distinct_values(t(spark, d, "lineitem"), "l_returnflag").withColumnRenamed("l_returnflag", "value")


@query("""WITH p AS (SELECT o_orderstatus = 'F' AS dup, o_orderpriority AS category, n_name AS source FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)
SELECT 'total_deals' AS metric, NULL AS key, count(*) AS n FROM p UNION ALL SELECT 'total_active', NULL, count(*) FROM p WHERE NOT dup
UNION ALL SELECT 'by_category', category, count(*) FROM p WHERE NOT dup AND category <> '' GROUP BY category UNION ALL SELECT 'by_source', source, count(*) FROM p WHERE NOT dup AND source <> '' GROUP BY source""")
def stats_long(spark, d):
    posts = _posts(spark, d).withColumn("dup", F.col("o_orderstatus") == "F")
    return offers.stats(posts, offers.Columns(duplicate="dup", category="o_orderpriority", source_name="n_name"))


@query("SELECT source AS key, count(*) AS n FROM documents GROUP BY source")
def count_by_source(spark, d):
    return offers.counts_by(t(spark, d, "documents"), "source", keep_empty=True).orderBy(F.col("n").desc(), "key")


@query("""SELECT o_orderkey, o_orderpriority AS category, n_name AS source_name, count(l_orderkey) AS n_items, coalesce(sum(l_quantity), 0) AS quantity FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = 7 GROUP BY ALL""")
def detail_by_id(spark, d):
    items = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    one = offers.detail(_posts(spark, d), items, t(spark, d, "nation").select(F.col("n_name").alias("name")), 7, C)
    quantity = F.aggregate("items", F.lit(0.0), lambda s, x: s + x["l_quantity"])
    return one.select("o_orderkey", F.col("o_orderpriority").alias("category"), F.col("source.name").alias("source_name"), F.size("items").cast("long").alias("n_items"), quantity.alias("quantity"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_retailprice WHEN 1 THEN CASE WHEN d * 100 - floor(d * 100) = 0.5 THEN round_even(p_retailprice / 12, 2) ELSE CAST(round(d, 2) AS DOUBLE) END END AS monthly FROM (SELECT *, CAST(p_retailprice / 12 AS DECIMAL(30, 16)) AS d FROM part)""")
def monthly_price(spark, d):
    period = F.when(F.col("p_size") % 4 == 0, "month").when(F.col("p_size") % 4 == 1, "year").when(F.col("p_size") % 4 == 2, "one_time")
    return t(spark, d, "part").select("p_partkey", money.monthly_price(F.col("p_retailprice"), period).alias("monthly"))


def _price_text(p: Column, size: Column) -> Column:
    amount = p.cast("decimal(12,2)").cast("string")
    return F.when(size % 6 == 0, F.concat(F.lit("Price: $"), amount, F.lit("/mo"))).when(size % 6 == 1, F.concat(amount, F.lit(" eur per year"))).when(size % 6 == 2, F.concat(F.lit("Free lifetime £"), amount)).when(size % 6 == 3, F.concat(F.lit("1,"), amount, F.lit(" CAD once"))).when(size % 6 == 4, "no price at all").otherwise("")


PRICE_TEXT = "CASE p_size % 6 WHEN 0 THEN 'Price: $' || a || '/mo' WHEN 1 THEN a || ' eur per year' WHEN 2 THEN 'Free lifetime £' || a WHEN 3 THEN '1,' || a || ' CAD once' WHEN 4 THEN 'no price at all' ELSE '' END"


@query(rf"""WITH x AS (SELECT p_partkey, {PRICE_TEXT} AS s FROM (SELECT *, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS a FROM part))
SELECT p_partkey, CASE WHEN s = '' THEN NULL WHEN regexp_matches(s, '(?i)\bfree\b') THEN 0.0 ELSE try_cast(regexp_extract(replace(s, ',', ''), '(\d+(?:\.\d+)?)', 1) AS DOUBLE) END AS price,
CASE WHEN s = '' THEN NULL WHEN contains(s, '$') THEN 'USD' WHEN contains(s, '€') THEN 'EUR' WHEN contains(s, '£') THEN 'GBP' WHEN regexp_extract(s, '(?i)\b({money.CODES})\b', 1) <> '' THEN upper(regexp_extract(s, '(?i)\b({money.CODES})\b', 1)) ELSE 'USD' END AS currency,
CASE WHEN s = '' THEN NULL WHEN regexp_matches(lower(s), '{money.MONTH}') THEN 'month' WHEN regexp_matches(lower(s), '{money.YEAR}') THEN 'year' WHEN regexp_matches(lower(s), '{money.ONCE}') THEN 'one_time' ELSE 'month' END AS period FROM x""")
def extract_price_currency_period(spark, d):
    s = _price_text(F.col("p_retailprice"), F.col("p_size"))
    return t(spark, d, "part").select("p_partkey", money.price(s).alias("price"), money.currency(s).alias("currency"), money.billing_period(s).alias("period"))


SPEC_TEXT = "CASE p_size % 5 WHEN 0 THEN p_size || 'GB RAM, ' || p_size * 10 || 'GB SSD, 2TB bandwidth' WHEN 1 THEN '512MB memory disk: 1.5 TB unlimited' WHEN 2 THEN p_size || ' gb nvme and traffic - ' || p_size || 'TB' WHEN 3 THEN p_name ELSE '768 MB' END"


@query(rf"""WITH x AS (SELECT p_partkey, {SPEC_TEXT} AS s FROM part), y AS (SELECT *, '(?i)(\d+(?:\.\d+)?)\s*(TB|GB)\s*{specs.STORAGE}\b' AS s1, '(?i){specs.STORAGE}\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*(TB|GB)\b' AS s2,
'(?i)(\d+(?:\.\d+)?)\s*(TB|GB)\s*{specs.TRAFFIC}\b' AS b1, '(?i){specs.TRAFFIC}\s*[:\-]?\s*(\d+(?:\.\d+)?)\s*(TB|GB)\b' AS b2 FROM x),
z AS (SELECT p_partkey, s, regexp_extract(s, '(?i)(\d+(?:\.\d+)?)\s*GB', 1) AS gb, regexp_extract(s, '(?i)(\d+)\s*MB', 1) AS mb,
CASE WHEN regexp_matches(s, s1) THEN regexp_extract(s, s1, 1) WHEN regexp_matches(s, s2) THEN regexp_extract(s, s2, 1) END AS sn, CASE WHEN regexp_matches(s, s1) THEN regexp_extract(s, s1, 2) ELSE regexp_extract(s, s2, 2) END AS su,
CASE WHEN regexp_matches(s, b1) THEN regexp_extract(s, b1, 1) WHEN regexp_matches(s, b2) THEN regexp_extract(s, b2, 1) END AS bn, CASE WHEN regexp_matches(s, b1) THEN regexp_extract(s, b1, 2) ELSE regexp_extract(s, b2, 2) END AS bu FROM y)
SELECT p_partkey, CASE WHEN gb <> '' THEN CAST(trunc(CAST(gb AS DOUBLE) * 1024) AS INT) WHEN mb <> '' THEN CAST(mb AS INT) END AS ram_mb, CAST(trunc(CAST(sn AS DOUBLE) * CASE WHEN upper(su) = 'TB' THEN 1024 ELSE 1 END) AS INT) AS storage_gb,
CASE WHEN regexp_matches(s, '(?i)\bunlimited\b') THEN -1 ELSE CAST(trunc(CAST(bn AS DOUBLE) * CASE WHEN upper(bu) = 'TB' THEN 1024 ELSE 1 END) AS INT) END AS bandwidth_gb FROM z""")
def extract_specs(spark, d):
    size = F.col("p_size")
    n, m = size.cast("string"), (size * 10).cast("string")
    s = F.when(size % 5 == 0, F.concat(n, F.lit("GB RAM, "), m, F.lit("GB SSD, 2TB bandwidth"))).when(size % 5 == 1, "512MB memory disk: 1.5 TB unlimited").when(size % 5 == 2, F.concat(n, F.lit(" gb nvme and traffic - "), n, F.lit("TB"))).when(size % 5 == 3, F.col("p_name")).otherwise("768 MB")
    return t(spark, d, "part").select("p_partkey", specs.ram_mb(s).alias("ram_mb"), specs.storage_gb(s).alias("storage_gb"), specs.bandwidth_gb(s).alias("bandwidth_gb"))


SIZED_TEXT = "CASE p_size % 6 WHEN 0 THEN p_size || ' GB, 3 TB monthly data allowance and more' WHEN 1 THEN p_size || ' GB for what you keep, and much further on in this text also 1.5TB' WHEN 2 THEN p_size || ' GB RAM here, then after a good many words of filler ' || p_size * 10 || 'gb in total' WHEN 3 THEN 'Volume ' || p_size || '.5 TB, and a longer stretch of words before memory ' || p_size || ' GB' WHEN 4 THEN p_size || 'GB next to a disk; ' || p_size || '0 GB next to that' ELSE p_name END"


@query(rf"""WITH x AS (SELECT p_partkey, {SIZED_TEXT} AS s, '(?i)\d+(?:\.\d+)?\s*(?:TB|GB)\b' AS size FROM part),
y AS (SELECT p_partkey, s, regexp_extract_all(s, size) AS hits, string_split_regex(s, size) AS pieces FROM x), z AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM y),
h AS (SELECT p_partkey, i, hits[i] AS hit, s, length(array_to_string(pieces[1:i], '')) + length(array_to_string(hits[1:i - 1], '')) AS start FROM z),
c AS (SELECT p_partkey, i, CAST(trunc(CAST(regexp_extract(hit, '^\d+(?:\.\d+)?') AS DOUBLE) * CASE WHEN upper(right(hit, 2)) = 'TB' THEN 1024 ELSE 1 END) AS INT) AS gb, s[greatest(start - {specs.WINDOW}, 0) + 1:start + length(hit) + {specs.WINDOW}] AS context FROM h),
f AS (SELECT p_partkey, arg_min(gb, i) FILTER (WHERE NOT regexp_matches(context, '(?i){specs.TRAFFIC}|{specs.MEMORY}')) AS storage_gb, arg_min(gb, i) FILTER (WHERE NOT regexp_matches(context, '(?i){specs.STORAGE}|{specs.MEMORY}')) AS bandwidth_gb FROM c GROUP BY p_partkey)
SELECT p_partkey, storage_gb, bandwidth_gb FROM part LEFT JOIN f USING (p_partkey)""")
def sizes_by_surroundings(spark, d):
    """Sizes that no word of their kind stands next to: the first whose surroundings name nothing else."""
    n = F.col("p_size").cast("string")
    cases = [
        (F.lit(""), " GB, 3 TB monthly data allowance and more"), (F.lit(""), " GB for what you keep, and much further on in this text also 1.5TB"),
        (F.lit(""), F.concat(F.lit(" GB RAM here, then after a good many words of filler "), (F.col("p_size") * 10).cast("string"), F.lit("gb in total"))),
        (F.lit("Volume "), F.concat(F.lit(".5 TB, and a longer stretch of words before memory "), n, F.lit(" GB"))), (F.lit(""), F.concat(F.lit("GB next to a disk; "), n, F.lit("0 GB next to that"))),
    ]
    s = F.coalesce(*[F.when(F.col("p_size") % 6 == i, F.concat(head, n, F.lit(tail) if isinstance(tail, str) else tail)) for i, (head, tail) in enumerate(cases)], F.col("p_name"))
    return t(spark, d, "part").select("p_partkey", specs.storage_gb(s).alias("storage_gb"), specs.bandwidth_gb(s).alias("bandwidth_gb"))


@query(r"SELECT page_id, nullif(regexp_replace(CASE WHEN contains(url, '://') THEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) ELSE regexp_extract(url, '^([^/?#]*)', 1) END, '^www\.', ''), '') AS domain FROM pages")
def extract_domain(spark, d):
    return t(spark, d, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"))


@query(rf"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{feeds.ANCHOR.replace("'", "''")}', 1)) AS href FROM pages), b AS (SELECT *, regexp_extract(url, '^([A-Za-z]+:)', 1) AS scheme, regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) AS site FROM a)
SELECT page_id, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN scheme || href WHEN href LIKE '/%' THEN site || href ELSE href END AS link, count(*) AS n FROM b WHERE href LIKE '/%' OR regexp_matches(href, '^https?:') GROUP BY ALL""")
def absolute_links(spark, d):
    rows = feeds.anchors(t(spark, d, "pages").select("page_id", "url", "html")).where(F.col("href").startswith("/") | F.col("href").rlike("^https?:"))
    return rows.groupBy("page_id", urls.absolute(F.col("href"), F.col("url")).alias("link")).agg(F.count("*").alias("n"))


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g') AS h1 FROM pages""")
def page_title_and_h1(spark, d):
    html = F.col("html")
    return t(spark, d, "pages").select("page_id", F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", "").alias("h1"))


@query(rf"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(coalesce(text, ''), '{SPACES}+', ' ', 'g'), '{EMOJI}', '', 'g'))) AS cleaned FROM documents")
def clean_texts(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(clean_text(F.col("text")).cast("binary")).alias("cleaned"))


@query(rf"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{EMOJI}', '', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '{SPACES}+', ' ', 'g'))) AS normal FROM documents")
def normalize_fp_text(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(fingerprint_text(F.col("text")).cast("binary")).alias("normal"))


def _case(rules: tuple, c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({c}), '{'|'.join(w)}') THEN '{k}'" for k, w in rules[0]) + f" ELSE '{rules[1]}' END"


TITLES = "CASE p_size % 9 WHEN 0 THEN 'Cheap VPS deal' WHEN 1 THEN 'Bare Metal box' WHEN 2 THEN 'Web Hosting cPanel' WHEN 3 THEN 'Reseller plan' WHEN 4 THEN 'Cloud VPS' WHEN 5 THEN 'Colocation' WHEN 6 THEN 'dedi sale' WHEN 7 THEN 'OpenVZ virtual' ELSE p_name END"
SITES = {"forum_a": cat.FORUM_A, "blog": cat.BLOG, "forum_b": cat.FORUM_B, "forum_c": cat.FORUM_C, "listings": cat.LISTINGS}


@query(f"SELECT p_partkey, {', '.join(f'{_case(r, 's')} AS {k}' for k, r in SITES.items())} FROM (SELECT p_partkey, {TITLES} AS s FROM part)")
def categorize(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.expr(TITLES).alias("s"))
    return rows.select("p_partkey", *[cat.categorize(F.col("s"), r).alias(k) for k, r in SITES.items()])


@query("""SELECT l_orderkey, l_linenumber, sha1(lower(l_shipmode || '|' || l_returnflag || '|' || CASE WHEN a IS NULL OR a = 0 THEN '' ELSE CAST(a AS VARCHAR) END || '|USD||' || q || '||' )) AS fp
FROM (SELECT l_orderkey, l_linenumber, 'Dom.' || l_linestatus AS l_shipmode, l_returnflag, CAST(l_extendedprice AS DECIMAL(12,2)) AS a, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q FROM lineitem)""")
def strict_fingerprint(spark, d):
    fp = fingerprints.strict_fingerprint(F.concat(F.lit("Dom."), F.col("l_linestatus")), F.col("l_returnflag"), F.col("l_extendedprice"), F.lit("USD"), F.lit(None), F.col("l_quantity").cast("int"), F.lit(None).cast("int"), F.lit(0))
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fp.alias("fp"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha1(lower(coalesce(text, '')))) < doc_id AS is_duplicate FROM documents")
def duplicate_flag(spark, d):
    prints = t(spark, d, "documents").select("doc_id", F.sha1(F.lower(F.coalesce("text", F.lit(""))).cast("binary")).alias("fingerprint"))
    return duplicates.duplicate_flags(prints, post="doc_id", order=["doc_id"])


_RULES = "[" + ", ".join(f"[{a}, {b}]" for a, b in map(fingerprints.permutation, range(8))) + "]"


@query(f"""WITH s AS (SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents),
g AS (SELECT doc_id, CASE WHEN length(x) < 3 THEN [] ELSE list_transform(list_distinct(list_transform(range(1, length(x) - 1), lambda i: substring(x, i, 3))), lambda y: CAST('0x' || substring(md5(y), 1, 8) AS BIGINT)) END AS h FROM s)
SELECT doc_id, array_to_string(list_transform({_RULES}, lambda r: list_min(list_transform(h, lambda y: (y * CAST(r[1] AS BIGINT) + r[2]) % {fingerprints.PRIME}))), ',') AS signature FROM g""")
def minhash_signature(spark, d):
    """Signatures of whole texts, as text; a text of fewer than three characters has none."""
    signature = fingerprints.text_minhash(lower_each(F.coalesce("text", F.lit(""))), 8)
    return t(spark, d, "documents").select("doc_id", F.array_join(signature, ",").alias("signature"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE json_valid(props)")
def json_extract(spark, d):
    raw = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    rows = t(spark, d, "events").select("event_id", configurations.parsed(raw).alias("v"))
    return rows.where("v is not null").select("event_id", F.try_variant_get("v", "$.k", "int").alias("k"))


DEAL = """concat('{"deals":[{"id":"', p_partkey, '","is_valid":', CASE WHEN p_size % 3 = 0 THEN 'false' ELSE 'true' END, ',"locations":["Paris","Rome"],"configurations":[{"name":"a","price":', p_size, ',"cpu_cores":', p_size % 4, '},7,{"name":"b","price":2.5,"currency":null,"billing_period":"year","location":"Oslo","ram_mb":512}]}]}')"""


@query("""WITH p AS (SELECT p_partkey, p_size FROM part WHERE p_size % 3 <> 0)
SELECT p_partkey, 0 AS position, 'a' AS plan_name, CAST(p_size AS DOUBLE) AS price_amount, 'USD' AS price_currency, 'month' AS billing_period, CASE WHEN p_size % 4 > 0 THEN (p_size % 4) || ' cores' END AS cpu, NULL AS ram_mb, 'Paris, Rome' AS location, true AS is_primary FROM p
UNION ALL SELECT p_partkey, 2, 'b', 2.5, NULL, 'year', NULL, 512, 'Oslo', false FROM p""")
def explode_configs(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.expr(DEAL).alias("envelope"))
    out = configurations.explode_configurations(configurations.valid_deals(rows, "envelope"))
    return out.select("p_partkey", "position", "plan_name", "price_amount", "price_currency", "billing_period", "cpu", "ram_mb", "location", "is_primary")


@query("SELECT doc_id, source, n_chars, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 30 AS BIGINT) AS batch, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 30 AS BIGINT) AS place FROM documents")
def batch_chunks(spark, d):
    rows = t(spark, d, "documents").select("doc_id", "source", "n_chars")
    return configurations.batch_numbers(rows, ["doc_id"]).select("doc_id", "source", "n_chars", F.col("batch").cast("long"), F.col("place").cast("long"))


@query("""SELECT o_orderkey || '-' || (row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus, l_extendedprice, l_quantity) - 1) AS card_id, CASE l_returnflag WHEN 'A' THEN '$' WHEN 'N' THEN '€' ELSE 'R ' END || printf('%.2f', l_extendedprice) || CASE l_linestatus WHEN 'O' THEN '/mo' ELSE '/yr' END AS price,
CASE WHEN l_quantity >= 25 THEN CAST(l_quantity AS INT) || 'MB' ELSE NULL END AS ram, coalesce(nullif(l_returnflag, ''), o_orderpriority) AS provider FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'""")
def flatten_cards(spark, d):
    posts = t(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderpriority")
    nested = offers.with_items(posts, t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity"), C, narrow=True)
    cards, i = offers.flattened(nested, C), F.col("item")
    money_ = display.price_label(i["l_extendedprice"], F.when(i["l_returnflag"] == "A", "USD").when(i["l_returnflag"] == "N", "EUR").otherwise(i["l_returnflag"]), F.when(i["l_linestatus"] == "O", "month").otherwise("year"))
    return cards.select("card_id", money_.alias("price"), display.ram_label(F.when(i["l_quantity"] >= 25, i["l_quantity"].cast("int"))).alias("ram"), offers.filled(i["l_returnflag"], F.col("o_orderpriority")).alias("provider"))


@query("SELECT o_orderkey, arg_min(l_extendedprice, struct_pack(a := l_linenumber, b := l_extendedprice)) AS price, count(*) - 1 AS more FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def primary_item(spark, d):
    items = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") == 1).alias("is_primary"), "l_extendedprice")
    nested = offers.with_items(t(spark, d, "orders").select("o_orderkey"), items, C).where(F.size("items") > 0)
    return nested.select("o_orderkey", display.primary_item(F.col("items"))["l_extendedprice"].alias("price"), (F.size("items") - 1).cast("long").alias("more"))


@query("""SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 24 HOURS) AS recent, CASE WHEN max(ts) IS NULL THEN 'no_data' WHEN max(ts) < TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 2 HOURS THEN 'stale' ELSE 'ok' END AS status FROM events""")
def recency_stale(spark, d):
    found = health.freshness(t(spark, d, "events").select(F.col("ts").alias("created_at")), F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    return found.select(F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"), "recent", "status")


@query("""WITH o AS (SELECT *, o_orderkey % 10 < 7 AS old, o_orderkey % 10 >= 5 AS again FROM orders)
SELECT o_orderkey, CASE WHEN old AND again THEN 'touched' WHEN old THEN 'kept' ELSE 'new' END AS state FROM o""")
def upsert_new(spark, d):
    orders = t(spark, d, "orders").select("o_orderkey")
    table = orders.where("o_orderkey % 10 < 7").withColumn("state", F.lit("kept"))
    batch = orders.where("o_orderkey % 10 >= 5").withColumn("state", F.lit("new"))
    return tables.touched(table, batch, ["o_orderkey"], F.lit("touched"), "state").unionByName(tables.new_rows(batch, table, ["o_orderkey"]))


@query("""SELECT coalesce(a.n_nationkey, b.n_nationkey) AS n_nationkey, CASE WHEN b.n_nationkey IS NOT NULL THEN 'new' ELSE 'old' END AS label, CASE WHEN a.n_nationkey IS NOT NULL THEN 'old' ELSE 'new' END AS born
FROM (SELECT * FROM nation WHERE n_nationkey < 18) a FULL JOIN (SELECT * FROM nation WHERE n_nationkey >= 10) b USING (n_nationkey)""")
def upsert_set_on_insert(spark, d):
    n = t(spark, d, "nation").select("n_nationkey")
    both = lambda v: {"label": F.lit(v), "born": F.lit(v)}
    return tables.upserted(n.where("n_nationkey < 18").withColumns(both("old")), n.where("n_nationkey >= 10").withColumns(both("new")), ["n_nationkey"], ["label"], ["born"])


@query("SELECT s_suppkey, CASE WHEN s_nationkey IN (1, 3, 5) THEN true ELSE false END AS enabled FROM supplier")
def set_enabled_in(spark, d):
    rows = t(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.lit(False).alias("enabled"))
    return tables.assigned(rows, F.col("s_nationkey").isin(1, 3, 5), {"enabled": F.lit(True)}).select("s_suppkey", "enabled")


@query("SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 20")
def feed_cap_per_source(spark, d):
    return feeds.capped(t(spark, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 20)


@query("SELECT l.l_orderkey, count(*) AS n FROM lineitem l WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey")
def cascade_delete(spark, d):
    gone = t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return tables.without(t(spark, d, "lineitem").select("l_orderkey"), gone, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, nullif(trim(CASE WHEN p_size % 3 = 0 THEN regexp_extract('Location: ' || p_brand || ' Berlin' || chr(10), '(?i)location[\\s:]+([A-Za-z\\s,]+?)(?:\\n|$|\\.)', 1) WHEN p_size % 3 = 1 THEN 'Germany' ELSE '' END), '') AS place FROM part")
def location_from_text(spark, d):
    n = F.col("p_size") % 3
    s = F.when(n == 0, F.concat(F.lit("Location: "), F.col("p_brand"), F.lit(" Berlin\n"))).when(n == 1, "servers in Germany today").otherwise("somewhere")
    return t(spark, d, "part").select("p_partkey", places.location(s).alias("place"))


@query("SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, min(event_id) OVER (PARTITION BY event_type, user_id % 50) < event_id AS is_duplicate FROM events")
def stream_ingest(spark, d):
    """Events as threads: the stream's table, after all there is was ingested, equals the batch result."""
    from ..operators.shared import fresh_path
    from ..operators.tables import Store
    from ..streaming.ingest import ingest_stream

    root = fresh_path(spark, "stream")
    schema = t(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = rows.select("event_id", "user_id", "ts", F.concat_ws("|", "event_type", F.col("user_id") % 50).alias("fingerprint"))
    store = Store(spark, f"{root}/tables", buckets=16)
    ingest_stream(rows, store, ["event_id"], f"{root}/checkpoint", order=["event_id"]).awaitTermination()
    return store.rows("posts").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "is_duplicate")


from . import site_catalog, stream_catalog  # noqa: E402, F401  (they register their queries in the same table)


@query(f"""WITH x AS (SELECT doc_id, substring(text, 1, 40) AS title, CASE WHEN doc_id % 4 > 0 THEN source END AS url, CASE WHEN doc_id % 3 > 0 THEN text END AS summary, CASE WHEN doc_id % 2 > 0 THEN text END AS content FROM documents)
SELECT doc_id, md5(concat_ws(chr(10), 'Thread ' || doc_id, CASE WHEN title <> '' THEN 'Title: ' || title END, CASE WHEN url <> '' THEN 'URL: ' || url END, CASE WHEN summary <> '' THEN 'Summary: ' || substring(summary, 1, {configurations.SUMMARY_CHARS}) END, CASE WHEN content <> '' THEN 'Content: ' || substring(content, 1, {configurations.CONTENT_CHARS}) END, '---')) AS thread,
md5(concat_ws(chr(10), CASE WHEN title <> '' THEN 'Title: ' || title END, CASE WHEN content <> '' THEN 'Content: ' || substring(content, 1, {configurations.POST_CHARS}) END)) AS post FROM x""")
def prompt_blocks(spark, d):
    """What an extractor is shown of a thread in a batch, and of a post by itself."""
    text, n = F.col("text"), F.col("doc_id")
    title, content = F.substring(text, 1, 40), F.when(n % 2 > 0, text)
    thread = configurations.prompt_block(n, title, F.when(n % 4 > 0, F.col("source")), F.when(n % 3 > 0, text), content)
    return t(spark, d, "documents").select("doc_id", F.md5(thread.cast("binary")).alias("thread"), F.md5(configurations.post_block(title, content).cast("binary")).alias("post"))
