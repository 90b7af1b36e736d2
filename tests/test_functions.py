"""Column functions against tables of values."""

import pytest
from pyspark.sql import functions as F

from offerlake.functions import category as cat
from offerlake.functions import display, money, places, specs, text, urls


def values(spark, make, inputs, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in rows.select(make(F.col("v")).alias("o"), "i").orderBy("i").select("o").collect()]


TABLES = {
    "domain": (urls.domain, [("https://www.example.com/order", "example.com"), ("example.com", "example.com"), ("", None), (None, None), ("http://h:8080/x?y#z", "h:8080"), ("//cdn.x.y/z", "cdn.x.y"), ("www.a.b/c", "a.b")]),
    "price": (money.price, [("$9.99", 9.99), ("Free", 0.0), ("123", 123.0), ("invalid", None), ("", None), (None, None), ("1,99", 199.0), ("freedom 3", 3.0)]),
    "currency": (money.currency, [("€10.00", "EUR"), ("9.99 usd", "USD"), ("9.99", "USD"), ("$5 €", "USD"), ("₹7", "INR"), ("5 cad", "CAD"), ("", None)]),
    "period": (money.billing_period, [("$9.99/mo", "month"), ("annually", "year"), ("lifetime", "one_time"), ("x", "month"), ("/yr", "year"), ("yr", "month"), ("", None)]),
    "ram": (specs.ram_mb, [("2GB RAM", 2048), ("512MB", 512), ("none", None), ("1.5 gb", 1536), (None, None), ("512MB then 1GB", 1024)]),
    "storage": (specs.storage_gb, [("50GB SSD", 50), ("1TB HDD", 1024), ("500 GB", 500), ("disk: 20GB", 20), ("2GB RAM here", None), ("2TB bandwidth", None), ("4GB memory and then, a good deal further on in this text, 80GB", 80), (None, None), ("", None)]),
    "bandwidth": (specs.bandwidth_gb, [("1TB bandwidth", 1024), ("500GB", 500), ("unlimited", -1), ("traffic - 3TB", 3072), ("20GB SSD", None), ("x", None)]),
    "clean": (text.clean_text, [("  a \n\t b ", "a b"), (None, ""), ("a 😀 b", "a  b"), (" x", "x")]),
    "fingerprint_text": (text.fingerprint_text, [("Héllo!!! 😀 World_1", "héllo world_1"), (None, "")]),
    "discussion": (urls.discussion_id, [("https://x/discussion/185000/a", "185000"), ("https://x/y", "https://x/y")]),
    "threads": (urls.threads_id, [("https://x/threads/vps-special.123456/", "123456"), ("https://x/", "https://x/")]),
    "blog": (urls.blog_id, [("https://x/?p=42", "42"), ("https://x/a/b-c/", "b-c"), ("https://x/", "https://x/")]),
    "showthread": (urls.showthread_id, [("x?t=9", "9"), ("x/a.77/", "77"), ("x/55/", "55"), ("x", None)]),
    "listing": (urls.listing_id, [("https://x/server/abc/1", "abc"), ("https://x/12/", "12")]),
    "forum_a": (lambda c: cat.categorize(c, cat.FORUM_A), [("VPS deal", "vps"), ("Shared cPanel VPS", "shared"), ("Cloud VPS", "cloud"), ("bare metal", "dedicated"), ("Colocation", "colo"), ("hm", "other"), (None, "other")]),
    "forum_c": (lambda c: cat.categorize(c, cat.FORUM_C), [("reseller", "shared"), ("dedi", "dedicated"), ("x", "other")]),
    "alias": (cat.alias, [("webhosting", "shared"), ("vps", "vps")]),
    "location": (places.location, [("Location: New York, US. more", "New York, US"), ("hosted in Germany now", "Germany"), ("nowhere", None)]),
}


@pytest.mark.parametrize("name", TABLES)
def test_values(spark, name):
    make, pairs = TABLES[name]
    assert values(spark, make, [p[0] for p in pairs]) == [p[1] for p in pairs]


def test_monthly_price(spark):
    rows = spark.createDataFrame([(12.0, "month"), (120.0, "year"), (100.0, "one_time"), (None, "month"), (1.5, "year"), (5.0, None)], "a double, p string")
    assert [r[0] for r in rows.select(money.monthly_price(F.col("a"), F.col("p"))).collect()] == [12.0, 10.0, None, None, 0.12, None]


def test_absolute_urls_follow_the_standard_library(spark):
    from urllib.parse import urljoin

    bases = ["https://h.example/a/b?q=1#f", "http://h.example", "https://h.example/a/"]
    refs = ["/x", "x", "../x", "./x/../y", "//o.example/z", "?k=v", "#top", "https://z/", "mailto:a@b", "../../../up", "x?y=/../z"]
    rows = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string").withColumn("o", urls.absolute(F.col("r"), F.col("b"))).collect()
    assert [(r.b, r.r, r.o) for r in rows] == [(r.b, r.r, urljoin(r.b, r.r)) for r in rows]


def test_hits_know_their_places(spark):
    rows = spark.createDataFrame([("ab12cd345ef",), ("",), (None,)], "v string")
    got = [r[0] for r in rows.select(text.hits_with_context(F.col("v"), r"\d+", 2)).collect()]
    assert [tuple(x) for x in got[0]] == [("12", "ab12cd"), ("345", "cd345ef")]
    assert got[1] == [] and got[2] is None


def test_display(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(display.price_label(F.lit(5.0), F.lit("USD"), F.lit("month"))) == "$5.00/mo"
    assert pick(display.price_label(F.lit(5.0), F.lit("CHF"), F.lit("year"))) == "CHF 5.00/yr"
    assert pick(display.price_label(F.lit(None).cast("double"), F.lit("USD"), F.lit("year"))) == "Price on request"
    assert [pick(display.ram_label(F.lit(x).cast("int"))) for x in (2048, 512, 0, None)] == ["2GB", "512MB", None, None]
    assert [pick(display.bandwidth_label(F.lit(x).cast("int"))) for x in (-1, 5, None)] == ["Unmetered", "5GB", None]
    assert pick(display.spec_line(F.lit("a"), F.lit(None), F.lit("b"))) == "a • b"
    assert pick(display.link(F.lit(""), F.lit(None), F.lit("x.y"))) == "https://x.y"
    assert pick(display.title_label(F.lit(""), F.lit("plan"), F.lit("t"))) == "plan"
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    assert pick(display.age_label(F.lit("2024-01-01 22:00:00").cast("timestamp"), now)) == "2 hours ago"
    assert pick(display.age_label(F.lit(None).cast("timestamp"), now)) == "Recently"
