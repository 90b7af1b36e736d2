"""Feeds and pages, on samples of our own."""

from pyspark.sql import functions as F

from offerlake.functions import category as cat
from offerlake.functions import urls
from offerlake.sources import dom, feeds, pages



def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")

FORUM_B = """<html><h1 class="p-title-value">Small VPS Sale - 2GB RAM</h1><a class="message-name">AcmeHost</a><time datetime="2024-04-02T10:00:00Z">x</time>
<div class="message-body"><div class="bbWrapper">We sell: 2GB RAM, 50GB SSD, 2TB bandwidth.<br>Price: $5.99/mo or pay. <a href="/cart/1">Order now</a></div></div></html>"""
TWO = """<h1 class="p-title-value">Two</h1><div class="message-body"><div class="bbWrapper">Price: $3.99/mo and Price: $7.99 per month <a href="https://www.acme.test/buy">buy</a></div></div>"""
FORUM_A = """<h1>VPS $3/month - 1GB RAM</h1><span class="Author"><a href="/u">Seller</a></span><div class="Message">Great box 1GB RAM 25GB disk
Price: 3.00 USD/month <a href="https://acme.test/client/x">here</a></div>"""
FORUM_C = """<h1 class="thread-title">Virtual servers</h1><span class="username">Bob</span><div class="postcontent">From €4.50/mo with 4GB RAM. Location: Berlin, Germany. unlimited</div>"""
LISTING = """<h1>Box</h1><div class="provider-name">Acme</div><div class="price">$20.00/yr</div><table><tr><td>Memory</td><td>8 GB</td></tr><tr><td>CPU</td><td> 4 cores </td></tr><tr><td>RAM note</td><td>none</td></tr></table>"""


def parsed(spark, html, site, url="https://f.test/threads/a.12/"):
    walked = pages.walk(spark.createDataFrame([(url, html)], "url string, html string"), pages.SPECS[site])
    return pages.posts(walked, pages.SPECS[site], now()).collect(), pages.items(walked, pages.SPECS[site]).collect()


def test_forum_b(spark):
    (post,), (item,) = parsed(spark, FORUM_B, "forum_b")
    assert (post.title, post.author, post.source_thread_id, post.category) == ("Small VPS Sale - 2GB RAM", "AcmeHost", "12", "vps")
    assert str(post.posted_at) == "2024-04-02 10:00:00"
    assert (item.price_amount, item.price_currency, item.billing_period, item.price_monthly, item.ram_mb, item.storage_gb, item.bandwidth_gb) == (5.99, "USD", "month", 5.99, 2048, 50, 2048)
    assert (item.order_url, item.provider_domain, item.is_primary) == ("https://f.test/cart/1", "f.test", True)


def test_two_prices(spark):
    _, items = parsed(spark, TWO, "forum_b")
    assert [(i.price_amount, i.is_primary, i.provider_domain) for i in sorted(items, key=lambda i: i.position)] == [(3.99, True, "acme.test"), (7.99, False, "acme.test")]


def test_link_without_price_makes_a_bare_row(spark):
    _, items = parsed(spark, TWO.replace("Price", "Cost"), "forum_b")
    assert [(i.price_amount, i.price_currency, i.order_url, i.is_primary) for i in items] == [(None, None, "https://www.acme.test/buy", True)]


def test_forum_a(spark):
    (post,), (item,) = parsed(spark, FORUM_A, "forum_a", "https://f.test/discussion/185/x")
    assert (post.title, post.author, post.source_thread_id) == ("VPS $3/month - 1GB RAM", "Seller", "185")
    assert (item.price_amount, item.price_currency, item.billing_period, item.ram_mb, item.storage_gb, item.order_url) == (3.0, "USD", "month", 1024, 25, "https://acme.test/client/x")


def test_forum_c(spark):
    (post,), (item,) = parsed(spark, FORUM_C, "forum_c", "https://f.test/showthread.php?t=9")
    assert (post.author, post.category, post.source_thread_id, str(post.posted_at)) == ("Bob", "vps", "9", "2024-05-01 00:00:00")
    assert (item.price_amount, item.price_currency, item.location, item.ram_mb, item.bandwidth_gb) == (4.5, "EUR", "Berlin, Germany", 4096, -1)


def test_listing_takes_the_last_row_of_a_kind(spark):
    (post,), (item,) = parsed(spark, LISTING, "listings", "https://l.test/server/abc")
    assert (post.author, post.source_thread_id) == ("Acme", "abc")
    assert (item.ram_mb, item.cpu, item.price_amount, item.billing_period, item.price_monthly) == (None, "4 cores", 20.0, "year", 1.67)


def test_null_page(spark):
    (post,), items = parsed(spark, None, "forum_a")
    assert post.title == "Deal Post" and items == []


def test_period_captured_or_strict(spark):
    rows = spark.createDataFrame([("Price: $12/yr",)], "content string")
    spec = pages.SPECS["forum_b"]
    assert pages.text_items(rows.withColumn("links", F.lit(None)), spec).collect()[0].billing_period == "year"
    assert pages.text_items(rows, spec, strict=True).collect()[0].billing_period == "month"


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title> VPS   deal</title><link>https://f.test/discussion/7/x</link><pubDate>Tue, 02 Apr 2024 10:00:00 +0000</pubDate><description>a</description></item><item><title>Colo</title><link>https://f.test/discussion/8/y</link><content:encoded xmlns:content='c'>body</content:encoded></item></channel></rss>")
    got = sorted(feeds.threads(feeds.read_feed(spark, str(tmp_path / "f.xml")), "forum_a", now(), urls.discussion_id, cat.FORUM_A).collect(), key=lambda r: r.url)
    assert [(r.title, r.category, r.source_thread_id, str(r.posted_at), r.summary) for r in got] == [("VPS deal", "vps", "7", "2024-04-02 10:00:00", "a"), ("Colo", "colo", "8", "2024-05-01 00:00:00", "body")]


def test_lists_and_cards(spark):
    html = "".join(f'<a href="/showthread.php?t={i}">T{i}</a><a href="/other">o</a>' for i in range(30))
    lists = spark.createDataFrame([("vps", "vps", "https://f.test/list", html), ("dedi", "dedicated", "https://f.test/l2", html)], "forum string, category string, url string, html string")
    got = feeds.list_threads(lists, now()).groupBy("source_name").count().collect()
    assert {(r.source_name, r["count"]) for r in got} == {("vps", 20), ("dedi", 20)}
    cards = spark.createDataFrame([(0, "/server/a", "VPS"), (1, "#", "x"), (2, "/", "y"), (60, "/server/z", "late")], "position int, href string, title string").withColumn("url", F.lit("https://l.test/"))
    assert [(r.url, r.source_thread_id) for r in feeds.card_threads(cards, now()).collect()] == [("https://l.test/server/a", "a")]


def firsts(html, *names):
    page = dom.read(html, {n: (n,) for n in names})
    return [(c := page.first(n)) and c.text for n in names]


def test_selectors():
    got = firsts("<div class='a b'><p id=x>1<b>2</b></p><td>q</td></div><a href='/order/1'>o</a>", ".a p", "#x b", "a[href*='order']", ".b .none, td", "h1", "div.a.b td", "b p", "p td")
    assert got == ["12", "2", "o", "q", None, "q", None, None]
    page = dom.read("<h1>late</h1><p class=t>a<script>x</script>b<i>c</p>", {"title": (".T", "p.t", "h1")})
    assert page.first("title").text == "abc"  # the second selector goes before the third, wherever its element stands


def test_implied_ends():
    """Rows, cells, entries, paragraphs and options end where the next begins."""
    rows = lambda html: [(r.text, r.value and r.value.text) for r in dom.read(html, {}, rows="tr, li, p, dd, option", values="td:last-child").rows]
    assert rows("<table><tr><td>Memory<td>2 GB<tr><td>CPU<td>4 cores<tbody><tr><td>x</table>") == [("Memory2 GB", "2 GB"), ("CPU4 cores", "4 cores"), ("x", "x")]
    assert rows("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == [("abc", None), ("b", None), ("c", None), ("d", None)]
    assert rows("<p>a<p>b<div>c</div>d<p>e<b>f</p>g") == [("a", None), ("b", None), ("ef", None)]
    assert rows("<dl><dt>k<dd>v<dt>l<dd>w</dl><select><option>1<option>2</select>") == [("v", None), ("w", None), ("1", None), ("2", None)]
    assert rows("<table><tr><td>out<table><tr><td>in<td>last</table><td>z</table>") == [("outinlastz", "last"), ("inlast", "last")]
    assert rows("</p><tr><td>a</td><td>b</td><br></tr>") == [("ab", None)]  # the last child is no cell


def test_deep_and_unclosed_pages_are_read_in_linear_time():
    import time

    start = time.perf_counter()
    page = dom.read("<p>" + "<div class=d>" * 20_000 + "x" + "<tr><td>a<td>b" * 20_000, {"d": (".d .d .d",)}, rows="tr", values="td:last-child")
    assert page.first("d").text.startswith("x") and len(page.rows) == 20_000 and page.rows[7].value.text == "b"
    assert time.perf_counter() - start < 3


def test_unclosed_listing(spark):
    html = LISTING.replace("</td>", "").replace("</tr>", "")
    (_,), (item,) = parsed(spark, html, "listings", "https://l.test/server/abc")
    assert (item.ram_mb, item.cpu, item.price_amount) == (None, "4 cores", 20.0)


def test_only_what_is_wanted_is_read(spark):
    rows = spark.createDataFrame([("https://f.test/threads/a.12/", FORUM_B)], "url string, html string")
    post, items = (pages.walk(rows, pages.SPECS["forum_b"], want=w).first() for w in ("post", "items"))
    assert post.page_author == "AcmeHost" and post.links == [] and items.page_title is None and items.links[0].href == "/cart/1" and post.content == items.content


def test_summary(spark):
    rows = spark.createDataFrame([("<p>Price: $4/mo</p> https://acme.test/order/1",)], "summary string")
    (item,) = pages.summary_items(rows, pages.SPECS["forum_a"]).collect()
    assert (item.price_amount, item.order_url, item.provider_domain) == (4.0, "https://acme.test/order/1", "acme.test")
    assert pages.registry("none") is None


def test_a_bad_page_stops_no_other(spark):
    rows = spark.createDataFrame([("forum_b", "u1", FORUM_B), ("nobody", "u2", FORUM_B), ("forum_c", "u3", FORUM_C)], "site string, url string, html string")
    got = {r.url: (r.page_title, r.error, r.site) for r in pages.walk(rows, None, by="site", keep=["site"]).collect()}
    assert got == {"u1": ("Small VPS Sale - 2GB RAM", None, "forum_b"), "u2": (None, "KeyError: 'nobody'", "nobody"), "u3": ("Virtual servers", None, "forum_c")}


def test_feed_is_capped(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(feeds.CAPS, "blog", 2)
    items = "".join(f"<item><title>t{i}</title><link>https://b.test/?p={i}</link></item>" for i in range(5))
    (tmp_path / "f.xml").write_text(f"<rss><channel>{items}</channel></rss>")
    got = feeds.threads(feeds.read_feed(spark, str(tmp_path / "f.xml")), "blog", now(), urls.blog_id, cat.BLOG).collect()
    assert sorted(r.source_thread_id for r in got) == ["0", "1"]
