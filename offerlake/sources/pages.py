"""Pages of each site as posts and items.

Only the walk over HTML is Python, a batch at a time and one pass a page: it yields the few texts, links and specification rows that a site's
``PageSpec`` names. What is read from those texts is column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import category as cat
from ..functions import urls
from ..functions.money import billing_period, currency, monthly_price, price
from ..functions.places import location, posted_at
from ..functions.specs import bandwidth_gb, ram_mb, storage_gb
from ..functions.text import blank_to_null, clean_text, hits_with_context
from ..operators.configurations import first_filled
from . import dom

CODE = "(USD|EUR|GBP|CAD|AUD|JPY|INR|CNY|SGD)"
# How prices are written.
LABELLED = rf"(?i)Price[:\s]+([€$£¥₹]?\d+(?:[.,]\d+)?)\s*{CODE}?(?:/|\s*per\s*)?(mo|month|yr|year)?"
LEADING = rf"(?im)(?:^|\n)\s*([€$£¥₹]?\d+(?:[.,]\d+)?)\s*{CODE}?(?:/|\s*per\s*)?(mo|month|yr|year|annually)"
PLAIN = [r"(?i)\$[\d.]+(?:/mo|/month|/yr|/year)?", r"(?i)€[\d.]+(?:/mo|/month|/yr|/year)?", r"(?i)[\d.]+\s*(?:USD|EUR|GBP)(?:/mo|/month)?"]


@dataclass(frozen=True)
class PageSpec:
    """Where a site's pages keep what is read, and by which rules."""

    title: tuple[str, ...]
    author: tuple[str, ...]
    date: tuple[str, ...]
    content: tuple[str, ...]
    default_title: str
    thread_id: object
    categories: tuple
    order_text: str = ""
    order_href: str = ""
    prices: tuple[str, ...] = (LABELLED,)
    context: int = 200
    single_item: bool = False
    spec_rows: str = ""
    spec_price: str = ""
    date_default_now: bool = False
    summary: bool = False  # a feed's summary stands in for a page that is missing


# Selectors and words of each site's markup.
SPECS = {
    "forum_a": PageSpec(("h1.Title", ".PageTitle h1", "h1.discussionTitle", "article h1", "h1"), (".Author a", ".username"), ("time",), (".Message", ".post-content", "article"), "Deal Post", urls.discussion_id, cat.FORUM_A, "order|buy|purchase|client|cart|signup", "order|cart|client", (LEADING, LABELLED), 300, summary=True),
    "blog": PageSpec(("h1.entry-title", ".post-title", "article h1", "h1"), (), ("time",), (".entry-content", ".post-content", "article"), "Deal Post", urls.blog_id, cat.BLOG, "order|buy|purchase|client|cart|signup|visit", "order|cart|client", (LEADING, LABELLED), 300, summary=True),
    "forum_b": PageSpec(("h1.p-title-value",), (".message-name",), ("time",), (".message-body .bbWrapper",), "Unknown", urls.threads_id, cat.FORUM_B, "order|buy|purchase|client|billing"),
    "forum_c": PageSpec(("h1.p-title-value, .thread-title, h1",), (".message-userDetails a, .author-name, .username",), ("time, .DateTime, .post-date",), (".message-body, .postcontent, .post-content, article.message",), "Offer", urls.showthread_id, cat.FORUM_C, prices=tuple(PLAIN), single_item=True, date_default_now=True),
    "listings": PageSpec(("h1, .server-title, .listing-title",), (".provider-name, .company-name, .seller-name",), (), (".server-description, .listing-content, .description, article",), "Server Offer", urls.listing_id, cat.LISTINGS, spec_rows=".spec-row, .spec-item, .server-spec, tr", spec_price=".price, .server-price, .listing-price", date_default_now=True),
}

WALKED = "url string, page_title string, page_author string, page_date string, content string, links array<struct<href: string, text: string>>, spec_rows array<struct<text: string, value: string>>, spec_price string, error string"
_WALKED_NAMES = ["url", "page_title", "page_author", "page_date", "content", "links", "spec_rows", "spec_price", "error"]


def registry(name: str) -> PageSpec | None:
    return SPECS.get(name)


LINK, ROW = pa.struct([("href", pa.string()), ("text", pa.string())]), pa.struct([("text", pa.string()), ("value", pa.string())])
VALUES = ".spec-value, td:last-child"


def _reading(spec: PageSpec, want: str) -> tuple[dom.Selectors, str | None]:
    firsts = {"title": spec.title, "author": spec.author, "date": spec.date} if want != "items" else {}
    firsts |= {"content": spec.content} | ({"price": (spec.spec_price,)} if spec.spec_price and want != "post" else {})
    return dom.selectors(firsts, spec.spec_rows if want != "post" else "", VALUES), "content" if want != "post" and not spec.single_item and not spec.spec_rows else None


def walk(pages: DataFrame, spec: PageSpec | None, url: str = "url", html: str = "html", *, by: str | None = None, keep: list[str] | None = None, want: str = "all") -> DataFrame:
    """The columns of ``WALKED`` for each page, and those named by ``keep``. A page that can't be read has its ``error`` and nothing else.
    Without ``spec``, the column ``by`` names the site whose rules hold for a page, so that all sites are read in one pass. ``want``: ``post`` or
    ``items`` leaves out what only the other reads."""
    compiled: dict[str | None, tuple[dom.Selectors, str | None]] = {}

    def one(h: str | None, site: str | None) -> tuple:
        if site not in compiled:
            compiled[site] = _reading(spec or SPECS[site], want)
        chosen, links = compiled[site]
        page = dom.Reader(chosen, links).read(h)
        text = lambda name: (c := page.first(name)) and c.text
        date, content = page.first("date"), page.first("content")
        when = (date.attrs.get("datetime") or date.attrs.get("title") or date.text) if date else None
        anchors = [(a.attrs["href"], a.text) for a in page.links_in(content)] if links and content else []
        return text("title"), text("author"), when, content and content.text, anchors, [(r.text.lower(), r.value and r.value.text) for r in page.rows], text("price"), None

    def guarded(h: str | None, site: str | None) -> tuple:
        try:
            return one(h, site)
        except Exception as e:  # one bad page must not end the job
            return (None, None, None, None, [], [], None, f"{type(e).__name__}: {e}")

    def run(batches):
        for batch in batches:
            sites = batch.column(batch.schema.get_field_index(by)).to_pylist() if by else [None] * batch.num_rows
            cols = list(zip(*(guarded(h.as_py(), site) for h, site in zip(batch.column(1), sites)))) or [()] * 8
            pairs = lambda c, kind: pa.array([[dict(zip(kind.names, x)) for x in xs] for xs in c], pa.list_(kind))
            out = [batch.column(0), *(pa.array(c, pa.string()) for c in cols[:4]), pairs(cols[4], LINK), pairs(cols[5], ROW), *(pa.array(c, pa.string()) for c in cols[6:])]
            yield pa.RecordBatch.from_arrays([*out, *(batch.column(batch.schema.get_field_index(c)) for c in keep or [])], names=[*_WALKED_NAMES, *(keep or [])])

    rows = pages.select(F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), *dict.fromkeys([*(keep or []), *([by] if by else [])]))
    kept = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in keep or [])
    return rows.mapInArrow(run, WALKED + kept)


def posts(walked: DataFrame, spec: PageSpec, as_of: Column, *, category: Column | None = None, feed_title: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Post fields of walked pages, and the columns named by ``keep``."""
    title = F.coalesce(blank_to_null(clean_text(F.col("page_title"))), feed_title if feed_title is not None else F.lit(None).cast("string"), F.lit(spec.default_title))
    when = posted_at(F.col("page_date"))
    rows = walked.withColumn("title", title)
    own = cat.categorize(F.concat_ws(" ", F.col("url"), F.col("title")) if spec.single_item else F.col("title"), spec.categories)
    return rows.select(
        F.col("url").alias("canonical_url"), spec.thread_id(F.col("url")).alias("source_thread_id"), "title", blank_to_null(clean_text(F.col("page_author"))).alias("author"),
        (F.coalesce(when, as_of) if spec.date_default_now else when).alias("posted_at"), (F.coalesce(blank_to_null(category), own) if category is not None else own).alias("category"), clean_text(F.col("content")).alias("raw_text"), *(keep or []),
    )


def order_link(spec: PageSpec, links: Column, base: Column) -> Column:
    """The first link that leads to an order, absolute."""
    wanted = F.filter(links, lambda x: (clean_text(x["text"]).rlike(f"(?i){spec.order_text}") if spec.order_text else F.lit(False)) | (x["href"].rlike(f"(?i){spec.order_href}") if spec.order_href else F.lit(False)))
    return F.get(F.transform(wanted, lambda x: urls.absolute(x["href"], base)), 0)


def text_items(rows: DataFrame, spec: PageSpec, text: str = "content", link: Column | None = None, *, strict: bool = False) -> DataFrame:
    """A row per price found, from the first pattern that finds any, with what surrounds it read for sizes. Without a price, a link's
    domain alone makes a row. ``strict`` reads the period from the captured word only, which knows no ``yr`` or ``year``."""
    body = F.coalesce(F.col(text), F.lit(""))

    def priced(pattern: str) -> Column:
        part = lambda hit, k: blank_to_null(F.regexp_extract(hit, pattern, k))
        return F.transform(hits_with_context(body, pattern, spec.context), lambda x: F.struct(x["hit"].alias("hit"), x["context"].alias("context"), part(x["hit"], 1).alias("amount"), part(x["hit"], 2).alias("code"), part(x["hit"], 3).alias("period")))

    found = first_filled(*map(priced, spec.prices))
    rows = rows.withColumn("order_url", link if link is not None else F.lit(None).cast("string")).withColumn("provider_domain", urls.domain(F.col("order_url")))
    rows = rows.withColumn("_h", found)
    rows = rows.select(*[c for c in rows.columns if c != "_h"], F.posexplode_outer("_h").alias("position", "_h")).where(F.col("_h").isNotNull() | F.col("provider_domain").isNotNull())
    hit, context, code = F.col("_h.hit"), F.col("_h.context"), F.col("_h.code")
    word = F.col("_h.period")
    period = billing_period(F.coalesce(word, hit)) if strict else F.when(word.rlike("(?i)^(yr|year|annually)$"), "year").when(word.isNotNull(), "month").otherwise(billing_period(hit))
    amount = price(F.col("_h.amount"))
    out = rows.withColumns({"price_amount": amount, "price_currency": F.when(hit.isNotNull(), F.coalesce(F.upper(code), currency(hit))), "billing_period": F.when(hit.isNotNull(), period), "ram_mb": ram_mb(context), "storage_gb": storage_gb(context), "bandwidth_gb": bandwidth_gb(context), "is_primary": F.coalesce(F.col("position"), F.lit(0)) == 0})
    monthly = F.when(F.col("price_amount") != 0, monthly_price(F.col("price_amount"), F.col("billing_period")))
    return out.withColumn("price_monthly", monthly).drop("_h")


def plain_item(rows: DataFrame, text: str = "raw_text") -> DataFrame:
    """At most one row a post, from the first price of the first way of writing that occurs; it has no monthly price."""
    c = F.col(text)
    first = F.coalesce(*[F.regexp_substr(c, F.lit(p)) for p in PLAIN])
    out = rows.withColumn("_p", first).where("_p is not null")
    return out.withColumns({"price_amount": price(F.col("_p")), "price_currency": currency(F.col("_p")), "billing_period": billing_period(F.col("_p")), "location": location(c), "ram_mb": ram_mb(c), "storage_gb": storage_gb(c), "bandwidth_gb": bandwidth_gb(c), "is_primary": F.lit(True)}).drop("_p")


def listing_item(walked: DataFrame) -> DataFrame:
    """One row from specification rows; of each kind the last row counts, even where it says nothing."""
    last = lambda words, make: F.try_element_at(F.transform(F.filter("spec_rows", lambda r: r["text"].rlike(words)), make), F.lit(-1))
    cost = F.col("spec_price")
    out = walked.withColumns({
        "ram_mb": last("ram|memory", lambda r: ram_mb(r["text"])), "storage_gb": last("storage|disk|ssd|hdd", lambda r: storage_gb(r["text"])), "bandwidth_gb": last("bandwidth|traffic|transfer", lambda r: bandwidth_gb(r["text"])),
        "cpu": F.try_element_at(F.transform(F.filter("spec_rows", lambda r: r["text"].rlike("cpu|core|processor") & r["value"].isNotNull()), lambda r: clean_text(r["value"])), F.lit(-1)),
        "location": F.try_element_at(F.transform(F.filter("spec_rows", lambda r: r["text"].rlike("location|datacenter|region") & r["value"].isNotNull()), lambda r: clean_text(r["value"])), F.lit(-1)),
        "price_amount": price(cost), "price_currency": F.coalesce(currency(cost), F.lit("USD")), "billing_period": F.coalesce(billing_period(cost), F.lit("month")), "provider_domain": urls.domain(F.col("url")), "is_primary": F.lit(True),
    })
    kinds = "ram|memory|storage|disk|ssd|hdd|bandwidth|traffic|transfer|cpu|core|processor|location|datacenter|region"
    return out.where(cost.isNotNull() | F.exists("spec_rows", lambda r: r["text"].rlike(kinds))).withColumn("price_monthly", monthly_price(F.col("price_amount"), F.col("billing_period")))


def items(walked: DataFrame, spec: PageSpec) -> DataFrame:
    """Items of walked pages by the site's rules."""
    if spec.spec_rows:
        return listing_item(walked)
    if spec.single_item:
        return plain_item(walked.withColumn("raw_text", clean_text(F.col("content"))))
    return text_items(walked, spec, link=order_link(spec, F.col("links"), F.col("url")))


def summary_posts(rows: DataFrame, spec: PageSpec, *, category: Column, title: Column, summary: str = "summary", keep: list[str] | None = None) -> DataFrame:
    """Post fields from a feed's summary, where a page is missing: it has no author and no date."""
    none = F.lit(None).cast("string")
    return rows.select(
        F.col("url").alias("canonical_url"), spec.thread_id(F.col("url")).alias("source_thread_id"), F.coalesce(blank_to_null(title), F.lit(spec.default_title)).alias("title"), none.alias("author"),
        none.cast("timestamp").alias("posted_at"), category.alias("category"), summary_text(F.col(summary)).alias("raw_text"), *(keep or []),
    )


def summary_text(summary: Column) -> Column:
    return clean_text(F.regexp_replace(summary, "<[^>]*>", " "))


def summary_items(rows: DataFrame, spec: PageSpec, summary: str = "summary") -> DataFrame:
    """Items of a feed's summary: tags go, and the first url of the text that leads to an order is its link."""
    rows = rows.withColumn("raw_text", summary_text(F.col(summary)))
    found = F.regexp_extract_all(F.col("raw_text"), F.lit(r"https?://[^\s<>\"']+"), F.lit(0))
    return text_items(rows, spec, "raw_text", F.get(F.filter(found, lambda u: u.rlike("(?i)order|cart|client|buy|billing")), 0))
