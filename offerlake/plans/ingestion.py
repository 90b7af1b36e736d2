"""Ingestion from fetched threads and extracted offers to posts, items and fingerprints, as the offers query reads them.

Threads of enabled sources join offers by thread id, known urls go, pages are read by their site's rules, an offer's configurations go before
the page's own items, fingerprints are made and looked up, and the batch is appended. Where a page is missing, a site's feed summary stands in
for it; without that, or where a page can't be read, the thread becomes a row of ``rejected`` with its error, stops no other, and is tried again
when a later batch has it. Every step is a plan over the whole batch; of the history the buckets of the batch's keys and fingerprints are read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.money import monthly_price
from ..functions.text import blank_to_null
from ..functions.urls import domain
from ..operators.configurations import PAGE_CHARS, explode_configurations, extracted, valid_deals
from ..operators.fingerprints import fuzzy_fingerprint, strict_fingerprint
from ..operators.shared import dealt, stash, unstash
from ..operators.tables import Store
from ..schema import FINGERPRINTS, ITEMS, KEYS, POSTS, REJECTED, THREADS, names
from ..sources import pages
from ..streaming.ingest import flagged, fresh

POST_KEYS = KEYS["posts"]
#: Sources that a scan lists at most.
MOST_SOURCES = 100


def thread_id(source: Column, url: Column) -> Column:
    return F.concat(source, F.lit(":"), url)


def source_id(name: Column) -> Column:
    return F.sha1(name.cast("binary"))


def post_id(source: Column, url: Column) -> Column:
    """The same id for the same thread, whichever batch and task makes it."""
    return F.sha1(F.concat_ws("\n", source, url).cast("binary"))


def listed_sources(sources: DataFrame, *, enabled: bool | None = None, most: int = MOST_SOURCES) -> DataFrame:
    """Sources in order of their names, ``most`` at most; all, or those that are enabled or not."""
    rows = sources if enabled is None else sources.where(F.coalesce("enabled", F.lit(False)) == enabled)
    return rows.orderBy("name").limit(most)


def of_enabled(threads: DataFrame, sources: DataFrame) -> DataFrame:
    """Threads of enabled sources (all of them: no cap)."""
    return threads.join(sources.where("enabled").select(F.col("name").alias("source_name")).distinct(), "source_name", "left_semi")


def with_offers(threads: DataFrame, deals: DataFrame) -> DataFrame:
    """Threads that have a valid offer, with it; ``deals`` has deal_id and deal (``configurations.valid_deals``)."""
    best = deals.groupBy("deal_id").agg(F.max(F.to_json("deal")).alias("_d")).select("deal_id", F.parse_json("_d").alias("deal"))
    return threads.join(best, thread_id(F.col("source_name"), F.col("url")) == F.col("deal_id")).drop("deal_id")


def _item_columns(rows: DataFrame) -> DataFrame:
    """The keys, the place and the columns of the items table that are an item's own; those that ``rows`` lacks are null."""
    own = [f.split() for f in ITEMS.split(", ")]
    cols = [(F.col(n) if n in rows.columns else F.lit(None)).cast(kind).alias(n) for n, kind in own if n not in ("post_id", "created_at")]
    return rows.select(*POST_KEYS, "position", *cols)


def offered_items(valid: DataFrame) -> DataFrame:
    """Items of the offers' configurations."""
    text = lambda path: blank_to_null(F.try_variant_get("deal", path, "string"))
    rows = explode_configurations(valid.select("source_name", F.col("url").alias("canonical_url"), "deal"))
    rows = rows.withColumns({"provider_name": text("$.provider_name"), "provider_domain": F.coalesce(text("$.provider_domain"), domain(F.col("order_url"))), "order_url": F.coalesce(text("$.order_url"), F.col("order_url")), "price_monthly": monthly_price(F.col("price_amount"), F.col("billing_period"))})
    return _item_columns(rows)


def read_pages(valid: DataFrame) -> DataFrame:
    """The pages of all sites, each walked once by its site's rules; a source without rules is an error of its row, and so is a
    missing page, unless its site takes summaries and there is one (``by_summary``)."""
    rows = valid.withColumns({"_title": F.col("title"), "raw_html": F.col("html")})
    walked = pages.walk(rows, None, by="source_name", keep=["source_name", "category", "_title", "summary", "deal", "raw_html"])
    missing = F.col("raw_html").isNull() & F.col("error").isNull()
    takes = F.col("source_name").isin([site for site, spec in pages.SPECS.items() if spec.summary]) & (F.coalesce(F.trim("summary"), F.lit("")) != "")
    walked = walked.withColumn("by_summary", missing & takes)
    return walked.withColumn("error", F.when(missing & ~F.col("by_summary"), "the page is missing").otherwise(F.col("error")))


def parsed(walked: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Posts and items of walked pages and summaries (a written table), by the rules of those sites that it has."""
    here = {r.source_name for r in walked.where(F.col("source_name").isin(list(pages.SPECS))).select("source_name").distinct().collect()} or {next(iter(pages.SPECS))}
    posts, items = [], []
    kind = F.coalesce(blank_to_null(F.try_variant_get("deal", "$.deal_type", "string")), blank_to_null(F.col("category")))
    kept = ["source_name", "deal", "raw_html"]

    def add_items(found: DataFrame) -> None:
        items.append(_item_columns(found.withColumn("canonical_url", F.col("url")).withColumn("position", F.col("position") if "position" in found.columns else F.lit(0))))

    for site in sorted(here):
        spec = pages.SPECS[site]
        own = walked.where((F.col("source_name") == site) & F.col("error").isNull())
        read = own.where("not by_summary")
        posts.append(pages.posts(read, spec, as_of, category=kind, feed_title=blank_to_null(F.col("_title")), keep=kept))
        add_items(pages.items(read, spec))
        if spec.summary:
            told = own.where("by_summary")
            posts.append(pages.summary_posts(told, spec, category=kind, title=F.col("_title"), keep=kept))
            add_items(pages.summary_items(told, spec))
    return tuple(reduce(DataFrame.unionByName, x) for x in (posts, items))


def chosen_items(offered: DataFrame, page_items: DataFrame) -> DataFrame:
    """An offer's configurations where a post has any, else the items of its page or summary."""
    return offered.unionByName(page_items.join(offered.select(*POST_KEYS).distinct(), POST_KEYS, "left_anti"))


def fingerprints(posts: DataFrame, items: DataFrame) -> DataFrame:
    """A strict fingerprint for each item with a monthly price, a fuzzy one for each post."""
    with_kind = items.join(posts.select(*POST_KEYS, "category"), POST_KEYS)
    strict = strict_fingerprint(F.col("provider_domain"), F.col("category"), F.col("price_monthly"), F.col("price_currency"), F.col("location"), F.col("ram_mb"), F.col("storage_gb"), F.col("bandwidth_gb"))
    strict = with_kind.where("price_monthly <> 0").select(*POST_KEYS, strict.alias("fingerprint"), F.lit("strict").alias("fingerprint_type")).distinct()
    first = items.groupBy(*POST_KEYS).agg(F.min_by("provider_domain", "position").alias("_domain"))
    fuzzy = dealt(posts, POST_KEYS).join(first, POST_KEYS, "left").select(*POST_KEYS, fuzzy_fingerprint(F.col("title"), F.col("_domain"), F.col("raw_text")).alias("fingerprint"), F.lit("fuzzy").alias("fingerprint_type"))
    return strict.unionByName(fuzzy)


def metadata(deal: Column, as_of: Column) -> Column:
    """What is kept of an offer beside its items, as a variant."""
    of = lambda path, kind="string": F.try_variant_get(deal, f"$.{path}", kind)
    kept = F.struct(of("provider_name").alias("provider_name"), of("provider_domain").alias("provider_domain"), F.coalesce(of("highlights", "array<string>"), F.array().cast("array<string>")).alias("highlights"), of("expires_at").alias("expires_at"), as_of.alias("extracted_at"))
    return F.when(deal.isNotNull(), F.to_variant_object(kept))


def ingest(store: Store, threads: DataFrame, deals: DataFrame, number: int, as_of: Column, *, sources: DataFrame | None = None) -> dict[str, int]:
    """One numbered batch into ``posts``, ``items``, ``fingerprints``, ``owners``, ``seen`` and ``rejected``. Of ``sources`` the enabled ones
    take part. What comes back are the batch's counts (discovered, valid, ingested, rejected), observed while it is written."""
    if sources is not None:
        threads = of_enabled(threads, sources)
    counts = {n: Observation(f"{n}-{number}") for n in ("seen", "walked", "posts")}
    keyed = threads.select(*names(THREADS)).withColumn("canonical_url", F.col("url"))
    new = fresh(keyed, store, "posts", POST_KEYS, ["url"], number)
    read = read_pages(dealt(with_offers(new, deals), ["source_name", "url"]))
    walked = stash(read.observe(counts["walked"], F.count("*").alias("valid"), F.count_if(F.col("error").isNotNull()).alias("rejected")), "ingest-pages")
    posts, page_items = parsed(walked, as_of)
    posts = stash(posts, "ingest-posts")
    items = stash(chosen_items(offered_items(walked), page_items).join(posts.select(*POST_KEYS), POST_KEYS, "left_semi"), "ingest-items")
    prints = stash(fingerprints(posts, items), "ingest-prints")
    strict = prints.where("fingerprint_type = 'strict'")
    rows, owners = flagged(posts, strict, lambda f: store.known("owners", f, ["fingerprint"], number), POST_KEYS, POST_KEYS)
    own_id = post_id(F.col("source_name"), F.col("canonical_url"))
    rows = rows.withColumns({"id": own_id, "source_id": source_id(F.col("source_name")), "last_seen_at": as_of, "llm_metadata": metadata(F.col("deal"), as_of), "created_at": as_of, "updated_at": as_of}).select(*names(POSTS))
    store.append("posts", rows.observe(counts["posts"], F.count("*").alias("ingested")), number, POST_KEYS)
    items_of = items.withColumns({"post_id": own_id, "created_at": as_of})
    store.append("items", items_of.select(*names(ITEMS), "position"), number, ["post_id"])
    store.append("fingerprints", prints.withColumns({"post_id": own_id, "created_at": as_of}).select(*names(FINGERPRINTS)), number, ["post_id"])
    store.append("owners", owners, number, ["fingerprint"])
    seen = threads.select("source_name", F.col("url").alias("canonical_url")).observe(counts["seen"], F.count("*").alias("discovered"))
    store.append("seen", seen.distinct().withColumn("seen_at", as_of), number, POST_KEYS)
    bad = walked.where("error is not null").select("source_name", F.col("url").alias("canonical_url"), "error")
    store.append("rejected", bad.select(*names(REJECTED)), number, POST_KEYS)
    unstash(walked, posts, items, prints)
    return {name: value or 0 for o in counts.values() for name, value in o.get.items()}


def ingest_extracted(store: Store, threads: DataFrame, extractor: Callable[[list[dict]], str], number: int, as_of: Column, *, sources: DataFrame | None = None, size: int = 30) -> dict[str, int]:
    """The same with the extractor before it: threads that are not known yet go to it ``size`` at a time, each with the head of its page; its answers'
    valid offers are ingested. Where it fails on a batch, that batch's threads wait for a later run."""
    if sources is not None:
        threads = of_enabled(threads, sources)
    new = fresh(threads.select(*names(THREADS)).withColumn("canonical_url", F.col("url")), store, "posts", POST_KEYS, ["url"], number)
    asked = new.select(thread_id(F.col("source_name"), F.col("url")).alias("id"), "title", "url", "summary", F.substring("html", 1, PAGE_CHARS).alias("content"))
    answers = stash(extracted(asked, extractor, order=["id"], size=size), "answers")
    out = ingest(store, threads, valid_deals(answers, "envelope").select("deal_id", "deal"), number, as_of)
    unstash(answers)
    return out


__all__ = ["chosen_items", "fingerprints", "ingest", "ingest_extracted", "listed_sources", "of_enabled", "offered_items", "parsed", "post_id", "source_id", "thread_id", "with_offers"]
