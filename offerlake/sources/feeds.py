"""Feeds and thread lists as rows of discovered threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import category as cat
from ..functions import urls
from ..functions.text import blank_to_null, clean_text
from ..operators.shared import stash

# How many entries of a feed or list are taken.
CAPS = {"forum_a": 100, "blog": 50, "forum_b": 50, "forum_c": 20, "listings": 50}
ITEM = "title string, link string, pubDate string, description string, encoded string"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """RSS items of files, by the built-in XML reader, each with its feed (the file) and its place there."""
    rows = spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", "true").schema(ITEM).load(path)
    return rows.select("*", F.col("_metadata.file_path").alias("feed"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("place"))


def read_feeds(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entries, rejected): feeds read as by ``read_feed``, and a row (feed, error) for every entry that is not well-formed and every file (of any
    bytes) without one entry. Of a file with such an entry those before it are read; other files are read as if it were not there."""
    rows = spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").schema(f"{ITEM}, _corrupt string").option("recursiveFileLookup", "true").load(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("feed"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("place"))
    rows = stash(rows, "feeds")  # read once; what is not well-formed is known only once an entry is parsed as a whole
    bad = rows.where(F.col("_corrupt").isNotNull()).select("feed", F.concat(F.lit("not well-formed: "), F.substring(F.regexp_replace("_corrupt", r"\s+", " "), 1, 200)).alias("error"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("_metadata.file_path").alias("feed"))
    none = files.join(rows.select("feed").distinct(), "feed", "left_anti").select("feed", F.lit("no entries").alias("error"))
    return rows.where(F.col("_corrupt").isNull()).drop("_corrupt"), bad.unionByName(none)


def threads(entries: DataFrame, source: str, as_of: Column, thread_id, categories: tuple) -> DataFrame:
    """Discovered threads of feed entries: titles cleaned, dates or ``as_of``, summary or else content. Of entries that know their
    ``feed`` and ``place`` only the source's first ones (``CAPS``) of each feed are taken."""
    if {"feed", "place"} <= set(entries.columns):
        entries = capped(entries, ["feed"], ["place"], CAPS[source])
    plain = F.regexp_replace("pubDate", r"^\s*[A-Za-z]+,\s*", "")  # without the day's name
    date = F.coalesce(*[F.try_to_timestamp(plain, F.lit(f"d MMM yyyy HH:mm:ss {zone}")) for zone in ("Z", "z")], F.try_to_timestamp("pubDate"), as_of)
    title = clean_text(F.col("title"))
    return entries.select(F.lit(source).alias("source_name"), F.col("link").alias("url"), title.alias("title"), cat.categorize(title, categories).alias("category"), thread_id(F.col("link")).alias("source_thread_id"), date.alias("posted_at"), F.coalesce(blank_to_null(F.col("description")), F.col("encoded")).alias("summary"))


def capped(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group. The filter on row_number becomes a group limit before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


ANCHOR = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """A row per link of a page: position, href and text."""
    found = F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0))
    rows = pages.select(*[c for c in pages.columns if c != html], F.posexplode(found).alias("position", "_a"))
    return rows.withColumns({"href": F.regexp_extract("_a", ANCHOR, 1), "text": clean_text(F.regexp_replace(F.regexp_extract("_a", ANCHOR, 2), "<[^>]*>", ""))}).drop("_a")


def list_threads(lists: DataFrame, as_of: Column, *, forum: str = "forum", category: str = "category", base: str = "url", most: int = CAPS["forum_c"]) -> DataFrame:
    """Threads of forum list pages: the first ``most`` linked rows of each forum, without those that carry no id."""
    rows = anchors(lists).where(F.col("href").rlike(r"/threads?/|showthread|[?&]t=\d"))
    rows = capped(rows, [forum], ["position"], most)
    url = urls.absolute(F.col("href"), F.col(base))
    out = rows.select(F.col(forum).alias("source_name"), url.alias("url"), F.col("text").alias("title"), F.col(category).alias("category"), urls.showthread_id(url).alias("source_thread_id"), as_of.alias("posted_at"))
    return out.where("source_thread_id is not null and url <> ''")


def card_threads(cards: DataFrame, as_of: Column, *, base: str = "url", most: int = CAPS["listings"]) -> DataFrame:
    """Listings of a page's cards (position, href, title): capped first, then cards without a target left out."""
    rows = cards.where(F.col("position") < most).where("href is not null and href <> '' and href <> '/' and not startswith(href, '#')")
    url = urls.absolute(F.col("href"), F.col(base))
    title = F.coalesce(blank_to_null(clean_text(F.col("title"))), F.lit("Server Offer"))
    return rows.select(F.lit("listings").alias("source_name"), url.alias("url"), title.alias("title"), cat.categorize(title, cat.LISTINGS).alias("category"), urls.listing_id(url).alias("source_thread_id"), as_of.alias("posted_at"))
