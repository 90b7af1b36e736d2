"""The offers query: filter posts and their items, count, order, page, then attach what a page shows.

Filters are put where Catalyst can push them: post predicates and the needed columns reach the scan, item predicates are
applied before items are grouped. Without item filters, or with them as a semi join, the page is cut from post
keys alone; only its posts then meet their items and source, so neither join sees the whole table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import contains_any_case

# Fields that a query may sort by, and their direction.
SORTS = {"posted_at": "desc", "created_at": "desc", "title": "asc"}
MOST_PAGE = 100


@dataclass
class Columns:
    """Names of the columns that take part, so that any pair of tables can be queried."""

    post_id: str = "id"
    item_post: str = "post_id"
    duplicate: str | None = "is_duplicate"
    category: str = "category"
    source: str = "source_id"
    source_name: str = "source_name"
    text: list[str] = field(default_factory=lambda: ["title", "raw_text"])
    price: str = "price_monthly"
    currency: str = "price_currency"
    period: str = "billing_period"
    location: str = "location"


@dataclass
class OffersQuery:
    """Parameters; what is None or '' does not filter. A price bound of 0 does."""

    page: int = 1
    page_size: int = 20
    category: str | None = None
    source: str | None = None
    search: str | None = None
    billing_period: str | None = None
    currency: str | None = None
    location: str | None = None
    min_price: float | None = None
    max_price: float | None = None
    include_duplicates: bool = False
    sort: str = "posted_at"
    columns: Columns = field(default_factory=Columns)
    sorts: dict[str, str] = field(default_factory=lambda: dict(SORTS))

    def __post_init__(self) -> None:
        if self.page < 1 or not 1 <= self.page_size <= MOST_PAGE:
            raise ValueError(f"page must be 1 or more, page_size 1 to {MOST_PAGE}")
        if any(p is not None and p < 0 for p in (self.min_price, self.max_price)):
            raise ValueError("prices must be 0 or more")
        if self.sort not in self.sorts:
            self.sort = next(iter(self.sorts))

    def post_filter(self) -> Column:
        c, out = self.columns, F.lit(True)
        if c.duplicate and not self.include_duplicates:
            out = out & ~F.col(c.duplicate)
        if self.category:
            out = out & (F.col(c.category) == self.category)
        if self.source:
            out = out & (F.col(c.source) == self.source)
        if self.search:
            found = F.lit(False)
            for name in c.text:
                found = found | contains_any_case(F.col(name), self.search)
            out = out & found
        return out

    def item_filter(self) -> Column | None:
        c, parts = self.columns, []
        if self.billing_period:
            parts.append(F.col(c.period) == self.billing_period)
        if self.currency:
            parts.append(F.col(c.currency) == self.currency.upper())
        if self.location:
            parts.append(contains_any_case(F.col(c.location), self.location))
        if self.min_price is not None:
            parts.append(F.col(c.price) >= self.min_price)
        if self.max_price is not None:
            parts.append(F.col(c.price) <= self.max_price)
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out

    def matching(self, posts: DataFrame, items: DataFrame) -> DataFrame:
        """Posts that pass, at least one item matching where items are filtered."""
        out, wanted = posts.where(self.post_filter()), self.item_filter()
        if wanted is None:
            return out
        keys = items.where(wanted).select(F.col(self.columns.item_post).alias("_k"))
        return out.join(keys, F.col(self.columns.post_id) == F.col("_k"), "left_semi")

    def total(self, posts: DataFrame, items: DataFrame) -> DataFrame:
        return self.matching(posts, items).agg(F.count("*").alias("total"))

    def order(self) -> list[Column]:
        by = F.col(self.sort)
        return [by.desc() if self.sorts[self.sort] == "desc" else by.asc(), F.col(self.columns.post_id).asc()]

    def page_posts(self, posts: DataFrame, items: DataFrame) -> DataFrame:
        """The page's posts, by one top-k with an offset."""
        return self._page_of(self.matching(posts, items))

    def _page_of(self, matching: DataFrame) -> DataFrame:
        return matching.orderBy(*self.order()).offset((self.page - 1) * self.page_size).limit(self.page_size)

    def page_nested(self, posts: DataFrame, items: DataFrame, sources: DataFrame | None = None) -> DataFrame:
        """The page's posts as they are shown, each with its (matching) items as an array and its source as a struct, in order.

        The page is read once: its rows, ``MOST_PAGE`` at most and without what is hidden, come to the driver, and their keys are a filter that
        reaches the scan of items.
        """
        return self._nested(shown(self.page_posts(posts, items)), posts, items, sources)

    def page_and_total(self, posts: DataFrame, items: DataFrame, sources: DataFrame | None = None) -> tuple[DataFrame, int]:
        """``page_nested`` and ``total`` from one pass: what matches is counted while the page is picked from it."""
        counted = Observation()
        matching = self.matching(posts, items).observe(counted, F.count("*").alias("total"))
        nested = self._nested(shown(self._page_of(matching)), posts, items, sources)
        return nested, counted.get["total"]

    def _nested(self, found: DataFrame, posts: DataFrame, items: DataFrame, sources: DataFrame | None) -> DataFrame:
        wanted, c = self.item_filter(), self.columns
        rows = found.collect()
        page = posts.sparkSession.createDataFrame(rows, found.schema)
        own = items.where(F.col(c.item_post).isin([r[c.post_id] for r in rows]))
        out = with_items(page, own if wanted is None else own.where(wanted), c)
        if sources is not None:
            out = with_source(out, sources, self.columns)
        return out.orderBy(*self.order())


def with_items(posts: DataFrame, items: DataFrame, columns: Columns | None = None, name: str = "items", *, narrow: bool = False) -> DataFrame:
    """Left outer join to the array of each post's items, in a stable order; none give an empty array. ``narrow``: where few of
    the items belong to these posts, a semi join leaves out the others before they are grouped."""
    c = columns or Columns()
    rest = [x for x in items.columns if x != c.item_post]
    own = items.join(posts.select(F.col(c.post_id).alias("_k")), F.col(c.item_post) == F.col("_k"), "left_semi") if narrow else items
    grouped = own.groupBy(F.col(c.item_post).alias("_k")).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))
    out = posts.join(grouped, F.col(c.post_id) == F.col("_k"), "left").drop("_k")
    return out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))


def with_source(posts: DataFrame, sources: DataFrame, columns: Columns | None = None, key: str = "name") -> DataFrame:
    """Left outer join to the source by name, as a struct; null where there is none. Sources are a dimension of a few rows;
    its size decides how Spark joins it."""
    c = columns or Columns()
    source = sources.select(F.col(key).alias("_s"), F.struct(*sources.columns).alias("source"))
    return posts.join(source, F.col(c.source_name) == F.col("_s"), "left").drop("_s")


def envelope(total: int, page: int, page_size: int) -> dict:
    return {"total": total, "page": page, "page_size": page_size, "pages": max(1, math.ceil(total / page_size))}


def responses(nested: DataFrame, total: int, page: int, page_size: int) -> DataFrame:
    """A page as JSON text: a row for each post of it, in order, within its envelope. ``nested`` is one page (``page_nested``)."""
    head = envelope(total, page, page_size)
    keys = [F.lit(head[k]).alias(k) for k in ("total", "page", "page_size", "pages")]
    return nested.select(F.to_json(F.struct(*keys, F.struct(*nested.columns).alias("item")), {"ignoreNullFields": "false"}).alias("json"))


def pages_of(total: Column, page_size: int) -> Column:
    return F.greatest(F.ceil(total / page_size), F.lit(1)).cast("long")


HIDDEN = ["canonical_url", "raw_html", "raw_text", "metadata", "llm_metadata"]


def shown(posts: DataFrame) -> DataFrame:
    """Posts as they are shown: metadata lifted, heavy and internal columns dropped. Metadata is a variant, read by path, or a struct; a post without
    any has null names and no highlights."""
    for name in ("llm_metadata", "metadata"):
        if name not in posts.columns:
            continue
        if posts.schema[name].dataType.simpleString() == "variant":
            of = lambda field, kind, m=name: F.try_variant_get(m, f"$.{field}", kind)
        else:
            of = lambda field, kind, m=name: F.col(f"{m}.{field}")
        empty = F.array().cast("array<string>")
        posts = posts.withColumns({"provider_name": of("provider_name", "string"), "provider_domain": of("provider_domain", "string"), "highlights": F.coalesce(of("highlights", "array<string>"), empty)})
        break
    return posts.drop(*HIDDEN)


def detail(posts: DataFrame, items: DataFrame, sources: DataFrame, post_id, columns: Columns | None = None, most_items: int = 100) -> DataFrame:
    """One post with its source and up to ``most_items`` items; no row for an unknown id."""
    c = columns or Columns()
    one = posts.where(F.col(c.post_id) == F.lit(post_id))
    own = items.where(F.col(c.item_post) == F.lit(post_id))
    out = with_source(with_items(one, own, c), sources, c)
    return shown(out.withColumn("items", F.slice("items", 1, most_items)))


def distinct_values(table: DataFrame, column: str) -> DataFrame:
    """Distinct values that are neither null nor ''."""
    return table.select(column).where(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).distinct()


def counts_by(table: DataFrame, column: str, *, keep_empty: bool = False) -> DataFrame:
    rows = table if keep_empty else table.where(F.col(column).isNotNull() & (F.col(column).cast("string") != ""))
    return rows.groupBy(F.col(column).cast("string").alias("key")).agg(F.count("*").alias("n"))


def stats(posts: DataFrame, columns: Columns | None = None) -> DataFrame:
    """(metric, key, n): all, active (not duplicates), and active ones by category and by source. One scan: the
    grouping sets share it."""
    c = columns or Columns()
    active = ~F.col(c.duplicate) if c.duplicate else F.lit(True)
    rows = posts.select(active.alias("active"), F.col(c.category).cast("string").alias("category"), F.col(c.source_name).cast("string").alias("source"))
    found = rows.groupingSets([["active"], ["active", "category"], ["active", "source"]], "active", "category", "source").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    # grouping_id has a bit for each column left out: 3 by activity alone, 1 by category, 2 by source
    kinds = found.select(F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "by_category").otherwise("by_source").alias("metric"), F.when(F.col("g") == 1, F.col("category")).when(F.col("g") == 2, F.col("source")).alias("key"), "active", "n")
    total = kinds.where("metric = 'total'")
    both = total.select(F.explode(F.array(F.lit("total_deals"), F.lit("total_active"))).alias("metric"), "active", "n").groupBy("metric").agg(F.sum(F.when((F.col("metric") == "total_deals") | F.col("active"), F.col("n")).otherwise(0)).alias("n"))
    return both.select("metric", F.lit(None).cast("string").alias("key"), "n").unionByName(kinds.where("metric <> 'total' and active and coalesce(key, '') <> ''").select("metric", "key", "n"))


def flattened(nested: DataFrame, columns: Columns | None = None, *, nullish: bool = False) -> DataFrame:
    """A row per post and item; posts without items go. An item's provider falls back to the post's, where it is null, or ''
    too unless ``nullish``."""
    c = columns or Columns()
    rows = nested.select("*", F.posexplode("items").alias("position", "item"))
    return rows.withColumn("card_id", F.concat_ws("-", F.col(c.post_id).cast("string"), F.col("position").cast("string")))


def filled(item: Column, post: Column, *, nullish: bool = False) -> Column:
    return F.coalesce(item, post) if nullish else F.coalesce(F.nullif(item, F.lit("")), post)
