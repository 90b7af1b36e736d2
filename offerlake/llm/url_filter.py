"""URL block decisions with redirect equivalence, with DataFrame operations only.

Rules are (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with the rule's; the
longest fitting rule decides. Pages no rule fits take part in equivalence: urls joined by canonical links and
immediate redirects of pages (``<link rel=canonical>``, ``<meta http-equiv=refresh>``), or that differ in
scheme or fragment only, are aliases. Aliases form connected components (``components.py``); a component with a
blocked url is blocked, unless a rule explicitly allows one of its urls: allow goes before block. A page's own rule
goes before both.

Urls get their component and verdict once each; a url that many pages have, and a component of many urls, are dealt over
several tasks (``spread_join``).

A null url, or one without ``://``, has an empty host and path, fits no rule, is nobody's alias and is allowed. Relative targets are
resolved against the page. Repeated pages stay separate rows; an empty table gives no rows; other columns
are not read. The rules are a parameter of at most ``MOST_RULES``: they become one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import spread_join
from .common import stash
from .components import components

MOST_RULES = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
CANONICAL = r"(?is)<link\b[^>]*?\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?is)\bcontent\s*=\s*[\"']?\s*0*\s*;\s*url\s*=\s*['\"]?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """What aliases that differ in scheme or fragment have in common; null without a host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, F.when(path_of(url) == "", "/").otherwise(path_of(url)), F.regexp_extract(url, URL, 3)))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest becomes the first case
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        which, verdict = F.when(fits, h + p).otherwise(which), F.when(fits, say).otherwise(verdict)
    return which, verdict


def resolved(target: Column, host: Column, path: Column) -> Column:
    """A link's target as a url with ``://``."""
    base = F.concat(F.lit("http://"), host)
    return (
        F.when(target.isNull() | (target == ""), F.lit(None).cast("string"))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(base, target))
        .when(target.rlike(r"^[#?]"), F.concat(base, path, target))
        .otherwise(F.concat(base, F.when(path.contains("/"), F.regexp_replace(path, "[^/]*$", "")).otherwise("/"), target))
    )


def links_of(html: Column) -> Column:
    """Targets of canonical links and immediate redirects. Pages that name neither are not searched further."""
    canonical = F.when(html.rlike("(?i)canonical"), F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), HREF, 1))
    redirect = F.when(html.rlike("(?i)http-equiv"), F.regexp_extract(F.regexp_extract(html, REFRESH, 0), TARGET, 1))
    return F.filter(F.array(canonical, redirect), lambda x: x.isNotNull() & (x != ""))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict and component (the aliases' least url, or null)."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"), links_of(F.col(html_col)).alias("links"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = stash(rows.select("*", rule.alias("rule"), verdict.alias("own")), "url-pages")
    ends = rows.where("node is not null").select("host", "path", F.col("node").alias("u"), F.explode("links").alias("link"))
    ends = ends.select("u", resolved(F.col("link"), F.col("host"), F.col("path")).alias("to")).select("u", node_of(F.col("to")).alias("v"), host_of(F.col("to")).alias("host"), path_of(F.col("to")).alias("path"))
    ends = stash(ends.where("v is not null and u <> v"), "url-edges")
    groups = components(ends.select("u", "v"), name="url-components")
    _, said = rule_of(F.col("host"), F.col("path"), rules)
    # what rules say of any url that is a page or a target; all others can't turn a component
    spoken = rows.where("node is not null and own is not null").select("node", "own").unionByName(ends.select(F.col("v").alias("node"), said.alias("own")).where("own is not null")).distinct()
    placed = spoken.join(groups, "node", "left").select(F.coalesce("component", "node").alias("component"), "own")
    blocked = placed.groupBy("component").agg(F.max((F.col("own") == "allow").cast("int")).alias("allowed")).where("allowed = 0").select("component")
    # a row a url with its pages; a component's blocked urls are found where a row a component says how many it has
    open_pages = rows.where("own is null and node is not null")
    urls = stash(open_pages.groupBy("node").agg(F.count("*").alias("pages")).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "url-nodes")
    sizes = stash(urls.groupBy("component").agg(F.count("*").alias("urls")).join(blocked, "component", "left_semi"), "url-blocked")
    stopped = spread_join(urls.select("node", "component"), sizes, ["component"], "urls", ["node"]).select("node", F.lit(True).alias("blocked"))
    facts = stash(urls.join(stopped, "node", "left"), "url-verdicts")
    open_rows = spread_join(open_pages, facts, ["node"], "pages", ["page_id"])
    open_rows = open_rows.select("page_id", "host", "path", "rule", F.when(F.col("blocked"), "block").otherwise("allow").alias("verdict"), "component")
    ruled = rows.where("own is not null or node is null").select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"), F.col("node").alias("component"))
    return open_rows.unionByName(ruled)
