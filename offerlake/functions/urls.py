"""Domains, absolute links and the ids that urls carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null


def domain(c: Column) -> Column:
    """The authority, port included, else the first path segment; one leading ``www.`` goes."""
    authority = F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    first = F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^/?#]*)", 1)
    return blank_to_null(F.regexp_replace(F.when(authority != "", authority).otherwise(first), r"^www\.", ""))


def absolute(c: Column, base: Column) -> Column:
    """RFC 3986 reference resolution against a base url, for http and https; '' and null stay."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    site = F.regexp_extract(base, r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"^[^#]*?(\?[^#]*)", 1)
    folder = F.when(path.contains("/"), F.regexp_replace(path, "[^/]*$", "")).otherwise("/")
    own_path, rest = F.regexp_extract(c, r"^([^?#]*)", 1), F.regexp_extract(c, r"^[^?#]*(.*)$", 1)
    return (
        F.when(F.coalesce(c, F.lit("")) == "", c)
        .when(c.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), c)
        .when(c.startswith("//"), F.concat(scheme, c))
        .when(c.startswith("/"), F.concat(site, plain_path(own_path), rest))
        .when(c.startswith("?"), F.concat(site, path, c))
        .when(c.startswith("#"), F.concat(site, path, query, c))
        .otherwise(F.concat(site, plain_path(F.concat(folder, own_path)), rest))
    )


def plain_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; one that has none stays as it is."""
    parts = F.split(path, "/", -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.array_append(done, x)))
    ends = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(F.array_join(kept, "/"), ends)).otherwise(path)


def _first(c: Column, *patterns: str) -> list[Column]:
    return [blank_to_null(F.regexp_extract(c, p, 1)) for p in patterns]


def discussion_id(c: Column) -> Column:
    return F.coalesce(*_first(c, r"/discussion/(\d+)"), c)


def threads_id(c: Column) -> Column:
    return F.coalesce(*_first(c, r"/threads/[^/]+\.(\d+)/?"), c)


def blog_id(c: Column) -> Column:
    """``?p=N``, else the last segment of the path, else the url."""
    path = F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return F.coalesce(*_first(c, r"[?&]p=(\d+)"), blank_to_null(F.regexp_extract(path, r"([^/]+)/*$", 1)), c)


def showthread_id(c: Column) -> Column:
    return F.coalesce(*_first(c, r"[?&]t=(\d+)", r"\.(\d+)/?", r"/(\d+)/?"))


def listing_id(c: Column) -> Column:
    """A server's segment, else a last number, else twelve digits of an MD5: the same at scan and parse."""
    return F.coalesce(*_first(c, r"/server/([^/]+)", r"/(\d+)/?$"), F.substring(F.md5(c.cast("binary")), 1, 12))


def listing_page_id(c: Column) -> Column:
    """The parse side's own rule, where parity with it is wanted: it knows no server segment."""
    return F.coalesce(*_first(c, r"/(\d+)/?$"), F.substring(F.md5(c.cast("binary")), 1, 12))
