"""Removal of lines that many sites share, with DataFrame operations only.

A line (text between ``\\n``, trimmed of blanks, tabs and returns) is named by two 64-bit hashes. Each line's sites are
counted by HyperLogLog sketches that merge in the aggregation. Estimates within ``MARGIN`` of the threshold are
replaced by exact distinct counts, so the set of boilerplate lines is that of exact counting unless a sketch errs by more
than the margin, several times its standard error (and small sketches are exact). A boilerplate line
stays where it occurs first, by (doc_id, place), and goes everywhere else.

Counts are aggregated before any shuffle; a hot line is one row per task, and where its rows are joined with what is known of it they
are dealt over several tasks. Only hashes and places are exploded; text moves
once, to be joined with the places to cut.

Blank lines are never boilerplate; a null source is no site; a null text stays null with no lines. Rows that
repeat id and text share a fate. An empty table gives no rows. Columns of ``docs`` are kept, with ``n_lines`` and
``n_removed`` added in place of any such columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import spread_join
from .common import stash

SITES = 10
LG_K = 12
MARGIN = 0.15


def boilerplate(docs: DataFrame, *, sites: int = SITES, lg_k: int = LG_K, margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """h1, h2 and n (how often it occurs) of each boilerplate line, with the id (first_id) and place (first_pos) that keep it."""
    lines = line_rows(docs, id_col, text_col, F.xxhash64(F.col(site_col).cast("string")), F.col(site_col).isNotNull())
    site = F.when(F.col("known"), F.col("site"))
    seen = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg(site, lg_k).alias("sketch"), F.min(F.struct("id", "pos")).alias("first"), F.count("*").alias("n"))
    seen = seen.select("h1", "h2", "n", "first", F.hll_sketch_estimate("sketch").alias("about"))
    low, high = sites * (1 - margin) - 1, sites * (1 + margin) + 1
    seen = stash(seen.where(F.col("about") >= low), "line-spread")
    near = seen.where(F.col("about") <= high).select("h1", "h2", "n")
    exact = spread_join(lines, near, ["h1", "h2"], "n", ["key", "pos"]).groupBy("h1", "h2").agg(F.countDistinct(site).alias("exactly"))
    found = seen.where(F.col("about") > high).unionByName(seen.where(F.col("about") <= high).join(exact.where(F.col("exactly") >= sites).select("h1", "h2"), ["h1", "h2"], "left_semi"))
    return stash(found.select("h1", "h2", "n", F.col("first.id").alias("first_id"), F.col("first.pos").alias("first_pos")), "line-boilerplate")


def line_rows(docs: DataFrame, id_col: str, text_col: str, site, known) -> DataFrame:
    """id, key, site, known, pos, h1, h2 of every line that is not blank."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), site.alias("site"), known.alias("known"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    line = F.trim(F.col("line"), F.lit(" \t\r"))
    rows = rows.select("id", "key", "site", "known", "pos", line.alias("line")).where("line <> ''")
    return rows.select("id", "key", "site", "known", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def remove_boilerplate(docs: DataFrame, *, sites: int = SITES, lg_k: int = LG_K, margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines cut from the text, and n_lines (before) and n_removed."""
    found = boilerplate(docs, sites=sites, lg_k=lg_k, margin=margin, id_col=id_col, text_col=text_col, site_col=site_col)
    lines = line_rows(docs, id_col, text_col, F.lit(0), F.lit(True)).select("id", "key", "pos", "h1", "h2")
    cut = spread_join(lines, found, ["h1", "h2"], "n", ["key", "pos"]).where(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("pos") == F.col("first_pos"))))
    cut = cut.groupBy("id", "key").agg(F.collect_set("pos").alias("cut"))
    # the documents' own columns travel in a struct, so that none of them can clash with these
    docs = docs.drop("n_lines", "n_removed")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("own"), F.xxhash64(text_col).alias("own_key"))
    rows = rows.join(cut, F.col("id").eqNullSafe(F.col("own")) & (F.col("key") == F.col("own_key")), "left")
    text, gone = F.col("doc")[text_col], F.coalesce(F.col("cut"), F.array().cast("array<int>"))
    lines_of = F.split(text, "\n", -1)
    n = F.when(text.isNull(), 0).otherwise(F.size(lines_of))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines_of) - 1), F.col("cut"))
    # the lines are bound once, so that they aren't split again for each place
    kept = F.element_at(F.transform(F.array(lines_of), lambda parts: F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")), 1)
    out = rows.select(*[F.when(F.col("cut").isNull(), text).otherwise(kept).alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns], n.cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_removed"))
    return out
