"""Duplicate flags: a post is a duplicate where an earlier one owns a fingerprint of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_flags(prints: DataFrame, *, post: str = "post_id", order: list[str], fingerprint: str = "fingerprint") -> DataFrame:
    """(post, is_duplicate). ``prints``: a row per post and fingerprint, with the columns of ``order``, which
    rank the posts. The least rank per fingerprint is an aggregate, so a hot fingerprint is combined before the shuffle."""
    rank = F.struct(*order, post)
    owner = prints.where(F.col(fingerprint).isNotNull()).groupBy(fingerprint).agg(F.min(rank).alias("_owner"))
    rows = prints.join(owner, fingerprint, "left")
    return rows.groupBy(post).agg(F.coalesce(F.bool_or(F.col("_owner") < rank), F.lit(False)).alias("is_duplicate"))


def seen_before(prints: DataFrame, history: DataFrame, *, post: str = "post_id", fingerprint: str = "fingerprint") -> DataFrame:
    """Posts of which some fingerprint is in the history (semi join)."""
    return prints.join(history.select(fingerprint), fingerprint, "left_semi").select(post).distinct()
