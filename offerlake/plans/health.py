"""Freshness of what was ingested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STALE_HOURS, RECENT_HOURS = 2, 24


def freshness(posts: DataFrame, as_of: Column, created: str = "created_at") -> DataFrame:
    """One row: latest, recent (rows of the last day) and status: ok, stale, or no_data. ``as_of`` is constant."""
    latest = F.max(created)
    recent = F.count_if(F.col(created) >= as_of - F.expr(f"INTERVAL {RECENT_HOURS} HOURS"))
    out = posts.agg(latest.alias("latest"), recent.alias("recent"))
    age = as_of - F.expr(f"INTERVAL {STALE_HOURS} HOURS")
    return out.withColumn("status", F.when(F.col("latest").isNull(), "no_data").when(F.col("latest") < age, "stale").otherwise("ok"))


def batch_counters(rows: DataFrame, valid: Column, ingested: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("discovered"), F.count_if(valid).alias("valid"), F.count_if(~valid).alias("rejected"), F.count_if(ingested).alias("ingested"))
