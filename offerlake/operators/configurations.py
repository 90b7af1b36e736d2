"""Offers from extracted JSON: the envelope, its configurations as rows, and what falls back to what."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from .shared import stash

CONFIGURATION = "name string, price double, currency string, billing_period string, cpu_model string, cpu_brand string, cpu_cores int, ram_mb int, storage_gb int, bandwidth_gb int, location string, order_url string, promo_code string, promo_url string"


def unfenced(c: Column) -> Column:
    """Trimmed, without the marks of a code block around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def parsed(c: Column) -> Column:
    """The envelope as a variant; null where it isn't JSON."""
    return F.try_parse_json(unfenced(c))


def valid_deals(rows: DataFrame, envelope: str, *, id_field: str = "id") -> DataFrame:
    """One row per object of ``deals`` that is valid and has an id: the columns of ``rows``, deal_id and deal (a variant)."""
    deals = F.try_variant_get(parsed(F.col(envelope)), "$.deals", "array<variant>")
    out = rows.select("*", F.explode(deals).alias("deal"))
    out = out.withColumn("deal_id", F.try_variant_get("deal", f"$.{id_field}", "string"))
    return out.where(F.coalesce(F.try_variant_get("deal", "$.is_valid", "boolean"), F.lit(False)) & (F.coalesce("deal_id", F.lit("")) != ""))


def _get(v: str, path: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def cpu_label(model: Column, brand: Column, cores: Column) -> Column:
    return F.when(F.coalesce(model, F.lit("")) != "", model).when((F.coalesce(brand, F.lit("")) != "") & (cores > 0), F.format_string("%s %dc", brand, cores)).when(cores > 0, F.format_string("%d cores", cores))


def joined_locations(c: Column) -> Column:
    return F.when(F.size(c) > 0, F.array_join(c, ", "))


def explode_configurations(deals: DataFrame, deal: str = "deal") -> DataFrame:
    """A row per configuration object, with its position. Others than objects are left out but count as positions; position 0
    is primary. An absent currency is USD and an absent period month, a null one stays null."""
    rows = deals.select("*", F.posexplode(F.try_variant_get(deal, "$.configurations", "array<variant>")).alias("position", "_c"))
    rows = rows.where(F.schema_of_variant("_c").startswith("OBJECT"))
    absent = lambda path, default: F.when(F.variant_get("_c", f"$.{path}", "variant").isNull(), default).otherwise(_get("_c", path, "string"))
    cores = _get("_c", "cpu_cores", "int")
    own_place = blank_to_null(_get("_c", "location", "string"))
    locations = F.try_variant_get(deal, "$.locations", "array<string>")
    return rows.select(
        *deals.columns, "position", _get("_c", "name", "string").alias("plan_name"), F.coalesce(_get("_c", "price_amount", "double"), _get("_c", "price", "double")).alias("price_amount"),
        absent("currency", "USD").alias("price_currency"), absent("billing_period", "month").alias("billing_period"),
        cpu_label(_get("_c", "cpu_model", "string"), _get("_c", "cpu_brand", "string"), cores).alias("cpu"), _get("_c", "cpu_brand", "string").alias("cpu_brand"), cores.alias("cpu_cores"),
        *[_get("_c", c, "int").alias(c) for c in ("ram_mb", "storage_gb", "bandwidth_gb")],
        F.coalesce(own_place, joined_locations(locations)).alias("location"), *[_get("_c", c, "string").alias(c) for c in ("order_url", "promo_code", "promo_url")],
        (F.col("position") == 0).alias("is_primary"),
    )


def legacy_item(deals: DataFrame, deal: str = "deal") -> DataFrame:
    """The older shape: ``specs`` with ``price_info`` (of a list the first) gives one primary row."""
    info = F.coalesce(F.try_variant_get(deal, "$.price_info[0]", "variant"), F.try_variant_get(deal, "$.price_info", "variant"))
    rows = deals.withColumn("_p", info).where(F.col("_p").isNotNull() | F.try_variant_get(deal, "$.specs", "variant").isNotNull())
    return rows.select(
        *deals.columns, _get("_p", "amount", "double").alias("price_amount"), F.coalesce(_get("_p", "currency", "string"), F.lit("USD")).alias("price_currency"),
        F.coalesce(_get("_p", "period", "string"), F.lit("month")).alias("billing_period"),
        *[F.try_variant_get(deal, f"$.specs.{c}", "int").alias(c) for c in ("ram_mb", "storage_gb", "bandwidth_gb")], F.lit(True).alias("is_primary"),
    )


def first_filled(*arrays: Column) -> Column:
    """The first array that has elements, else the last."""
    out = arrays[-1]
    for a in reversed(arrays[:-1]):
        out = F.when(F.size(a) > 0, a).otherwise(out)
    return out


def batch_numbers(rows: DataFrame, order: list[str], size: int = 30) -> DataFrame:
    """batch and place in it, by a total order, for rows with any other columns. Global row numbers come from a range
    partitioning and each part's offset, so no single task sees all rows. The parts are written down: planned twice, they
    would be cut at other places."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stash(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "batches")
    counts = dealt.groupBy("_part").count()
    offsets = counts.select(F.col("_part").alias("_p"), (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # one row a partition
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before") - 1
    return dealt.join(F.broadcast(offsets), dealt["_part"] == offsets["_p"]).withColumn("_at", at).withColumns({"batch": F.floor(F.col("_at") / size), "place": F.col("_at") % size}).drop("_part", "_p", "_before", "_at")


#: How many characters of a field reach a prompt, or of a page the extractor.
SUMMARY_CHARS, CONTENT_CHARS, POST_CHARS, PAGE_CHARS = 500, 800, 3000, 8000


def _part(label: str, c: Column, chars: int | None = None) -> Column:
    """A labelled line, cut at ``chars``; null where there is nothing to show."""
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c if chars is None else F.substring(c, 1, chars)))


def prompt_block(number: Column, title: Column, url: Column, summary: Column, content: Column) -> Column:
    """A thread as a block of a prompt; summary and content are cut, a rule ends it."""
    parts = [_part("Title", title), _part("URL", url), _part("Summary", summary, SUMMARY_CHARS), _part("Content", content, CONTENT_CHARS)]
    return F.concat_ws("\n", F.concat(F.lit("Thread "), number.cast("string")), *parts, F.lit("---"))


def post_block(title: Column, content: Column) -> Column:
    """A post by itself, of which more is shown."""
    return F.concat_ws("\n", _part("Title", title), _part("Content", content, POST_CHARS))


ENVELOPES = "batch long, envelope string, error string"


def extracted(threads: DataFrame, extractor: Callable[[list[dict]], str], *, order: list[str], size: int = 30) -> DataFrame:
    """(batch, envelope, error): what a callable answers to each batch of ``size`` threads, in order. It gets dicts of the thread's
    columns and returns JSON text. A batch it fails on has its error in place of an answer, and no other batch is touched."""
    rows = batch_numbers(threads, order, size)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        batch = int(frame["batch"].iloc[0])
        try:
            some = frame.sort_values("place").drop(columns=["batch", "place"]).to_dict("records")
            return pd.DataFrame([(batch, extractor(some), None)], columns=["batch", "envelope", "error"])
        except Exception as e:  # one bad answer must not end the others' job
            return pd.DataFrame([(batch, None, f"{type(e).__name__}: {e}")], columns=["batch", "envelope", "error"])

    return rows.groupBy("batch").applyInPandas(run, ENVELOPES)
