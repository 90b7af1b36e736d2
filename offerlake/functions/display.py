"""What the cards show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null


def price_label(amount: Column, currency: Column, period: Column) -> Column:
    sign = F.when(currency == "USD", "$").when(currency == "EUR", "€").when(currency == "GBP", "£").otherwise(F.concat(F.coalesce(currency, F.lit("")), F.lit(" ")))
    per = F.when(period == "month", "/mo").when(period == "year", "/yr").otherwise("")
    return F.when(amount.isNull(), "Price on request").otherwise(F.format_string("%s%.2f%s", sign, amount.cast("double"), per))


def ram_label(mb: Column) -> Column:
    return F.when(mb >= 1024, F.concat(F.round(mb / 1024).cast("int").cast("string"), F.lit("GB"))).when(mb > 0, F.concat(mb.cast("string"), F.lit("MB")))


def bandwidth_label(gb: Column) -> Column:
    return F.when(gb == -1, "Unmetered").when(gb > 0, F.concat(gb.cast("string"), F.lit("GB")))


def spec_line(*parts: Column) -> Column:
    return F.concat_ws(" • ", *parts)


def title_label(provider: Column, plan: Column, title: Column) -> Column:
    return F.coalesce(blank_to_null(provider), blank_to_null(plan), F.substring(title, 1, 40))


def link(promo: Column, order: Column, domain: Column) -> Column:
    return F.coalesce(blank_to_null(promo), blank_to_null(order), F.concat(F.lit("https://"), blank_to_null(domain)), F.lit("#"))


def more_plans(items: Column) -> Column:
    return F.when(F.size(items) > 1, F.format_string("+%d more plans", F.size(items) - 1))


def highlights(c: Column) -> Column:
    return F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, 3)


def primary_item(items: Column) -> Column:
    """The first primary item, else the first."""
    return F.coalesce(F.try_element_at(F.filter(items, lambda x: x["is_primary"]), F.lit(1)), F.try_element_at(items, F.lit(1)))


def age_label(at: Column, now: Column) -> Column:
    minutes = (F.unix_timestamp(now) - F.unix_timestamp(at)) / 60
    say = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f" {unit}"), F.when(F.floor(n) == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(at.isNull(), "Recently").when(minutes < 1, "just now").when(minutes < 60, say(minutes, "minute")).when(minutes < 1440, say(minutes / 60, "hour")).otherwise(say(minutes / 1440, "day"))
