"""Prices, currencies and billing periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols in the order they are looked for, the known codes, and the words of each billing period.
SYMBOLS = [("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR")]
CODES = "USD|EUR|GBP|CAD|AUD|JPY|INR|CNY|SGD"
MONTH = r"/mo\b|/month\b|monthly|per month"
YEAR = r"/yr\b|/year\b|yearly|annually|per year|/annum"
ONCE = r"one.?time|lifetime|once"


def price(c: Column) -> Column:
    """Null on '' and null; the word *free* is 0; commas go, then the first number counts."""
    number = F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(F.nullif(c, F.lit("")).isNull(), None).when(c.rlike(r"(?i)\bfree\b"), F.lit(0.0)).otherwise(number)


def currency(c: Column) -> Column:
    """A symbol's code, else the first known code as a word, else USD; null on '' and null."""
    out = F.when(F.nullif(c, F.lit("")).isNull(), None)
    for symbol, code in SYMBOLS:
        out = out.when(F.contains(c, F.lit(symbol)), code)
    code = F.upper(F.regexp_extract(c, rf"(?i)\b({CODES})\b", 1))
    return out.when(code != "", code).otherwise("USD")


def billing_period(c: Column) -> Column:
    low = F.lower(c)
    return F.when(F.nullif(c, F.lit("")).isNull(), None).when(low.rlike(MONTH), "month").when(low.rlike(YEAR), "year").when(low.rlike(ONCE), "one_time").otherwise("month")


def monthly_price(amount: Column, period: Column) -> Column:
    """Half-even at two digits for yearly prices; one-time and unknown periods have none."""
    return F.when(period == "month", amount).when(period == "year", F.bround(amount / 12, 2))
