"""The column functions under names that SQL text can call. Catalyst puts a function's body in place of its call, so a query in SQL text has the plan
that a DataFrame would have, and no Python. Sizes of storage and traffic and absolute urls are not among them: they use lambdas, which Spark doesn't write as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import category, display, money, places, specs, text, urls

#: name -> (builder, parameters with their types, type of the result)
FUNCTIONS: dict[str, tuple[Callable[..., Column], str, str]] = {
    "clean_text": (text.clean_text, "c string", "string"), "fingerprint_text": (text.fingerprint_text, "c string", "string"),
    "offer_price": (money.price, "c string", "double"), "offer_currency": (money.currency, "c string", "string"), "offer_period": (money.billing_period, "c string", "string"),
    "monthly_price": (money.monthly_price, "amount double, period string", "double"),
    "ram_mb": (specs.ram_mb, "c string", "int"), "url_domain": (urls.domain, "c string", "string"),
    "discussion_id": (urls.discussion_id, "c string", "string"), "threads_id": (urls.threads_id, "c string", "string"), "blog_id": (urls.blog_id, "c string", "string"),
    "showthread_id": (urls.showthread_id, "c string", "string"), "listing_id": (urls.listing_id, "c string", "string"),
    "offer_location": (places.location, "c string", "string"), "posted_time": (places.posted_at, "c string", "timestamp"),
    **{f"{site}_category": (lambda c, rules=rules: category.categorize(c, rules), "c string", "string") for site, rules in {"forum_a": category.FORUM_A, "blog": category.BLOG, "forum_b": category.FORUM_B, "forum_c": category.FORUM_C, "listing": category.LISTINGS}.items()},
    "price_label": (display.price_label, "amount double, currency string, period string", "string"), "ram_label": (display.ram_label, "mb int", "string"), "bandwidth_label": (display.bandwidth_label, "gb int", "string"),
}


def body(spark: SparkSession, build: Callable[..., Column], parameters: str) -> str:
    """The builder's expression as SQL text over its parameters."""
    names = [p.split()[0] for p in parameters.split(", ")]
    plan = spark.createDataFrame([], parameters).select(build(*map(F.col, names)).alias("_"))._jdf.queryExecution().analyzed()
    return plan.expressions().head().child().sql()


def register(spark: SparkSession, names: list[str] | None = None) -> list[str]:
    """Make the functions (or some) temporary functions of the session."""
    made = list(FUNCTIONS) if names is None else names
    for name in made:
        build, parameters, kind = FUNCTIONS[name]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body(spark, build, parameters)}")
    return made
