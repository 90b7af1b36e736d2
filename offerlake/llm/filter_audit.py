"""What filters do to each other: every order of them, replayed over every document.

``replay`` crosses the documents' flags with all orders (a broadcast of n! rows, 120 for five filters), finds the step at which a
document fails first, explodes the steps and counts by part, order and step. The counts are partial sums within a task first, so a
part that a third of all documents belong to leaves a task as n! times n rows like any other.

``document_flags`` has the five filters of the audit: A short, B repetitive, C upper case, D signs, E a copy. A copy is identical, by
SHA-256, to the text of a smaller id anywhere in the table: the least id of each text is an aggregate, and its join back deals texts with many
copies over several tasks.

A null text is empty, a null part an empty string; labels of a document are 1 where any of its label rows says so. A document without an id has no
labels, is no copy and no original; repeated ids stay separate rows, and equal rows are no copies of each other, having
one id. Ids are of any type that has an order. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import spread_join
from .common import stash

FILTERS = "ABCDE"
MOST_FILTERS = 6


def document_flags(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """doc_id, part, A to E (true: the document fails), good, toxic: a row per row of ``docs``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    n = F.size("words")
    flags = rows.select(
        "doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), (n < 200).alias("A"), (100 * F.size(F.array_distinct("words")) < 50 * n).alias("B"),
        (100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > 2 * F.length("text")).alias("C"), F.col("text").rlike(r"[#$%&*|]").alias("D"),
    )
    flags = stash(flags, "audit-flags")
    texts = stash(flags.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "audit-texts")
    flags = spread_join(flags, texts, ["digest"], "copies", ["doc_id"])
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marks = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return flags.join(said, "doc_id", "left").select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).alias("E"), *marks)


def replay(flags: DataFrame, *, filters: str = FILTERS, part: str = "part", lost: dict[str, str] | None = None) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, a count for each name of ``lost`` (name -> boolean column, counted
    where the step removes), shapley. ``filters``: a letter for each boolean column of ``flags`` that is true where its filter fails; nulls pass.
    """
    n = len(filters)
    if not 1 <= n <= MOST_FILTERS or len(set(filters)) != n:
        raise ValueError(f"1 to {MOST_FILTERS} different filters, not {filters!r}")
    lost = {"good_lost": "good", "toxic_lost": "toxic"} if lost is None else lost
    bit = {f: 1 << k for k, f in enumerate(filters)}
    spark = flags.sparkSession
    table = [(k, "".join(p), [bit[f] for f in p]) for k, p in enumerate(itertools.permutations(filters))]
    orders = spark.createDataFrame(table, "order_id int, filter_order string, bits array<int>")

    fails = sum((F.when(F.col(f), b).otherwise(0) for f, b in bit.items()), F.lit(0))
    docs = flags.select(F.col(part).alias("part"), fails.alias("fails"), *[F.coalesce(F.col(c), F.lit(False)).alias(name) for name, c in lost.items()])
    at = lambda k: F.get("bits", k - 1)
    steps = F.broadcast(orders.select("order_id", *[at(k).alias(f"bit{k}") for k in range(1, n + 1)]))  # n! rows
    first = F.lit(n + 1)
    for k in range(n, 0, -1):
        first = F.when(F.col("fails").bitwiseAND(F.col(f"bit{k}")) != 0, k).otherwise(first)
    crossed = docs.crossJoin(steps).select("part", "fails", *lost, "order_id", first.alias("first"), F.posexplode(F.array(*[F.col(f"bit{k}") for k in range(1, n + 1)])).alias("step", "bit"))
    step, failing = F.col("step") + 1, F.col("fails").bitwiseAND(F.col("bit")) != 0
    count = lambda c: F.sum(F.when(c, 1).otherwise(0).cast("long"))
    gone = F.col("first") == step
    counts = crossed.groupBy("part", "order_id", "step").agg(
        count(F.col("first") > step).alias("kept"), count(gone).alias("removed"), count(failing & (F.col("first") < step)).alias("redundant"),
        count(F.col("fails") == F.col("bit")).alias("unique_fails"), *[count(gone & F.col(name)).alias(name) for name in lost],
    )
    named = counts.join(F.broadcast(orders.select("order_id", "filter_order")), "order_id").withColumn("step", F.col("step") + 1)
    named = stash(named.withColumn("_filter", F.substring("filter_order", F.col("step"), F.lit(1))), "audit-counts")  # n! times n rows a part
    share = named.groupBy("part", "_filter").agg(F.sum("removed").alias("shapley"))
    out = named.join(share, ["part", "_filter"])
    return out.select("part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", *lost, "shapley")


def interactions(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The audit of filters A to E over ``docs``."""
    return replay(document_flags(docs, labels, **columns))
