"""Joins that leave no hot key to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this part of all rows is dealt over several tasks.
PARTS = 1000


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, by: list[str], *, total: int | None = None, parts: int = PARTS) -> DataFrame:
    """Inner join of ``rows`` with the one row that ``facts`` has for a key; ``size`` is a column of ``facts``, the rows of the key.

    Rows of a key with more than a ``parts``-th of all are dealt by hash of ``by``, and its fact is repeated as often as it has parts.
    Fewer than twice ``parts`` keys can be that large, whatever the tables hold: that bounds the broadcast of their names, and all that
    is repeated. ``facts`` should be a table or cheap to make, since it is read for each of the two. Null keys match nothing.
    """
    if total is None:
        total = facts.agg(F.sum(size)).first()[0] or 0
    unit = max(1, total // parts)
    salts = F.ceil(F.col(size) / unit).cast("int")
    hot = facts.where(F.col(size) > unit).select(*keys, salts.alias("_salts"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*by), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    repeated = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return dealt.join(repeated, [*keys, "_salt"]).drop("_salt")


def split_join(rows: DataFrame, facts: DataFrame, key: str, size: str, *, parts: int = PARTS) -> DataFrame:
    """The same for one key and ``rows`` of which many have no fact: rows of hot keys (fewer than ``parts``) meet their broadcast facts where they are, all others
    by a shuffle, and only rows that have a fact leave a join. Where keys are hot, both tables are read for each of the two."""
    total = facts.agg(F.sum(size)).first()[0] or 0
    unit = max(1, total // parts)
    hot = [r[0] for r in facts.where(F.col(size) > unit).select(key).collect()]
    if not hot:
        return rows.join(facts, key)
    is_hot = F.col(key).isin(hot)
    return rows.where(~is_hot).join(facts.where(F.col(size) <= unit), key).unionByName(rows.where(is_hot).join(F.broadcast(facts.where(F.col(size) > unit)), key))
