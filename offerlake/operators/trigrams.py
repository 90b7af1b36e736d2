"""Literal search by a trigram index: lists of ids for every run of three characters, in a keyed table of a ``Store``.

A term's rarest trigrams give candidates, whose texts are then looked up by id and tested as a whole; so a search reads the lists of a few trigrams
and the buckets of its candidates, not the texts. Case is folded as the offers query folds it. A term of fewer than three characters has no trigram: it
is searched for in all texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any_case
from .tables import Store

#: How many of a term's trigrams are looked up: the rarest.
LOOKED_UP = 3
#: Candidates that are looked up by the buckets of their ids; beyond, the join reads all buckets.
MOST_CANDIDATES = 100_000


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of the lower-cased text; one pass, whatever its length."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?s)(?=(...))"), F.lit(1)))


class TextIndex:
    """The tables ``name`` (texts by id), ``name-grams`` (trigram, id) and ``name-counts``. Null texts hold nothing; ids are unique."""

    def __init__(self, store: Store, name: str, id_col: str, text_cols: list[str]) -> None:
        self.store, self.name, self.id, self.texts = store, name, id_col, text_cols

    def build(self, rows: DataFrame) -> None:
        self.store.create(self.name, rows.select(self.id, *self.texts), [self.id])
        runs = F.array_distinct(F.flatten(F.array(*[trigrams(F.col(c)) for c in self.texts])))
        grams = rows.select(F.col(self.id).alias("id"), F.explode(runs).alias("gram"))
        self.store.create(f"{self.name}-grams", grams, ["gram"])
        self.store.create(f"{self.name}-counts", self.store.state(f"{self.name}-grams").groupBy("gram").count(), ["gram"])

    def _few(self, term: str) -> list[str] | None:
        """The term's rarest trigrams; None if one of them is in no text."""
        spark = self.store.spark
        grams = spark.range(1).select(F.explode(trigrams(F.lit(term))).alias("gram"))
        buckets = self.store.buckets_of(grams, ["gram"])
        all_of_them = [r.gram for r in grams.collect()]
        counts = {r.gram: r["count"] for r in self.store.state(f"{self.name}-counts", buckets).where(F.col("gram").isin(all_of_them)).collect()}
        if len(counts) < len(all_of_them):
            return None
        return sorted(counts, key=lambda g: (counts[g], g))[:LOOKED_UP]

    def candidates(self, grams: list[str]) -> DataFrame:
        """Ids of texts that hold all of some trigrams."""
        spark = self.store.spark
        named = spark.createDataFrame([(g,) for g in grams], "gram string")
        lists = self.store.state(f"{self.name}-grams", self.store.buckets_of(named, ["gram"])).where(F.col("gram").isin(grams))
        return lists.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select(F.col("id").alias(self.id))

    def search(self, term: str) -> DataFrame:
        """id and texts of rows of which a text holds the term, in any case."""
        found = lambda rows: rows.where(F.greatest(*[contains_any_case(F.col(c), term) for c in self.texts], F.lit(False)))
        if len(term) < 3:
            return found(self.store.state(self.name))
        grams = self._few(term)
        if grams is None:
            return self.store.state(self.name).limit(0)
        some = self.candidates(grams)
        buckets = self.store.buckets_of(some.limit(MOST_CANDIDATES + 1), [self.id]) if some.limit(MOST_CANDIDATES + 1).count() <= MOST_CANDIDATES else None
        return found(self.store.state(self.name, buckets).join(some, self.id, "left_semi"))
