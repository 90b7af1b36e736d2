"""A bounded sample of labelled documents, the same whichever way the tables are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: No more labelled documents than this are fitted on; those whose id's hash is least are taken.
MOST_ROWS = 20_000


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, *, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most ``most_rows`` labelled documents, one row an id: of rows that repeat an id the least text counts, a null one
    only where there is no other. Labels other than 0 and 1 are left out. Ids may be of any type."""
    kind = docs.schema[id_col].dataType
    rows = labels.where(allowed & F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast(kind).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)  # at most most_rows pairs of numbers: safe to broadcast
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
