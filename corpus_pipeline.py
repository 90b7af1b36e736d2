"""Raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns documents, the last one the packed pieces. It works on
all that the stage before kept: documents the quality classifier rejects go; lines that many sites share are cut
(a document of which nothing is left goes); one document of each near-duplicate group stays; contaminated
documents go; what is left is packed.

Null and repeated ids, null and empty texts and empty tables have the results that each operator documents. A document
without an id stays in every filter that its text passes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm.common import stash, table
from offerlake.llm.decontaminate import decontaminate
from offerlake.llm.line_dedup import remove_boilerplate
from offerlake.llm.near_dedup import near_duplicates
from offerlake.llm.packing import pack_documents
from offerlake.llm.quality_classifier import fit, id_remainder, score
from offerlake.llm.queries import tokenizer_path

LEAST_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs, table(spark, sf_dir, "labels"), id_remainder("doc_id", 5) != 0)
    name = "score"
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return score(docs, model, out_col=name).where(F.col(name) >= LEAST_SCORE).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = remove_boilerplate(docs)
    left = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("near_dedup", near), ("decontaminate", clean), ("pack", packed)]
#: The classifier, near-duplicate components and packing are not SQL; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stash(docs, f"pipeline-{name}")
    return docs
