"""Corpus preparation in five stages, each written as Parquet and read as the next one's input.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns
what it keeps. All but the last return the columns of ``documents``; the last returns
the mix: the documents that are taken, their columns, and how often.

A row is a document of its own in every stage: rows without a doc_id, or of one doc_id with
different texts, are kept and dropped by their texts. Null and empty texts pass all stages
but the mix, which takes no words from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import common, decontaminate, jaccard, mixing, pii, toxicity
from seqloom.llm.queries import table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from labels of ``docs``."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones: that of the smallest doc_id (null last), then of
    the smallest hash of its text. Rows without words link with nothing and stay.

    Rows are numbered and written once, and the join works on numbers, so rows that share a
    doc_id are told apart.
    """
    rows = common.cut(docs.withColumn("_row", F.monotonically_increasing_id()))
    numbered = rows.select(F.col("_row").alias("doc_id"), "text")
    found = jaccard.jaccard_components(numbered).where("component_id IS NOT NULL")
    order = rows.select(F.col("_row").alias("_r"), F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"))
    ranked = common.cut(order.join(found.select(F.col("doc_id").alias("_f"), "component_id"), F.col("_r") == F.col("_f")).drop("_f"))
    best = ranked.groupBy("component_id").agg(F.min(F.struct("none", "doc_id", "hash", "_r"))["_r"].alias("_best"))
    lost = common.cut(ranked.select("_r").join(best.select("_best"), F.col("_r") == F.col("_best"), "left_anti"))
    return common.with_keys(rows, "_row", lost, "left_anti").drop("_row")


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark text occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows."""
    return pii.redact(docs, pii.fit(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, their columns beside the number of copies."""
    return mixing.mix(docs).where("copies > 0")


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard", without_near_copies),
    ("decontamination", without_benchmarks),
    ("personal_data", without_personal_data),
    ("source_mixing", mixed),
]

#: Trained models and sampling are not SQL; tests/llm/test_stages.py holds each stage and run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = common.scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
