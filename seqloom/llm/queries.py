"""The corpus operators as queries: (spark, table folder) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, importance, infill, jaccard, licenses, lm, mixing, neighbours, pii, separators, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_count_report(table(spark, sf_dir, "documents"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_report(table(spark, sf_dir, "conversations"), spark)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.topk_report(table(spark, sf_dir, "embeddings"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_report(table(spark, sf_dir, "documents"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_report(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_license_scan": op2_license_scan,
    "op3_token_counts": op3_token_counts,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_exact_topk": op5_exact_topk,
    "op6_personal_data": op6_personal_data,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_decontamination": op8_decontamination,
    "op9_source_mixing": op9_source_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}

ORACLES = {
    "op2_license_scan": licenses.oracle(),
    "op5_exact_topk": topk.ORACLE,
    "op7_ngram_jaccard": jaccard.ORACLE,
    "op8_decontamination": decontaminate.ORACLE,
    "op11_importance_resampling": importance.ORACLE,
    "op12_fill_in_middle": infill.ORACLE,
    "op13_nearest_neighbours": neighbours.ORACLE,
}
