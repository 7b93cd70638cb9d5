"""Scores rolled up from error rows: three named variants, reliability, categories, top reasons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RELIABLE_FROM = 10
MINOR_WEIGHT = 0.5


def weighted_score(major: Column, minor: Column, assessed: Column) -> Column:
    """Verse score: 100 * (1 - (major + minor / 2) / assessed), not below 0; 100 if nothing was assessed."""
    return F.when(assessed == 0, 100.0).otherwise(F.greatest(F.lit(0.0), 100.0 * (1 - (major + MINOR_WEIGHT * minor) / assessed)))


def unclamped_score(major: Column, minor: Column, assessed: Column) -> Column:
    """Chapter score: the same without the floor, at least one assessed."""
    return 100.0 * (1 - (major + MINOR_WEIGHT * minor) / F.greatest(assessed, F.lit(1)))


def passed_share(major: Column, minor: Column, assessed: Column) -> Column:
    """Recording score: the share of assessed that is neither major nor minor."""
    return F.when(assessed == 0, 1.0).otherwise((assessed - major - minor) / assessed)


def reliability(assessed: Column) -> Column:
    return F.when(assessed >= RELIABLE_FROM, "high").otherwise("low")


def severity_counts(df: DataFrame, key: Sequence[str], severity: str = "severity", assessed: Column | None = None) -> DataFrame:
    """key, assessed, errors, major, minor, style."""
    seen = F.count("*") if assessed is None else F.count_if(assessed)
    return df.groupBy(*key).agg(
        seen.alias("assessed"), F.count(severity).alias("errors"),
        *[F.count_if(F.col(severity) == s).alias(s) for s in ("major", "minor", "style")],
    )


def rollup_scores(df: DataFrame, levels: Sequence[str], severity: str = "severity") -> DataFrame:
    """Counts and scores at every level and in total; null marks a total."""
    r = df.rollup(*levels).agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("assessed"),
        *[F.count_if(F.col(severity) == s).alias(s) for s in ("major", "minor", "style")],
    )
    m = F.col("major"), F.col("minor"), F.col("assessed")
    return r.withColumns({"score": weighted_score(*m), "raw_score": unclamped_score(*m), "reliability": reliability(m[2])})


def counts_with_zeros(df: DataFrame, column: str, domain: DataFrame, name: str = "n") -> DataFrame:
    """Counts for every value of a small fixed domain, 0 where none occurs."""
    counts = df.groupBy(column).agg(F.count("*").alias(name))
    return domain.join(counts, column, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def most_common(df: DataFrame, key: Sequence[str], value: str, order: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the first encountered."""
    counts = df.groupBy(*key, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    best = F.max_by(F.struct(value, "n"), F.struct(F.col("n"), -F.col("_first")))
    return counts.groupBy(*key).agg(best.alias("b")).select(*key, "b.*")


def pivot_categories(df: DataFrame, key: Sequence[str], value: str, categories: Mapping[str, Sequence[str]]) -> DataFrame:
    """Counts of each category of values as columns."""
    return df.groupBy(*key).agg(*[F.count_if(F.col(value).isin(*v)).alias(c) for c, v in categories.items()])
