"""Evaluation: multiset confusion, precision and recall, detection status, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, empty).otherwise(a / b)


def multiset_confusion(expected: DataFrame, found: DataFrame, on: Sequence[str]) -> DataFrame:
    """Per key of the multisets: tp = min, fn = expected - tp, fp = found - tp."""
    e = expected.groupBy(*on).agg(F.count("*").alias("n_expected"))
    d = found.groupBy(*on).agg(F.count("*").alias("n_found"))
    j = e.join(d, list(on), "full_outer").select(
        *on, F.coalesce("n_expected", F.lit(0)).alias("n_expected"), F.coalesce("n_found", F.lit(0)).alias("n_found")
    )
    tp = F.least("n_expected", "n_found")
    return j.withColumns({"tp": tp, "fn": F.col("n_expected") - tp, "fp": F.col("n_found") - tp})


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": safe_ratio(2 * p * r, p + r)}


def set_metrics(df: DataFrame, expected: str, found: str) -> DataFrame:
    """Precision, recall and F1 of two array columns as sets, with what is missing and extra."""
    tp = F.size(F.array_intersect(expected, found))
    extra, missing = F.array_except(found, expected), F.array_except(expected, found)
    return df.withColumns(prf(tp, F.size(extra), F.size(missing)) | {"tp": tp, "missing": missing, "extra": extra})


def detection_status(n: Column, enough: int = 2) -> Column:
    return F.when(n >= enough, "VERIFIED").when(n > 0, "PARTIAL").otherwise("NOT DETECTED")


def names_match(a: Column, b: Column) -> Column:
    """Either name contains the other."""
    return (F.instr(a, b) > 0) | (F.instr(b, a) > 0) if isinstance(b, str) else a.contains(b) | b.contains(a)


def histogram(value: Column, bounds: Sequence[tuple[str, float | None, float | None]]) -> Column:
    """Bucket label: low <= value <= high with open ends; null where no bucket holds the value."""
    out = None
    for label, low, high in bounds:
        test = F.lit(True)
        if low is not None:
            test = test & (value >= low)
        if high is not None:
            test = test & (value <= high)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def distribution(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """min, nearest-rank p25, median and p75, max of each key."""
    from .calibrate import grouped_quartiles

    return grouped_quartiles(df, key, value)
