"""Robust baselines: nearest-rank quartiles, IQR filter, pooled median with a default.

Values of a group are gathered in one sorted array only where a group is known to be
small (a recording); quantiles of unbounded groups use ``percentile`` style windows or
``percentile_approx`` instead (``grouped_quartiles``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_UNIT_MS = 107.0
DEFAULT_TOLERANCE = 1.6
LEAST = 5
SHORT_BAND = (50.0, 300.0)


def rank_quartile(values: Column, numerator: int) -> Column:
    """Element at index ``numerator * n / 4`` (whole division) of a sorted array; null if empty."""
    return F.get(values, F.floor(F.size(values) * numerator / 4).cast("int"))


def iqr_filter(values: Column, k: float = 1.5) -> Column:
    """Values within k quartile ranges of the nearest-rank quartiles; fewer than four pass as they are."""
    s = F.array_sort(values)
    q1, q3 = rank_quartile(s, 1), rank_quartile(s, 3)
    low, high = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
    return F.when(F.size(s) < 4, s).otherwise(F.filter(s, lambda x: (x >= low) & (x <= high)))


def array_median(values: Column) -> Column:
    """Median of an array, mean of the middle two; null if empty."""
    s = F.array_sort(values)
    n = F.size(s)
    half = F.floor(n / 2).cast("int")
    return F.when(n == 0, None).when(n % 2 == 1, F.get(s, half)).otherwise((F.get(s, half - 1) + F.get(s, half)) / 2)


def array_mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def array_stdev(values: Column) -> Column:
    """Sample standard deviation; 0 for one value or none."""
    mean = array_mean(values)
    total = F.aggregate(F.transform(values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 1, F.sqrt(total / (F.size(values) - 1))).otherwise(0.0)


def calibrate(df: DataFrame, key: Sequence[str], value: str, short: Column, long: Column) -> DataFrame:
    """Length of one count for each group from short values and halved long values.

    ``short`` and ``long`` say which rows may serve. Short values are taken in SHORT_BAND and
    IQR-filtered; long values of at least its lower end must exceed the median of those and
    are filtered where four remain; the pool's median counts from ``LEAST`` values on.
    """
    low, high = SHORT_BAND
    v = F.col(value).cast("double")
    g = df.groupBy(*key) if key else df.groupBy()
    lists = g.agg(
        F.array_sort(F.collect_list(F.when(short & (v >= low) & (v <= high), v))).alias("s0"),
        F.array_sort(F.collect_list(F.when(long & (v >= low), v))).alias("m0"),
    )
    lists = lists.withColumn("s", iqr_filter(F.col("s0"))).withColumn("s_median", array_median(F.col("s")))
    gated = F.when(F.size("s") > 0, F.filter("m0", lambda x: x > F.col("s_median"))).otherwise(F.col("m0"))
    lists = lists.withColumn("m1", gated).withColumn("m", iqr_filter(F.col("m1")))
    lists = lists.withColumn("pool", F.concat("s", F.transform("m", lambda x: x / 2)))
    enough = F.size("pool") >= LEAST
    m_median = array_median(F.col("m"))
    return lists.select(
        *key,
        F.when(enough, array_median(F.col("pool"))).otherwise(DEFAULT_UNIT_MS).alias("unit_ms"),
        F.coalesce("s_median", F.lit(0.0)).alias("short_median_ms"), F.coalesce(m_median, F.lit(0.0)).alias("long_median_ms"),
        F.size("s").cast("bigint").alias("n_short"), F.size("m").cast("bigint").alias("n_long"),
        F.when((F.col("s_median") > 0) & m_median.isNotNull(), m_median / F.col("s_median")).otherwise(0.0).alias("ratio"),
        array_stdev(F.col("s")).alias("short_std_ms"), array_stdev(F.col("m")).alias("long_std_ms"),
        (~enough).alias("is_default"), F.when(enough, 1.0).otherwise(DEFAULT_TOLERANCE).alias("tolerance"),
    )


def _within_quartiles(df: DataFrame, key: Sequence[str], value: str, k: float = 1.5) -> DataFrame:
    """``iqr_filter`` for groups of any size, by a ranking window that spills."""
    n, r = F.count("*").over(Window.partitionBy(*key)), F.row_number().over(Window.partitionBy(*key).orderBy(value)) - 1
    rows = df.withColumns({"_n": n, "_r": r})
    at = lambda i: F.max(F.when(F.col("_r") == F.floor(F.col("_n") * i / 4), F.col(value))).over(Window.partitionBy(*key))
    rows = rows.withColumns({"_q1": at(1), "_q3": at(3)})
    reach = k * (F.col("_q3") - F.col("_q1"))
    inside = F.col(value).between(F.col("_q1") - reach, F.col("_q3") + reach)
    return rows.where((F.col("_n") < 4) | inside).drop("_n", "_r", "_q1", "_q3")


def calibrate_any_size(df: DataFrame, key: Sequence[str], value: str, short: Column, long: Column) -> DataFrame:
    """``calibrate`` without arrays of a group's values, for groups of any size: windows and medians."""
    low, high = SHORT_BAND
    v = df.select(*key, F.col(value).cast("double").alias("_v"), short.alias("_s"), long.alias("_l"))
    shorts = _within_quartiles(v.where("_s").where(F.col("_v").between(low, high)).select(*key, "_v"), key, "_v")
    middle = shorts.groupBy(*key).agg(F.median("_v").alias("_m"))
    longs = v.where("_l").where(F.col("_v") >= low).select(*key, "_v").join(middle, list(key), "left")
    longs = _within_quartiles(longs.where(F.col("_m").isNull() | (F.col("_v") > F.col("_m"))).select(*key, "_v"), key, "_v")
    pool = shorts.select(*key, F.lit("s").alias("_k"), "_v").unionByName(longs.select(*key, F.lit("m").alias("_k"), "_v"))
    of = lambda k: F.when(F.col("_k") == k, F.col("_v"))
    g = pool.groupBy(*key).agg(
        F.median(F.coalesce(of("s"), of("m") / 2)).alias("_unit"), F.count("*").alias("_n"), F.median(of("s")).alias("_sm"), F.median(of("m")).alias("_mm"),
        F.count(of("s")).alias("n_short"), F.count(of("m")).alias("n_long"),
    )
    j = df.select(*key).distinct().join(g, list(key), "left")
    enough = F.coalesce("_n", F.lit(0)) >= LEAST
    return j.select(
        *key, F.when(enough, F.col("_unit")).otherwise(DEFAULT_UNIT_MS).alias("unit_ms"), F.coalesce("_sm", F.lit(0.0)).alias("short_median_ms"),
        F.coalesce("_mm", F.lit(0.0)).alias("long_median_ms"), F.coalesce("n_short", F.lit(0)).alias("n_short"), F.coalesce("n_long", F.lit(0)).alias("n_long"),
        (~enough).alias("is_default"), F.when(enough, 1.0).otherwise(DEFAULT_TOLERANCE).alias("tolerance"),
    )


def pooled_unit(df: DataFrame, key: Sequence[str], value: str, eligible: Column, least_ms: float = 30.0) -> DataFrame:
    """The plain estimate for continuous recordings: median of eligible values from ``least_ms`` on."""
    v = F.when(eligible & (F.col(value) >= least_ms), F.col(value).cast("double"))
    g = df.groupBy(*key) if key else df.groupBy()
    return g.agg(F.count(v).alias("n"), F.median(v).alias("m")).select(
        *key, "n", F.when(F.col("n") >= LEAST, F.col("m")).otherwise(DEFAULT_UNIT_MS).alias("unit_ms"), (F.col("n") < LEAST).alias("is_default")
    )


def grouped_quartiles(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Nearest-rank quartiles by a ranking window: exact, spillable, for groups of any size."""
    w = Window.partitionBy(*key).orderBy(value)
    rows = df.where(F.col(value).isNotNull()).withColumns(
        {"_r": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*key))}
    )
    at = lambda k: F.max(F.when(F.col("_r") == F.floor(F.col("_n") * k / 4), F.col(value)))
    return rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.min(value).alias("least"), at(1).alias("q1"), at(2).alias("mid"), at(3).alias("q3"), F.max(value).alias("most")
    )
