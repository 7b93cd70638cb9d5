"""Position context: neighbours, edges, running counts over ordered sequences.

A sequence table has key columns (one sequence per key) and an order that is total within
a key. All windows of a module share one (key, order) specification, so Spark plans a
single exchange and sort for any number of context columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(key: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def whole(key: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return ordered(key, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def with_position(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], name: str = "pos") -> DataFrame:
    """0-based place of each row in its sequence."""
    return df.withColumn(name, (F.row_number().over(ordered(key, order)) - 1).cast("bigint"))


def with_neighbours(
    df: DataFrame, key: Sequence[str], order: Sequence[str | Column], columns: Sequence[str], before: int = 1, after: int = 1
) -> DataFrame:
    """``<column>_p<k>`` and ``<column>_n<k>``: the value k rows before and after, null beyond the ends."""
    w = ordered(key, order)
    new = {f"{c}_p{k}": F.lag(c, k).over(w) for c in columns for k in range(1, before + 1)}
    new |= {f"{c}_n{k}": F.lead(c, k).over(w) for c in columns for k in range(1, after + 1)}
    return df.withColumns(new)


def with_edges(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``is_first`` and ``is_last`` of the sequence."""
    w = ordered(key, order)
    return df.withColumns(
        {"is_first": F.row_number().over(w) == 1, "is_last": F.lead(F.lit(1), 1).over(w).isNull()}
    )


def with_group_edges(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], group: str) -> DataFrame:
    """``starts_group`` and ``ends_group``: the row begins or ends a run of ``group`` (word boundaries)."""
    w = ordered(key, order)
    start = ~F.col(group).eqNullSafe(F.lag(group).over(w)) | (F.row_number().over(w) == 1)
    end = ~F.col(group).eqNullSafe(F.lead(group).over(w)) | F.lead(F.lit(1)).over(w).isNull()
    return df.withColumns({"starts_group": start, "ends_group": end})


def running_count(condition: Column, key: Sequence[str], order: Sequence[str | Column]) -> Column:
    """How often ``condition`` held up to and with this row."""
    w = ordered(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(F.when(condition, 1).otherwise(0)).over(w)


def running_sum(value: Column | str, key: Sequence[str], order: Sequence[str | Column]) -> Column:
    return F.sum(value).over(ordered(key, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def with_time_axis(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], duration: str) -> DataFrame:
    """``xmin`` and ``xmax``: a cumulative time axis from durations."""
    total = running_sum(F.col(duration), key, order)
    return df.withColumn("xmax", total).withColumn("xmin", F.col("xmax") - F.col(duration))


def with_equal_pairs(
    df: DataFrame, key: Sequence[str], order: Sequence[str | Column], symbol: str, value: str, eligible: Column | None = None
) -> DataFrame:
    """Adjacent equal symbols: ``pair`` (first, second or null) and ``pair_total``.

    Where three or more are equal, a row in the middle counts as the second half of the
    pair before it and then as the first half of the pair after it; the later wins.
    """
    w = ordered(key, order)
    fits = F.lit(True) if eligible is None else eligible
    after = fits & F.coalesce(F.col(symbol) == F.lead(symbol).over(w), F.lit(False))
    before = fits & F.coalesce(F.col(symbol) == F.lag(symbol).over(w), F.lit(False))
    return df.withColumns(
        {
            "pair": F.when(after, "first").when(before, "second"),
            "pair_total": F.when(after, F.col(value) + F.lead(value).over(w)).when(before, F.col(value) + F.lag(value).over(w)),
        }
    )


def with_final_trim(
    df: DataFrame, key: Sequence[str], order: Sequence[str | Column], value: str, factor: float = 3.0
) -> DataFrame:
    """A sequence's last value beyond ``factor`` times the mean of the others becomes that mean.

    Adds ``is_final``, ``others_mean`` and ``trimmed`` (null where nothing is trimmed).
    """
    w, all_rows = ordered(key, order), whole(key, order)
    last = F.lead(F.lit(1)).over(w).isNull()
    n = F.count(value).over(all_rows)
    mean = F.when(n > 1, (F.sum(value).over(all_rows) - F.col(value)) / (n - 1))
    df = df.withColumns({"is_final": last, "others_mean": F.when(last, mean)})
    return df.withColumn(
        "trimmed", F.when(F.col("is_final") & (F.col(value) > factor * F.col("others_mean")), F.col("others_mean"))
    )


def neighbour_flag(flag: Column, key: Sequence[str], order: Sequence[str | Column]) -> Column:
    """Whether ``flag`` holds for the row before or after."""
    w = ordered(key, order)
    return F.coalesce(F.lag(flag).over(w), F.lit(False)) | F.coalesce(F.lead(flag).over(w), F.lit(False))


def waterfall(*steps: tuple[Column, str], default: str) -> Column:
    """The label of the first condition that holds."""
    out = None
    for condition, label in steps:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(default) if out is not None else F.lit(default)
