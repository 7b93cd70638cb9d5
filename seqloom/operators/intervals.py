"""Interval algebra on (key, start, end) tables.

Joins on overlap or containment are made equi-joins by cells of dyadic levels: cells of level l
are ``width * 2 ** l`` long, and an interval lives on the level whose cells are just as long as
itself or longer, so it touches one or two of them whatever its length. A pair meets on the level
of its longer interval: the shorter one is repeated on the levels that the other side has (at
most 64, usually a few), once or twice each. A pair is kept only in the cell where its common part
starts, so it comes once. ``width`` is the length of the finest cells and need not fit the data: it
saves levels where it is near the shortest intervals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .context import ordered

#: Levels beyond the finest at most.
TOP = 63


def _cell(at: Column, level: Column, width: float) -> Column:
    return F.floor(at / (F.lit(float(width)) * F.pow(F.lit(2.0), level)))


def _levelled(df: DataFrame, start: Column, end: Column, width: float) -> DataFrame:
    """``_own``: the finest level of which the interval touches two cells at most. Rows without bounds go."""
    length = F.greatest(end - start, F.lit(0)).cast("double")
    level = F.least(F.greatest(F.ceil(F.log2(length / width)), F.lit(0)), F.lit(TOP))
    level = F.when(length > width, level).otherwise(0).cast("int")
    rows = df.where(start.isNotNull() & end.isNotNull()).withColumn("_own", level)
    # rounding of logarithms
    return rows.withColumn("_own", F.when(_cell(end, F.col("_own"), width) - _cell(start, F.col("_own"), width) > 1, F.col("_own") + 1).otherwise(F.col("_own")))


def _celled(df: DataFrame, start: Column, end: Column, width: float) -> DataFrame:
    """A row for each cell of ``_level`` that the interval touches, one or two."""
    low, high = _cell(start, F.col("_level"), width), _cell(F.greatest(start, end), F.col("_level"), width)
    return df.withColumn("_cell", F.explode(F.array_distinct(F.array(low, high))))


def _on_levels(df: DataFrame, levels: DataFrame, above: bool) -> DataFrame:
    """Each row on the levels of the other side from its own on (``above``: beyond its own)."""
    other = levels.select(F.col("_own").alias("_level")).distinct()  # at most TOP + 2 rows
    fits = F.col("_level") > F.col("_own") if above else F.col("_level") >= F.col("_own")
    return df.join(F.broadcast(other), fits)


def overlap_join(
    left: DataFrame, right: DataFrame, key: Sequence[str], l_start: str, l_end: str, r_start: str, r_end: str, width: float,
    more_than: float = 0.0, how: str = "inner", row: Sequence[str] = (),
) -> DataFrame:
    """Pairs of one key whose common length exceeds ``more_than``; ``how``: inner or left_semi.

    Adds ``overlap`` to inner pairs. ``left_semi`` needs ``row``, columns that tell the left rows of
    a key apart (rows equal in all of them are kept or go together); without them all columns of
    ``left`` do.
    """
    if how == "left_semi":
        same = [*key, *(row or [c for c in left.columns if c not in key])]
        mine = left.select(*dict.fromkeys([*same, l_start, l_end]))
        hit = overlap_join(mine, right.select(*key, r_start, r_end), key, l_start, l_end, r_start, r_end, width, more_than)
        hit = hit.select(*(F.col(c).alias(f"_s{i}") for i, c in enumerate(same))).distinct()
        equal = [left[c].eqNullSafe(hit[f"_s{i}"]) for i, c in enumerate(same)]
        return left.join(hit, equal, "left_semi")
    ls, le, rs, re = (F.col(c) for c in (l_start, l_end, r_start, r_end))
    a, b = _levelled(left, ls, le, width), _levelled(right, rs, re, width)
    low = F.greatest(ls, rs)
    common = F.least(le, re) - low
    on = [*key, "_level", "_cell"]
    a_own, b_own = (_celled(x.withColumn("_level", F.col("_own")), s, e, width).drop("_own") for x, s, e in ((a, ls, le), (b, rs, re)))
    a_up = _celled(_on_levels(a, b, False), ls, le, width).drop("_own")
    b_up = _celled(_on_levels(b, a, True), rs, re, width).drop("_own")
    pairs = a_up.join(b_own, on).unionByName(a_own.join(b_up, on))
    pairs = pairs.where((common > more_than) & (_cell(low, F.col("_level"), width) == F.col("_cell")))
    return pairs.withColumn("overlap", common).drop("_level", "_cell")


def contains_join(
    points: DataFrame, windows: DataFrame, key: Sequence[str], at: str, start: str, end: str, width: float, closed: bool = True
) -> DataFrame:
    """Points inside windows of their key; ``closed``: the end counts as inside."""
    w = _levelled(windows, F.col(start), F.col(end), width)
    p = _on_levels(points.withColumn("_own", F.lit(0)), w, False).withColumn("_cell", _cell(F.col(at), F.col("_level"), width)).drop("_own")
    w = _celled(w.withColumn("_level", F.col("_own")), F.col(start), F.col(end), width).drop("_own")
    upper = F.col(at) <= F.col(end) if closed else F.col(at) < F.col(end)
    return p.join(w, [*key, "_level", "_cell"]).where((F.col(at) >= F.col(start)) & upper).drop("_level", "_cell")


def assign_midpoint(
    items: DataFrame, windows: DataFrame, key: Sequence[str], item: str, mid: Column, start: str, end: str, ordinal: str, width: float
) -> DataFrame:
    """Each item's window: the first (by ``ordinal``) that holds its midpoint in closed bounds,
    otherwise the one of the nearest centre, the earliest on ties; items of a key without windows
    go. ``item`` tells the rows of a key apart.

    Windows that hold a midpoint are found by bins of ``width``, the nearest centres by one walk
    over centres and midpoints in order, so neither side of a key is gathered.
    """
    w = windows.select(*key, F.col(ordinal).alias("_o"), F.col(start).alias("_a"), F.col(end).alias("_b"))
    m = items.withColumn("_m", mid)
    inside = contains_join(m.select(*key, item, "_m"), w, key, "_m", "_a", "_b", width).groupBy(*key, item).agg(F.min("_o").alias("_in"))
    centre = (F.col("_a") + F.col("_b")) / 2
    centres = w.select(*key, centre.cast("double").alias("_at"), F.lit(0).alias("_k"), F.struct(centre.alias("c"), F.col("_o").alias("o")).alias("_w"))
    walk = m.select("*", F.col("_m").cast("double").alias("_at"), F.lit(1).alias("_k")).unionByName(centres, allowMissingColumns=True)
    # of equal centres the earliest is the last before an item, and the first after one
    back = Window.partitionBy(*key).orderBy("_at", "_k", F.desc("_w.o")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*key).orderBy("_at", F.desc("_k"), "_w.o").rowsBetween(1, Window.unboundedFollowing)
    near = walk.withColumns({"_p": F.last("_w", ignorenulls=True).over(back), "_n": F.first("_w", ignorenulls=True).over(ahead)}).where("_k = 1")
    far = lambda c: F.struct(F.abs(F.col("_m") - F.col(f"{c}.c")).alias("d"), F.col(f"{c}.o").alias("o"))
    best = F.array_min(F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), far(c)) for c in ("_p", "_n")])))
    j = near.withColumn("_best", best["o"]).where("_best IS NOT NULL").join(inside, [*key, item], "left")
    return j.select(*items.columns, F.coalesce("_in", "_best").alias("window"), F.col("_in").isNotNull().alias("inside"))


def complement(df: DataFrame, key: Sequence[str], start: str, end: str, order: Sequence[str], total: Column | None = None) -> DataFrame:
    """Gaps before, between and (with ``total``) after intervals that do not overlap.

    key, ordinal, gap_start, gap_end; empty gaps are left out.
    """
    w = ordered(key, order)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumns({"_from": F.coalesce(reach, F.lit(0).cast("double")), "_n": F.row_number().over(w)})
    gaps = rows.select(*key, F.col("_n").alias("ordinal"), F.col("_from").alias("gap_start"), F.col(start).cast("double").alias("gap_end"))
    if total is not None:
        tail = df.groupBy(*key).agg(
            (F.count("*") + 1).cast("int").alias("ordinal"), F.max(end).cast("double").alias("gap_start"), total.cast("double").alias("gap_end")
        )
        gaps = gaps.unionByName(tail)
    return gaps.where("gap_end > gap_start")


def runs(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], flag: Column, least: int = 1) -> DataFrame:
    """Maximal runs of rows where ``flag`` holds (gaps and islands): key, run, first_pos, last_pos, length."""
    w = ordered(key, order)
    rows = df.withColumns({"_pos": F.row_number().over(w), "_on": F.coalesce(flag, F.lit(False))})
    on = rows.where("_on")
    island = F.col("_pos") - F.row_number().over(Window.partitionBy(*key).orderBy("_pos"))
    return (
        on.withColumn("run", island.cast("bigint")).groupBy(*key, "run")
        .agg(F.min("_pos").cast("bigint").alias("first_pos"), F.max("_pos").cast("bigint").alias("last_pos"), F.count("*").alias("length"))
        .where(F.col("length") >= least)
    )


def merge_runs(runs_: DataFrame, key: Sequence[str], gap: int) -> DataFrame:
    """Runs that are at most ``gap`` rows apart become one."""
    w = Window.partitionBy(*key).orderBy("first_pos")
    new = F.col("first_pos") - F.lag("last_pos").over(w) - 1 > gap
    group = F.sum(F.when(F.coalesce(new, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return runs_.withColumn("_g", group).groupBy(*key, "_g").agg(
        F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), F.count("*").alias("parts")
    ).withColumn("length", F.col("last_pos") - F.col("first_pos") + 1).drop("_g")


def longest_run(runs_: DataFrame, key: Sequence[str]) -> DataFrame:
    """The longest run of each key, the first on ties."""
    best = F.max_by(F.struct("first_pos", "last_pos", "length"), F.struct("length", -F.col("first_pos")))
    return runs_.groupBy(*key).agg(best.alias("b")).select(*key, "b.*")


def top_runs_in_order(runs_: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """The n longest runs (earlier first on ties), numbered again in order of position."""
    w = Window.partitionBy(*key).orderBy(F.desc("length"), "first_pos")
    kept = runs_.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
    return kept.withColumn("ordinal", F.row_number().over(Window.partitionBy(*key).orderBy("first_pos")))


def segments_from_splits(splits: DataFrame, key: Sequence[str], at: str, total: DataFrame, length: str, least: float = 0.0) -> DataFrame:
    """Split points -> consecutive segments from 0 to ``total.length``; segments up to ``least`` are dropped."""
    edges = splits.select(*key, F.col(at).cast("double").alias("edge")).unionByName(
        total.select(*key, F.lit(0.0).alias("edge"))
    ).unionByName(total.select(*key, F.col(length).cast("double").alias("edge")))
    w = Window.partitionBy(*key).orderBy("edge")
    spans = edges.distinct().withColumn("end", F.lead("edge").over(w)).where("end IS NOT NULL")
    spans = spans.where((F.col("end") - F.col("edge") > 0) & (F.col("end") - F.col("edge") >= least))
    return spans.select(*key, F.row_number().over(w).alias("ordinal"), F.col("edge").alias("start"), "end")


def rebase(items: DataFrame, segments: DataFrame, on: Sequence[str], columns: Sequence[str], offset: str, padding: str) -> DataFrame:
    """Times within a segment -> times of the whole: minus padding, plus the segment's offset."""
    j = items.join(segments.select(*on, offset, padding), list(on))
    return j.withColumns({c: F.col(c) - F.col(padding) + F.col(offset) for c in columns})


def with_adaptive_limit(df: DataFrame, key: Sequence[str], value: str, tie: str, share: int = 10, factor: float = 1.5, least: float = 100.0) -> DataFrame:
    """``limit``: ``factor`` times the nearest-rank 1/``share`` quantile of the key's values, at least ``least``."""
    w = Window.partitionBy(*key)
    rows = df.withColumns({"_n": F.count("*").over(w), "_r": F.row_number().over(w.orderBy(value, tie)) - 1})
    low = F.max(F.when(F.col("_r") == F.floor(F.col("_n") / share), F.col(value))).over(w)
    return rows.withColumn("limit", F.greatest(low * factor, F.lit(least))).drop("_n", "_r")


def adjacent_correlation(df: DataFrame, key: Sequence[str], block: str, place: str, value: str, equal: float = 0.0) -> DataFrame:
    """key, block, r: correlation of each block's values with the next block's, place by place, of places that have both.

    0 for a single place or none with both; ``equal`` where all values of one of the blocks are the same.
    """
    after = df.select(*key, (F.col(block) - 1).alias(block), place, F.col(value).alias("_after"))
    both = df.join(after, [*key, block, place]).withColumns({"_x": F.when(F.col("_after").isNotNull(), F.col(value)), "_y": F.when(F.col(value).isNotNull(), F.col("_after"))})
    # partial sums of equal values are merged with rounding, so a variance need not be 0: smallest and largest values tell
    same = (F.min("_x") == F.max("_x")) | (F.min("_y") == F.max("_y"))
    # corr divides by zero, which is an error
    r = F.try_divide(F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y"))
    g = both.groupBy(*key, block).agg(F.when(F.count("_x") > 0, F.when(same, equal).otherwise(F.coalesce(r, F.lit(equal)))).alias("_r"), F.count("*").alias("_n"))
    return g.select(*key, block, F.when(F.col("_n") < 2, 0.0).otherwise(F.coalesce("_r", F.lit(0.0))).alias("r"))


def moving_mean(value: str, key: Sequence[str], order: Sequence[str | Column], before: int, after: int) -> Column:
    return F.avg(value).over(ordered(key, order).rowsBetween(-before, after))


def first_minimum(df: DataFrame, key: Sequence[str], value: str, pos: str) -> DataFrame:
    """Place of the smallest value, the first on ties: key, at, least."""
    best = F.min(F.struct(F.col(value).alias("v"), F.col(pos).alias("p")))
    return df.groupBy(*key).agg(best.alias("b")).select(*key, F.col("b.p").alias("at"), F.col("b.v").alias("least"))


def sustained_rise(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], value: str, limit: Column, run: int = 2) -> DataFrame:
    """First place from which ``run`` consecutive values exceed ``limit``: key, rise_pos."""
    w = ordered(key, order)
    rows = df.withColumns({"_pos": (F.row_number().over(w) - 1).cast("bigint"), "_limit": limit})
    high = F.col(value) > F.col("_limit")
    for k in range(1, run):
        high = high & (F.lead(value, k).over(w) > F.col("_limit"))
    return rows.withColumn("_high", high).where("_high").groupBy(*key).agg(F.min("_pos").alias("rise_pos"))
