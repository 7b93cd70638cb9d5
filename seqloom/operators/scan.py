"""Windows over sequences of any length: a key that holds much of a table is split over tasks.

``Window.partitionBy(key)`` puts a whole sequence into one task. Here a key with more than a
``split``-th of all rows is cut into ranges of its order, so that no task gets much more than
that share, and what crosses a cut is put right:

- bounded frames (neighbours, moving means) get copies of the rows beside the cut (``halo_windows``);
- running sums, counts, positions and last values get what all earlier ranges hold (``running``);
- runs follow from two running counts and one grouping (``run_lengths``);
- ranks of values need no order at all: counts of value ranges narrow the place down (``exact_ranks``).

There are fewer than ``split`` such keys whatever the table, and about 2 x ``split`` ranges: these
are what is broadcast or collected. All other keys are one range each, so the plan is one exchange
by (key, range) for a whole table.

``at`` is a number that does not fall along the order (its first column, a time as a number):
rows of one ``at`` stay in one range. Rows without it come first. The order must be total within a
key; a table is read more than once and must give the same rows each time. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT = 200
#: Values of a pass's ranges in ``exact_ranks``, and rows from which on a key's values are not sorted.
CELLS = 4096


def hot_keys(df: DataFrame, key: Sequence[str], split: int = SPLIT) -> tuple[list, int]:
    """(rows of key and n for keys of more than a ``split``-th of all rows, number of all rows)."""
    counts = df.groupBy(*key).agg(F.count("*").alias("_n"))
    top = counts.orderBy(F.desc("_n")).limit(split).collect()
    total = df.count() if top else 0
    return [r for r in top if r["_n"] * split > total], total


def _small(df: DataFrame, key: Sequence[str], rows: list[tuple], extra: str) -> DataFrame:
    """Rows that begin with the key, as a table with the key's types under other names."""
    fields = [T.StructField(f"_k{i}", df.schema[k].dataType) for i, k in enumerate(key)]
    schema = T.StructType([*fields, *T.StructType.fromDDL(extra).fields])
    return df.sparkSession.createDataFrame(rows, schema)


def _same(key: Sequence[str], df: DataFrame, other: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, (df[k].eqNullSafe(other[f"_k{i}"]) for i, k in enumerate(key)), F.lit(True))


def split_keys(df: DataFrame, key: Sequence[str], at: Column, split: int = SPLIT) -> DataFrame:
    """Adds ``_part``, the row's range in its key (0 where the key is one range), and ``_hot``."""
    hot, total = hot_keys(df, key, split)
    rows = df.withColumn("_at", at.cast("double"))
    if not hot:
        return rows.withColumns({"_part": F.lit(0), "_hot": F.lit(False)}).drop("_at")
    wanted = _small(df, key, [tuple(r)[:-1] for r in hot], "")
    shares = [i / split for i in range(1, split)]
    held = rows.join(F.broadcast(wanted), _same(key, rows, wanted), "left_semi")
    found = held.groupBy(*key).agg(F.count("*").alias("n"), F.percentile_approx("_at", shares, 10 * split).alias("at")).collect()
    cuts = []
    for r in found:
        parts = max(2, -(-r["n"] * split // total))
        steps = r["at"] or []
        cuts.append((*(r[k] for k in key), sorted({steps[min(len(steps) - 1, j * split // parts)] for j in range(1, parts)} if steps else ())))
    ranges = _small(df, key, cuts, "_cuts array<double>")
    j = rows.join(F.broadcast(ranges), _same(key, rows, ranges), "left")
    part = F.size(F.filter("_cuts", lambda c: c < F.col("_at")))  # rows without an order value: none is below
    return j.withColumns({"_hot": F.col("_cuts").isNotNull(), "_part": F.when(F.col("_cuts").isNull() | F.col("_at").isNull(), 0).otherwise(part)}).drop(
        "_at", "_cuts", *(f"_k{i}" for i in range(len(key)))
    )


def halo_windows(
    df: DataFrame, key: Sequence[str], order: Sequence[str], at: Column, columns: Callable[[WindowSpec], Mapping[str, Column]],
    before: int = 1, after: int = 1, split: int = SPLIT,
) -> DataFrame:
    """Adds ``columns(window)``: window functions that look at most ``before`` rows back and ``after`` ahead.

    The last ``before`` and first ``after`` rows of a hot key's ranges are copied to the ranges
    that they belong to (over several, where ranges are shorter than the frame).
    """
    rows = split_keys(df, key, at, split).withColumn("_halo", F.lit(False))
    hot = rows.where("_hot")
    parts = hot.groupBy(*key, "_part").agg(F.lit(1).alias("_one")).drop("_one")
    targets = parts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col("_part").alias("_to"))
    whole = rows
    for size, back in ((before, True), (after, False)):
        if size < 1:
            continue
        by = [F.desc(c) if back else F.asc(c) for c in order]
        edge = hot.withColumn("_r", F.row_number().over(Window.partitionBy(*key, "_part").orderBy(*by))).where(F.col("_r") <= size).drop("_r")
        side = F.col("_to") > F.col("_part") if back else F.col("_to") < F.col("_part")
        moved = edge.join(F.broadcast(targets), _same(key, edge, targets) & side)
        near = Window.partitionBy(*key, "_to").orderBy(*by)
        moved = moved.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= size)
        whole = whole.unionByName(moved.withColumns({"_part": F.col("_to"), "_halo": F.lit(True)}).select(*rows.columns))
    made = dict(columns(Window.partitionBy(*key, "_part").orderBy(*order)))
    return whole.withColumns(made).where("NOT _halo").drop("_part", "_hot", "_halo")


def running(
    df: DataFrame, key: Sequence[str], order: Sequence[str], at: Column, sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None, split: int = SPLIT,
) -> DataFrame:
    """Adds running sums (nulls count as none) and last values that are not null, each with its own row.

    A sum of doubles is the range's own sum plus that of the ranges before: it may differ from a
    sum in one go in its last digits.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    rows = split_keys(df, key, at, split)
    w = Window.partitionBy(*key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({f"_v_{n}": c for n, c in (sums | lasts).items()})
    # of each range of a hot key: its sums, and its last value in order
    last_of = lambda n: F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*order)))
    totals = local.where("_hot").groupBy(*key, "_part").agg(
        F.lit(0).alias("_c"), *(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums), *(last_of(n).alias(f"_t_{n}") for n in lasts)
    )
    prior = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.col("_part").alias("_p"),
        *(F.sum(f"_t_{n}").over(prior).alias(f"_t_{n}") for n in sums), *(F.last(f"_t_{n}", ignorenulls=True).over(prior).alias(f"_t_{n}") for n in lasts),
    )
    seen = local.withColumns({f"_w_{n}": F.sum(f"_v_{n}").over(w) for n in sums} | {f"_w_{n}": F.last(f"_v_{n}", ignorenulls=True).over(w) for n in lasts})
    j = seen.join(F.broadcast(carried), _same(key, seen, carried) & (seen["_part"] == carried["_p"]), "left")
    zero = F.lit(0)
    made = {n: F.coalesce(F.col(f"_w_{n}"), zero) + F.coalesce(F.col(f"_t_{n}"), zero) for n in sums}
    made |= {n: F.coalesce(F.col(f"_w_{n}"), F.col(f"_t_{n}")) for n in lasts}
    return j.select(*(f"`{c}`" for c in df.columns if c not in made), *(c.alias(n) for n, c in made.items()))


def with_place(df: DataFrame, key: Sequence[str], order: Sequence[str], at: Column, name: str = "pos", split: int = SPLIT) -> DataFrame:
    """0-based place of each row in its sequence."""
    return running(df, key, order, at, {name: F.lit(1).cast("bigint")}, split=split).withColumn(name, F.col(name) - 1)


def run_lengths(
    df: DataFrame, key: Sequence[str], order: Sequence[str], at: Column, flag: Column, least: int = 1, within: Column | None = None, split: int = SPLIT
) -> DataFrame:
    """Maximal runs of rows where ``flag`` holds: key, run, first_pos, last_pos, length (``intervals.runs`` for any length).

    ``run`` is the number of rows before it where the flag does not hold, so the rows of a run
    share it and are summed where they are. within: a second condition; a run counts only if some
    row of it fulfils it.
    """
    on = F.coalesce(flag, F.lit(False))
    second = F.lit(True) if within is None else F.coalesce(within, F.lit(False))
    rows = df.withColumns({"_on": on, "_within": second})
    one = F.lit(1).cast("bigint")
    placed = running(rows, key, order, at, {"_pos": one, "run": F.when(F.col("_on"), 0).otherwise(1).cast("bigint")}, split=split)
    g = placed.where("_on").groupBy(*key, "run").agg(
        F.min("_pos").alias("first_pos"), F.max("_pos").alias("last_pos"), F.count("*").alias("length"), F.max("_within").alias("_any")
    )
    return g.where((F.col("length") >= least) & F.col("_any")).drop("_any")


def exact_ranks(df: DataFrame, key: Sequence[str], value: str, ranks: Mapping[str, tuple[int, int]], split: int = SPLIT) -> DataFrame:
    """key, n, and for each (numerator, denominator) of ``ranks`` the value at index ``n * numerator // denominator`` in order.

    Null and NaN values are left out, keys without others too. Keys of up to a ``split``-th of the
    rows are ranked by a window. For the others, each pass counts the rows of value ranges that
    may hold the rank, by octaves first, then by equal parts, and keeps the range where it falls,
    with the least and greatest value in it; it ends when these are one value: seven passes at most,
    whatever the values. Neither side of a hot key is sorted or gathered.
    """
    v = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(v)).select(*key, v.alias("_v"))
    hot, _ = hot_keys(rows, key, split)
    n_of = {tuple(r)[:-1]: r["_n"] for r in hot}
    few = rows
    if hot:
        listed = _small(df, key, list(n_of), "")
        few = rows.join(F.broadcast(listed), _same(key, rows, listed), "left_anti")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("_v")) - 1
    ranked = few.withColumns({"_r": place, "_n": F.count("*").over(Window.partitionBy(*key))})
    at = lambda a, b: F.max(F.when(F.col("_r") == F.floor(F.col("_n") * a / b), F.col("_v")))
    plain = ranked.groupBy(*key).agg(F.max("_n").alias("n"), *(at(a, b).alias(name) for name, (a, b) in ranks.items()))
    if not hot:
        return plain
    # open: (key, name) -> (least, greatest, rank within)
    wanted = {(k, name): n * a // b for k, n in n_of.items() for name, (a, b) in ranks.items()}
    open_ = {t: (None, None, r) for t, r in wanted.items() if r < n_of[t[0]]}
    found: dict[tuple, float] = {}
    octave = F.when(F.col("_v") == 0, 0).otherwise(F.signum("_v") * (F.floor(F.log2(F.abs("_v"))) + 2000))
    first = True
    while open_:
        table = _small(df, key, [(*k, name, *span) for (k, name), span in open_.items()], "_name string, _low double, _high double, _rank bigint")
        j = rows.join(F.broadcast(table), _same(key, rows, table))
        if not first:
            j = j.where(F.col("_v").between(F.col("_low"), F.col("_high")))
        cell = octave if first else F.floor((F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2) * CELLS)
        counts = j.groupBy(*key, "_name", "_rank", cell.alias("_c")).agg(F.count("*").alias("_m"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        before = F.sum("_m").over(Window.partitionBy(*key, "_name").orderBy("_c")) - F.col("_m")  # some thousand ranges a rank
        held = counts.withColumn("_before", before).where((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_m")))
        open_ = {}
        for r in held.select(*key, "_name", "_a", "_b", "_rank", "_before").collect():
            k = tuple(r)[: len(key)]
            if r["_a"] == r["_b"]:
                found[k, r["_name"]] = r["_a"]
            else:
                open_[k, r["_name"]] = (r["_a"], r["_b"], r["_rank"] - r["_before"])
        first = False
    lines = [(*k, n, *(found.get((k, name)) for name in ranks)) for k, n in n_of.items()]
    done = _small(df, key, lines, "n bigint, " + ", ".join(f"`{name}` double" for name in ranks))
    return plain.unionByName(done.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(key)), "n", *ranks))
