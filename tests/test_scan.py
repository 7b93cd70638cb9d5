"""Windows over hot keys against plain versions, with ranges shorter than the frame, ties and nulls."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import intervals, scan

SCHEMA = "k string, at bigint, id bigint, v double"


def rows_of(seed, many=400):
    rng = random.Random(seed)
    out = [("hot", rng.randrange(many // 2), i, rng.choice([None, 0.0, -1.5, rng.random(), 1e9 * rng.random(), 3.0])) for i in range(many)]
    out += [(None, rng.randrange(50), i, rng.random()) for i in range(many, many + 120)]
    out += [(f"k{i % 9}", rng.randrange(20), i, float(i)) for i in range(many + 120, many + 150)]
    return out + [("hot", None, many + 200, 7.0), ("hot", None, many + 201, None)]


def sequences(rows):
    keys = {r[0] for r in rows}
    first = lambda x: (x is not None, x or 0)
    return {k: sorted((r for r in rows if r[0] == k), key=lambda r: (first(r[1]), r[2])) for k in keys}


@pytest.mark.parametrize("split", [2, 7, 60])
def test_halo_and_running(spark, split):
    rows = rows_of(split)
    df = spark.createDataFrame(rows, SCHEMA)
    made = lambda w: {"p3": F.lag("id", 3).over(w), "n2": F.lead("id", 2).over(w), "mean": F.avg("v").over(w.rowsBetween(-3, 2))}
    got = scan.halo_windows(df, ["k"], ["at", "id"], F.col("at"), made, 3, 2, split)
    want = []
    for s in sequences(rows).values():
        for i, r in enumerate(s):
            near = [x[3] for x in s[max(0, i - 3) : i + 3] if x[3] is not None]
            want.append((r[2], s[i - 3][2] if i >= 3 else None, s[i + 2][2] if i + 2 < len(s) else None, round(sum(near) / len(near), 3) if near else None))
    shown = [(r.id, r.p3, r.n2, None if r["mean"] is None else round(r["mean"], 3)) for r in got.collect()]
    assert sorted(map(str, shown)) == sorted(map(str, want)) and got.columns == ["k", "at", "id", "v", "p3", "n2", "mean"]

    one = F.lit(1).cast("bigint")
    got = scan.running(df, ["k"], ["at", "id"], F.col("at"), {"pos": one, "total": F.when(F.col("v") > 1, 1).cast("bigint")}, {"last": F.when(F.col("v") > 1, F.col("id"))}, split)
    want = []
    for s in sequences(rows).values():
        total, last = 0, None
        for i, r in enumerate(s):
            if r[3] is not None and r[3] > 1:
                total, last = total + 1, r[2]
            want.append((r[2], i + 1, total, last))
    assert sorted(map(str, want)) == sorted(str((r.id, r.pos, r.total, r["last"])) for r in got.collect())


@pytest.mark.parametrize("split", [3, 40])
def test_runs(spark, split):
    rows = rows_of(11)
    df = spark.createDataFrame(rows, SCHEMA)
    got = scan.run_lengths(df, ["k"], ["at", "id"], F.col("at"), F.col("v") > 0, 2, F.col("v") > 2.5, split)
    want = []
    for k, s in sequences(rows).items():
        run = []
        for i, r in enumerate([*s, (k, 0, 0, None)]):
            if r[3] is not None and r[3] > 0:
                run.append((i + 1, r[3]))
                continue
            if len(run) >= 2 and max(v for _, v in run) > 2.5:
                want.append((k, run[0][0], run[-1][0], len(run)))
            run = []
    assert sorted(map(str, want)) == sorted(str((r.k, r.first_pos, r.last_pos, r.length)) for r in got.collect())
    plain = intervals.runs(df, ["k"], ["at", "id"], F.col("v") > 0).select("k", "first_pos", "last_pos", "length").collect()
    mine = scan.run_lengths(df, ["k"], ["at", "id"], F.col("at"), F.col("v") > 0, split=split).select("k", "first_pos", "last_pos", "length").collect()
    assert sorted(map(str, plain)) == sorted(map(str, mine))


@pytest.mark.parametrize("split", [1, 4, 300])
def test_exact_ranks(spark, split):
    rng = random.Random(5)
    rows = [("wide", 10.0 ** rng.randrange(-300, 300) * rng.choice([-1, 1])) for _ in range(300)]
    rows += [("ties", rng.choice([1.0, 1.0, 1.0, 2.0])) for _ in range(200)] + [("small", float(i)) for i in range(3)]
    rows += [("close", 1 + i * 2.0**-52) for i in range(100)] + [("zero", 0.0)] * 50 + [("edge", v) for v in (1.7e308, -1.7e308, 5e-324, -5e-324)] * 20
    rows += [("none", None), ("ties", None), ("ties", float("nan")), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    ranks = {"least": (0, 1), "q1": (1, 4), "mid": (1, 2), "p99": (99, 100), "beyond": (1, 1)}
    got = {r.k: r for r in scan.exact_ranks(df, ["k"], "v", ranks, split).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        if s := sorted(v for j, v in rows if j == k and v is not None and v == v):
            want[k] = (len(s), *(s[len(s) * a // b] if len(s) * a // b < len(s) else None for a, b in ranks.values()))
    assert {k: (r.n, *(r[name] for name in ranks)) for k, r in got.items()} == want


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    args = (df, ["k"], ["at", "id"], F.col("at"))
    assert scan.halo_windows(*args, lambda w: {"x": F.lag("id").over(w)}).collect() == []
    assert scan.with_place(*args).collect() == [] and scan.run_lengths(*args, F.col("v") > 0).collect() == []
    assert scan.exact_ranks(df, ["k"], "v", {"mid": (1, 2)}).collect() == []


def test_plan_of_one_sequence_has_no_single_task(spark):
    """The window of a single hot key is dealt by (key, range), and no row order is global."""
    df = spark.range(5000).select(F.lit(0).alias("k"), F.col("id").alias("at"), "id", F.lit(1.0).alias("v"))
    h = scan.halo_windows(df, ["k"], ["at", "id"], F.col("at"), lambda w: {"p": F.lag("id").over(w)})
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "_part" in plan
    assert scan.split_keys(df, ["k"], F.col("at")).select("_part").distinct().count() > 150
    assert h.where("p = id - 1 OR (id = 0 AND p IS NULL)").count() == 5000


def test_intervals_of_any_length(spark):
    """Cells of a unit beside lengths from nothing to 10 ** 12, against all pairs; rows that repeat and bounds that are missing."""
    rng = random.Random(3)
    draw = lambda k: (k, *sorted((rng.randrange(-5000, 5000), rng.randrange(-5000, 5000) if rng.random() < 0.5 else rng.randrange(0, 40))))
    left = [(*draw("a"), i) for i in range(60)] + [("a", -(10**12), 10**12, 100), ("a", 7, 7, 101), ("a", 7, 7, 101), ("a", None, 3, 102), ("b", 0, 1, 103)]
    right = [(*draw("a"), i) for i in range(60)] + [("a", -3, 10**12, 100), ("a", 8, 8, 101), ("a", 9, 5, 102), ("c", 0, 9, 103)]
    a = spark.createDataFrame(left, "k string, s bigint, e bigint, i int")
    b = spark.createDataFrame(right, "k string, s2 bigint, e2 bigint, j int")
    for least in (0, 25):
        want = [(x[3], y[3], min(x[2], y[2]) - max(x[1], y[1])) for x in left for y in right if x[0] == y[0] and x[1] is not None and min(x[2], y[2]) - max(x[1], y[1]) > least]
        for width in (1, 0.3, 64, 10**6):
            got = intervals.overlap_join(a, b, ["k"], "s", "e", "s2", "e2", width, least)
            assert sorted((r.i, r.j, r.overlap) for r in got.collect()) == sorted(want)
        semi = intervals.overlap_join(a, b, ["k"], "s", "e", "s2", "e2", 8, least, "left_semi")
        ids = {i for i, _, _ in want}
        assert sorted(tuple(r) for r in semi.collect() if r.s is not None) == sorted(x for x in left if x[3] in ids)
    points = a.select("k", "i", F.col("s").alias("at"))
    for closed in (True, False):
        got = intervals.contains_join(points, b, ["k"], "at", "s2", "e2", 2, closed)
        want = [(x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[1] is not None and y[1] <= x[1] and (x[1] <= y[2] if closed else x[1] < y[2])]
        assert sorted((r.i, r.j) for r in got.collect()) == sorted(want)
