"""Balanced selection in rounds against classes that choose one after another."""

import random

from seqloom.operators import report


def serial(rows, names, each):
    taken, out = set(), []
    for name in names:
        best = {}
        for c, item, at in rows:
            if c == name and item is not None and item not in taken:
                best[item] = min(at, best.get(item, at))
        mine = sorted((at, item) for item, at in best.items())[:each]
        taken |= {item for _, item in mine}
        out += [(name, item, at) for at, item in mine]
    return sorted(out)


def chosen(spark, rows, each):
    c = spark.createDataFrame(rows, "class string, item bigint, at bigint")
    ranks = report.class_ranks(c, "at")
    names = [r[0] for r in ranks.orderBy("rank").collect()]
    return sorted(tuple(r) for r in report.balanced_selection(c, ranks, "item", "at", each).collect()), serial(rows, names, each)


def test_many_classes_over_few_items(spark):
    draw = random.Random(6)
    rows = [(f"c{draw.randrange(12)}", draw.randrange(25), draw.randrange(40)) for _ in range(500)]
    rows += rows[:50] + [(None, 1, 0), ("c1", None, 0)]
    got, want = chosen(spark, rows, 3)
    assert got == want and len({item for _, item, _ in got}) == len(got)


def test_a_chain_of_rejections_and_a_hot_class(spark):
    chain = [(f"c{k}", item, item + (k if item == 0 else 100)) for k in range(5) for item in range(4)]
    hot = [("c0", 1000 + k, 500 + k % 7) for k in range(20_000)]
    got, want = chosen(spark, chain + hot, 2)
    assert got == want


def test_no_candidates(spark):
    assert chosen(spark, [], 2) == ([], [])
