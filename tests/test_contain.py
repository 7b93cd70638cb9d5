"""Containment by rarest pieces against all pairs."""

import random

from seqloom.operators import contain


def rows(spark, values, name):
    return spark.createDataFrame([(v, 1) for v in values], f"{name} string, n int")


def found(spark, needles, texts):
    return sorted(map(tuple, contain.containments(rows(spark, needles, "needle"), rows(spark, texts, "text")).collect()))


def plain(needles, texts):
    return sorted((n, t) for n in {x for x in needles if x} for t in {x for x in texts if x} if n in t)


def test_as_all_pairs(spark):
    r = random.Random(5)
    word = lambda longest: "".join(r.choice("abcé\U0001f600\n.*\\$") for _ in range(r.randint(0, longest)))
    needles, texts = [None, ""] + [word(6) for _ in range(200)], [None, ""] + [word(30) for _ in range(300)]
    needles += needles[:50] + texts[:20]
    want = plain(needles, texts)
    assert len(want) > 500 and found(spark, needles, texts + texts[:40]) == want


def test_long_and_hot(spark):
    long = "ab" * 200_000 + "needle" + "ab" * 1000
    texts = [long] + [f"abab{k}" for k in range(500)]
    got = found(spark, ["needle", "needlez", "ab", "bab49", "xyz"], texts)
    assert got == plain(["needle", "needlez", "ab", "bab49", "xyz"], texts) and len(got) == 1 + 501 + 11


def test_nothing_to_ask_or_to_search(spark):
    assert found(spark, [], ["abc"]) == [] and found(spark, [None, ""], ["abc"]) == []
    assert found(spark, ["abc"], []) == [] and found(spark, ["a", "ab", "abc"], [None, ""]) == []


def test_no_nested_loop(spark):
    df = contain.containments(rows(spark, ["abc"], "needle"), rows(spark, ["abcd"], "text"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
