"""Matching blocks against the standard library's, and the table function from SQL."""

import difflib
import random

from seqloom.functions import matching
from seqloom.operators import align
from seqloom.plans import interval_queries


def pairs(seed: int):
    r = random.Random(seed)
    for letters, longest in (("ab", 12), ("abcd ", 40), ("abcdefghij ّ\U0001f600", 60), ("ab", 450), ("abcdefgh", 450)):
        for _ in range(40):
            x = "".join(r.choice(letters) for _ in range(r.randint(0, longest)))
            y = "".join(c for c in x if r.random() > 0.2) + x[: r.randint(0, 5)] if r.random() < 0.5 else "".join(r.choice(letters) for _ in range(r.randint(0, longest)))
            yield x, y


def test_blocks_and_scripts_as_the_standard_library_has_them():
    for seed in range(3):
        lefts, rights = zip(*pairs(seed))
        for skip in (False, True):
            got = matching.matching_blocks(lefts, rights, skip)
            for x, y, m in zip(lefts, rights, got):
                want = difflib.SequenceMatcher(None, x, y, autojunk=skip)
                assert m == [tuple(b) for b in want.get_matching_blocks() if b.size]
                assert matching.edit_script(m, len(x), len(y)) == want.get_opcodes()
        assert matching.ratios(lefts, rights) == [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(lefts, rights)]


def test_words_with_nulls_and_empty_sides():
    lefts, rights = [["a", None, "b"], [], ["x"], []], [[None, "b"], ["y"], [], []]
    assert matching.matching_blocks(lefts, rights) == [[(1, 0, 2)], [], [], []]
    assert matching.ratios(lefts, rights) == [0.8, 0.0, 0.0, 1.0]


def test_small_groups_of_windows(monkeypatch):
    lefts, rights = zip(*pairs(7))
    want = matching.matching_blocks(lefts, rights)
    monkeypatch.setattr(matching, "CELLS", 50)
    assert matching.matching_blocks(lefts, rights) == want


def test_a_long_pair_takes_linear_memory():
    x = "".join(random.Random(1).choices("abcdefghijklmnop", k=20_000))
    assert matching.matching_blocks([x], [x[:9000] + "-" + x[9000:]]) == [[(0, 0, 9000), (9000, 9001, 11_000)]]


def test_table_function_equals_the_batch_form(spark):
    left, right = interval_queries._next_days(spark, "/root/testdata/sf0.001")
    want = align.diff_opcodes(left, right, ["user_id", "day"], "pos", "word")
    got = interval_queries.edit_script(spark, "/root/testdata/sf0.001")
    names = ["user_id", "day", "tag", "i1", "i2", "j1", "j2"]
    rows = lambda df: sorted(map(str, df.select(*names).collect()))
    assert rows(got) == rows(want)


def test_table_function_keeps_null_keys_and_the_keys_type(spark):
    align.register_edit_script(spark)
    spark.createDataFrame([(None, 0, 1, "a"), (None, 1, 1, None), (5.5, 1, 2, "c"), (5.5, 1, 1, "b")], "k double, s int, o int, w string").createOrReplaceTempView("edit_rows")
    got = spark.sql("SELECT * FROM edit_script(TABLE(edit_rows), 'k', 's', 'o', 'w')")
    assert got.schema["k"].dataType.simpleString() == "double"
    assert {tuple(r) for r in got.collect()} == {(None, "replace", 0, 1, 0, 1), (5.5, "insert", 0, 0, 0, 2)}
    assert spark.sql("SELECT * FROM edit_script(TABLE(SELECT * FROM edit_rows WHERE o > 9), 'k', 's', 'o', 'w')").count() == 0
