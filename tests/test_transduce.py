"""The compiled transducer against a plain reading, entry by entry."""

import random
import re

import pytest
from pyspark.sql import functions as F

from seqloom.operators import transduce
from seqloom.plans import spelling_queries
from seqloom.sources import inventory

ENTRIES = transduce.entries_of(inventory.parse(spelling_queries.SPELLING))


def plain(entries, text):
    rank, out = sorted(entries, key=lambda e: -len(e.write)), []
    for word in re.findall(r"[^\W\d_]+", text):
        at = 0
        while at < len(word):
            for e in rank:
                end = at + len(e.write)
                before, after = word[at - 1] if at else "#", word[end] if end < len(word) else "#"
                if word[at:end] == e.write and (not e.before or before in e.before) and (not e.after or after in e.after):
                    out += e.read
                    at = end
                    break
            else:
                at += 1
    return out


def said(reader, texts):
    found, ends = reader.read(texts)
    return [[reader.names[k] for k in found[a:b]] for a, b in zip(ends, ends[1:])]


def test_words_of_all_kinds():
    draw = random.Random(3)
    texts = ["", "a", "eau", "eaux eaue", "achtion, schul!", "th", "thx", "ж", "cжe", "lll llll", "e", "naïve ce"]
    texts += ["".join(draw.choice("aeiouschtnglqupx é,ж\n") for _ in range(draw.randrange(60))) for _ in range(600)]
    assert said(transduce.compiled(ENTRIES), texts) == [plain(ENTRIES, t) for t in texts]


def test_made_up_rules():
    draw = random.Random(4)
    for _ in range(150):
        some = lambda k, of="ab#": tuple(sorted(set(draw.choice(of) for _ in range(k))))
        entries = [
            transduce.Entry("".join(draw.choice("abc") for _ in range(draw.randrange(1, 5))), some(draw.randrange(3), "xyz"), some(draw.randrange(3)), some(draw.randrange(3)))
            for _ in range(draw.randrange(9))
        ]
        texts = ["".join(draw.choice("abcd ") for _ in range(draw.randrange(25))) for _ in range(30)]
        assert said(transduce.compiled(entries), texts) == [plain(entries, t) for t in texts]


def test_column_nulls_marks_and_very_long_texts(spark, monkeypatch):
    long, word = "achtung sch " * 300_000, "sch" * 40_000
    rows = [(1, None), (2, ""), (3, long), (4, "eau"), (5, word), (6, None)]
    reader = transduce.compiled(ENTRIES)
    df = spark.createDataFrame(rows, "k int, text string")
    got = {r.k: (r.n, r.head) for r in df.select("k", reader.column("text").alias("s")).select("k", F.when(F.col("s").isNotNull(), F.size("s")).alias("n"), F.slice("s", 1, 7).alias("head")).collect()}
    one = plain(ENTRIES, "achtung sch ")
    assert got == {1: (None, None), 2: (0, []), 3: (300_000 * len(one), (one * 2)[:7]), 4: (1, ["o"]), 5: (40_000, ["ʃ"] * 7), 6: (None, None)}
    assert df.where("k > 9").select(reader.column("text").alias("s")).collect() == []
    marks = transduce.compiled(transduce.entries_of({"consonant_mappings": {"ب": "b", "ت": "t", "ا": {"not": "plain"}}, "diacritic_mappings": {"َ": "a", "ِ": "i"}}))
    assert said(marks, ["بَتِ ابَ", "ب"]) == [["b", "a", "t", "i", "b", "a"], ["b"]]


def test_bad_files():
    for bad in ({"spelling": [{"write": "a", "colour": "red"}]}, {"spelling": [{"read": "a"}]}):
        with pytest.raises(transduce.BadSpelling):
            transduce.entries_of(bad)
    with pytest.raises(transduce.BadSpelling):
        transduce.compiled([transduce.Entry("a", ("x",), ("ab",))])
    with pytest.raises(transduce.BadSpelling):
        transduce.compiled(ENTRIES, most=5)
    nothing = transduce.compiled([])
    assert said(nothing, ["abc", ""]) == [[], []]
