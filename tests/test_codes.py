"""Verses and marks by code points against the column expressions and plain Python."""

import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqloom.functions import text as T
from seqloom.operators import intervals
from seqloom.plans import acoustic_queries, mark_queries, scripted, sequence_queries

ODD = [
    "", None, " ", "...", "the the the the cat. The end", "the", "t t. at  the the  t", "é a.éa!béb é?\n\n b", "aeiouyw bab. k", "the\tthe the x the t.", "İstanbul KELVIN Åb",
    "مُحَمَّد the بّ a ـ. ٱل ٰ", "\U0001f600b a.\U0001f600", "a" * 5 + "." * 5 + "b", "?start. end?",
]


def random_texts(n):
    r = random.Random(7)
    return ["".join(r.choice(["the ", "t", " ", "a", "b", "é", "e", ".", "\n", "y", "w", "ب", "َ", "ـ", "x", "É", "th"]) for _ in range(r.randrange(60))) for _ in range(n)]


def test_verses_are_what_the_script_makes_of_sentences(spark, monkeypatch):
    rows = list(enumerate(ODD + random_texts(400)))
    texts = spark.createDataFrame(rows, "k bigint, text string")
    parts = texts.select("k", F.posexplode(F.split("text", scripted.SENTENCE_END)).alias("verse", "s"))
    want = sorted(tuple(r) for r in parts.select("k", "verse", scripted.script(F.col("s")).alias("text")).where("text <> ''").collect())
    made = scripted.verses(texts, "k")
    assert sorted(tuple(r) for r in made.collect()) == want
    assert "regexp_replace" not in made._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(T, "CODES", 3)
    assert sorted(tuple(r) for r in scripted.verses(texts, "k").collect()) == want


def test_marks_need_no_shuffle_and_are_right(spark):
    rows = list(enumerate(["َب", None, "", "بَّكِ x ُ", "آً", "ݐ٘ٓ ّ", "a\U0001f600بٰ"]))
    got = T.extract_marks(spark.createDataFrame(rows, "k bigint, text string"), ["k"])
    want = []
    for k, t in rows:
        base, letter, position = "", -1, 0
        for at, c in enumerate(unicodedata.normalize("NFD", t or "")):
            if re.match(f"[{T.LETTERS}]", c):
                base, letter = c, letter + 1
            if c in T.MARK_NAMES.values():
                want.append((k, position, c, next(n for n, m in T.MARK_NAMES.items() if m == c), base, at, letter))
                position += 1
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_normal_forms_in_parts(spark, monkeypatch):
    monkeypatch.setattr(T, "CODES", 3)
    rows = list(enumerate([None, "", "e\u0301", "\u00e9a", "ﬁ" * 9, "ب\u0651\u064e", "ـ\u200be\u06d6\u0301", "plain"]))
    df = spark.createDataFrame(rows, "k int, t string")
    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        assert [r[0] for r in df.select("k", T.normalize("t", form).alias("t")).orderBy("k").select("t").collect()] == [t and unicodedata.normalize(form, t) for _, t in rows]
    gone = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if c not in T.TATWEEL + T.ZERO_WIDTH + T.PAUSE_SIGNS)
    cleaned = df.select("k", T.clean("t").alias("t"))
    assert [r[0] for r in cleaned.orderBy("k").select("t").collect()] == [t and unicodedata.normalize("NFC", gone(t)) for _, t in rows]
    assert cleaned._jdf.queryExecution().executedPlan().toString().count("EvalPython") == 1


def test_correlation_of_equal_values_is_no_error(spark):
    rows = [(b, k, v) for b, block in enumerate([(1.0, 2.0, 4.0), (2.0, 4.0, 8.0), (0.1, 0.1, 0.1), (5.0, 1.0, 2.0)]) for k, v in enumerate(block)]
    df = spark.createDataFrame(rows, "b int, k int, v double").withColumn("u", F.lit(1))
    got = {r.b: round(r.r, 9) for r in intervals.adjacent_correlation(df, ["u"], "b", "k", "v").collect()}
    assert got == {0: 1.0, 1: 0.0, 2: 0.0}


def test_correlation_of_equal_and_missing_values_is_that_of_the_sql(spark, tmp_path):
    duck = pytest.importorskip("duckdb").connect()
    r = random.Random(5)
    # of user 0 to 5 each value stands 20 times in a row, of 6 and 7 some are missing, of 8 and 9 they differ
    value = lambda u, k: 0.1 * (u + 1) + k // 20 / 3 if u < 6 else None if u < 8 and r.random() < 0.7 else r.random()
    rows = [(u * 1000 + k, u, "view", value(u, k)) for u in range(10) for k in range(173)]
    e = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    e.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = duck.sql(f"SELECT user_id, block, r FROM ({sequence_queries.ORACLES['adjacent_corr']})").fetchall()
    plain = lambda found: sorted((u, b, repr(round(x, 4))) for u, b, x in found)
    got = sequence_queries.adjacent_corr(spark, str(tmp_path)).select("user_id", "block", "r").collect()
    assert plain(got) == plain(want) and sum(math.isnan(x) for _, _, x in want) > 100


def test_mark_sequences_are_the_columns_in_bounded_parts(spark, monkeypatch):
    odd = ["\u064eب", None, "", "ب\u0651\u064eك\u0650\u0652 x \u0652", "آ\u064b", "ݐ\u0658\u0653\u0651\u0651 \u0651", "a\U0001f600ب\u0670", "\u0652", "ب\u0652\u0652", "\u0652\u0651ب"]
    r = random.Random(3)
    odd += ["".join(r.choice("بكآa \u0651\u0652\u064e\u064b\u0670\u06d6\u0653") for _ in range(r.randrange(30))) for _ in range(300)]
    texts = spark.createDataFrame(list(enumerate(odd)), "k bigint, text string").repartition(3)
    units = T.marked_letters("text")
    want = texts.select("k", T.mark_sequence("text").alias("signs"), *[T.letters_with(units, n).alias(f"{n}_at") for n in ("sukoon", "shaddah")]).orderBy("k").collect()
    got = T.mark_sequences(texts, ["k"])
    assert got.orderBy("k").collect() == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "EvalPython" not in plan
    monkeypatch.setattr(T, "CODES", 3)
    assert T.mark_sequences(texts, ["k"]).orderBy("k").collect() == want


def test_characters_are_counted_without_a_row_each(spark, monkeypatch, tmp_path):
    odd = [None, "", "abba", "b\u00e9", "e\u0301", "\U0001f600\U0001f600", "\U0010ffff", "\0"]
    texts = spark.createDataFrame([(t,) for t in odd], "text string").repartition(3)
    for n in (T.CODES, 2):
        monkeypatch.setattr(T, "CODES", n)
        for decomposed in (False, True):
            want = Counter("".join(unicodedata.normalize("NFD", t) if decomposed else t for t in odd if t))
            assert {r.ch: r.n for r in T.character_counts(texts, decomposed=decomposed).collect()} == want
    spark.createDataFrame([(1, "bab ta."), (2, None), (3, "b!")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = acoustic_queries.spelling_map(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("ب", "b", 3), ("ت", "t", 1)]
    assert sorted(map(tuple, mark_queries.character_classes(spark, str(tmp_path)).collect())) == [("letter", 4), ("mark", 2), ("other", 1)]
    for f in (acoustic_queries.spelling_map, mark_queries.character_classes):
        assert "explode" not in f(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_mark_counts_are_the_statistics(spark, monkeypatch):
    monkeypatch.setattr(T, "CODES", 3)
    odd = ["\u064eب", "", "ب\u0651\u064eك\u0650\u0652 x \u0652", "آ\u064b", "a\U0001f600ب\u0670", "\u0652\u0652"]
    texts = spark.createDataFrame(list(enumerate(odd)), "k bigint, text string")
    want = texts.select("k", T.mark_statistics("text").alias("s")).select("k", *[F.col(f"s.{n}").cast("bigint").alias(n) for n in T.MARK_NAMES])
    assert T.mark_counts(texts, ["k"]).orderBy("k").collect() == want.orderBy("k").collect()
    assert T.mark_counts(spark.createDataFrame([(1, None)], "k int, text string"), ["k"]).first()[:] == (1, *[0] * len(T.MARK_NAMES))


def test_word_analyses_are_the_columns_in_bounded_parts(spark, monkeypatch, tmp_path):
    odd = ["\u064eب", None, "", " ", "ب\u0651\u064eك\u0650\u0652 x \u0652", "آ\u064b ك", "\u0651 \u064e", "\tٱلْ\x0b\x0cة\u2003ة\x1cب\r\n", "ݐ\u0658\u064e\u0650\u064bٱ\u064e", "a\U0001f600ب\u0670\u064d", "ب", "\u064e", "\u06d3\u064e أ\u064c"]
    r = random.Random(4)
    odd += ["".join(r.choice("بكآaٱة \t\u0651\u0652\u064e\u064b\u0670\u06d6\u0653\u0650") for _ in range(r.randrange(30))) for _ in range(400)]
    texts = spark.createDataFrame(list(enumerate(odd)), "k bigint, text string").repartition(3)
    w = texts.select("k", F.posexplode(T.words("text")).alias("idx", "word")).withColumn("a", T.word_analysis("word"))
    want = sorted(map(tuple, w.select(
        "k", "idx", F.array_join("a.letters", ""), "a.n_letters", "a.n_marks", F.array_join("a.vowels", ","), "a.has_wasla", "a.has_marbuta"
    ).collect()))
    for n in (T.CODES, 3, 40):
        monkeypatch.setattr(T, "CODES", n)
        assert sorted(map(tuple, T.word_analyses(texts, ["k"]).collect())) == want
    assert len(want) > 900
    spark.createDataFrame([(1, "bab ta."), (2, None), (3, "")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = mark_queries.word_analyses(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, "بب", 2, 1, "fatha,none", False, False), (1, 0, 1, "ت", 1, 1, "fatha", False, False)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "EvalPython" not in plan and "explode" not in plan
