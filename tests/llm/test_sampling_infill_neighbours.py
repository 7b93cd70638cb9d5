"""Importance draws, filling in the middle and nearest vectors against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.llm import importance, infill, neighbours
from seqloom.llm.queries import ORACLES

DOCS = "doc_id bigint, text string, source string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s") for i, t in rows], DOCS)


def benchmark(spark, texts):
    return spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(texts)], "item_id string, text string")


def digits(seed, doc_id):
    return hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()


# --- 11 importance draw ---------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return w, [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain_draw(rows, target, n=1, buckets=10_000, least=20, share=10):
    cut = [plain_features(t, n) for _, t in rows]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, fs in cut for f in fs), Counter(bucket(f) for x in target for f in plain_features(x, n)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in s}
    out = []
    for (i, _), (words, fs) in zip(rows, cut):
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        noise = math.floor(-1000 * math.log(-math.log((int(digits(2024, i)[:8], 16) + 0.5) / 4294967296)))
        out.append([i, len(fs), weight, weight + noise, None, len(words)])
    order = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, r in enumerate(order[: share * len(order) // 100]):
        r[4] = place + 1
    return sorted(map(str, (tuple(r[:5]) for r in out)))


def texts_of(rng, many, longest=60):
    vocabulary = [f"w{k}" for k in range(40)] + ["Über", "ÉCOLE", "naïve", "日本", "the", "THE", "x9"]
    return [" ".join(rng.choice(vocabulary, rng.integers(0, longest))) + rng.choice(["", ".", "\x00!", "—ende"]) for _ in range(many)]


@pytest.mark.parametrize(("n", "hot", "buckets"), [(1, 50_000, 10_000), (1, 3, 50), (3, 10, 1000)])
def test_draw_equals_plain(spark, n, hot, buckets):
    rng = np.random.default_rng(n)
    texts = texts_of(rng, 150)
    rows = [*enumerate(texts), (None, texts[0]), (None, texts[0]), (7, texts[7]), (7, "the the"), (900, None), (901, ""), (902, "!?"), (903, "The" * 50 + " the" * 3000)]
    target = [*texts_of(rng, 12), None, ""]
    mine, wanted = docs(spark, rows).repartition(5), benchmark(spark, target)
    weights = importance.document_weights(mine, wanted, n, buckets, hot).withColumn("score", F.col("weight") + importance.gumbel(2024, F.col("doc_id")))
    got = importance.drawn(importance.cut(weights), F.col("n_words") >= 20, 10).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_draw(rows, target, n, buckets)
    if n == 1 and buckets == 10_000:
        assert sorted(str(tuple(r)) for r in importance.importance_draw(mine, wanted).collect()) == plain_draw(rows, target)


def test_draw_repeated_rows_and_ties(spark):
    """Thousands of equal rows of one id are numbered one by one, all ranks differ."""
    text = " ".join(f"w{k}" for k in range(25))
    mine = spark.range(3000).select(F.lit(4).cast("bigint").alias("doc_id"), F.lit(text).alias("text"), F.lit("x").alias("_at"))
    got = importance.importance_draw(mine, benchmark(spark, ["w1"])).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 301)) and len(got) == 3000


def test_draw_empty(spark):
    assert importance.importance_draw(docs(spark, []), benchmark(spark, ["a"])).collect() == []
    got = importance.importance_draw(docs(spark, [(1, None), (2, "a b")]), benchmark(spark, [])).collect()
    assert sorted((r.doc_id, r.n_features, r.rank) for r in got) == [(1, 0, None), (2, 2, None)]


# --- 12 filling in the middle ---------------------------------------------------


def plain_infill(doc_id, text):
    units, d = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or ""), digits(1, doc_id)
    h1, h2, h3, h4 = (int(d[8 * k : 8 * k + 8], 16) for k in range(4))
    text, n = text or "", len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_infill_equals_plain(spark):
    rng = np.random.default_rng(3)
    alphabet = list("ab cD9\n<>PSM.é日😀\x00")
    rows = [(k, "".join(rng.choice(alphabet, rng.integers(0, 80)))) for k in range(300)]
    rows += [(None, "no id here"), (5, rows[5][1]), (5, rows[5][1]), (400, None), (401, ""), (402, "x <M> y"), (403, "word, " * 200_000)]
    frame = spark.createDataFrame([(i, t, "kept", "dropped") for i, t in rows], "doc_id bigint, text string, `_e.x` string, OUTPUT string")
    got = infill.fill_in_middle(frame).collect()
    key = lambda r: (str(r[0]), r[1] or "")
    for (i, t), r in zip(sorted(rows, key=key), sorted(got, key=lambda r: key((r.doc_id, r.text)))):
        n, form, before, between, out = plain_infill(i, t)
        assert (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r["_e.x"]) == (i, n, form, before, between, out, "kept")
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.infill_report(frame.limit(0)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("<>PSM aé"), max_size=30), st.integers(0, 99), st.integers(0, 2**32), st.integers(0, 2**32))
def test_infill_can_be_undone(text, last, first, second):
    *_, form, before, between, out = (None, *infill.rearranged(text, [first, second, 0, last], infill.regex.compile(infill.UNIT), 10, 20)[1:])
    assert infill.restored(out, form) == text


# --- 13 nearest vectors ---------------------------------------------------------


def plain_nearest(rows, k, every):
    usable = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    found = []
    for q in {i for i, _ in usable if i % every == 0}:
        scored = []
        for v in {tuple(v) for i, v in usable if i == q}:
            for i, c in usable:
                if i != q and len(c) == len(v):
                    s = 0.0
                    for x, y in zip(v, c):
                        s += x * y
                    scored.append((-s, i))
        found += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(found)


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], f"vec_id bigint, embedding array<{kind}>, dim int")


@pytest.mark.parametrize(("block", "query_bytes"), [(4096, 1 << 25), (7, 2000)])
def test_nearest_equals_plain(spark, block, query_bytes):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(260, 6)), 3)
    x[40:130] = x[3]  # a common vector
    x[130:160] = x[4] + np.round(rng.normal(size=(30, 6)) / 1000, 5)
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(40, rows[40][1])] * 30 + [(40, rows[9][1]), (20, rows[1][1]), (None, rows[0][1]), (300, None), (301, []), (302, [0.0] * 6), (303, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    rows += [(304, [math.nan] * 6), (320, [math.inf] * 6), (340, [1.0, 2.0]), (341, [2.0, 1.0]), (360, [1e200] * 6), (361, [-1e200] * 6)]
    got = neighbours.nearest(vectors(spark, rows).repartition(3), F.col("vec_id") % 20 == 0, 8, block, query_bytes).collect()
    assert sorted(tuple(r) for r in got) == plain_nearest(rows, 8, 20)


def test_nearest_bounds_hold():
    """Every inner product lies within the bounds of its codes."""
    rng = np.random.default_rng(8)
    for scale in (1e-30, 1.0, 1e30):
        x = rng.normal(size=(300, 33)) * scale * 10.0 ** rng.integers(-3, 3, (300, 1))
        block = neighbours.Block.of(neighbours.packed_block(np.arange(300), x, None))
        middle, width = neighbours.bounds(block, slice(0, 300), block)
        assert (np.abs(middle - x @ x.T) <= width).all()
        assert np.median(width / (np.abs(middle) + width)) < 0.5


def test_kept_ids():
    for ids in ([1, 2, 3, 4], [1, 1, 1, 2, 3], [5, 5, 5], [1, 2, 2, 2, 2, 3, 4, 5, 6]):
        for k in (1, 2, 3):
            kept = ids[: neighbours.kept_ids(np.array(ids), k)]
            for own in {*ids, 0}:
                assert [i for i in kept if i != own][:k] == [i for i in ids if i != own][:k]


def test_nearest_long_vectors_and_empty(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 1500)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = neighbours.nearest(vectors(spark, rows, "float"), F.col("vec_id") % 20 == 0, 5).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [r[:3] for r in plain_nearest(rows, 5, 20)]
    assert neighbours.nearest_report(vectors(spark, [])).collect() == []


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_fill_in_middle", "op13_nearest_neighbours"])
def test_whole_tables_against_sql(spark, name):
    import os

    import duckdb

    from seqloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("driver tables are absent")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, folder)
    shown = lambda rows: sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)
    assert shown(df.collect()) == shown(con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall())
