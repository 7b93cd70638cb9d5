"""Corpus operators on small fixtures: contracts, edge cases and brute-force comparison."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import chat, decontaminate, jaccard, licenses, lm, mixing, pii, separators, topk, toxicity
from seqloom.llm.hashing import word_hashes

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[k], len(t or "")) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- hashing --------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_word_hashes_follow_words(texts):
    data = [t.encode("utf-8", "ignore") for t in texts]
    h, first = word_hashes(data)
    seen = {}
    for k, d in enumerate(data):
        words = [lower(d.decode()).encode()][0].split()
        assert first[k + 1] - first[k] == len(words)
        for w, x in zip(words, h[first[k] : first[k + 1]]):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# --- 1 language model -----------------------------------------------------------


def test_lm_base_by_hand(spark):
    texts = [(i, " ".join(f"w{(i * j) % 7} W{j % 3}" for j in range(i % 9))) for i in range(60)] + [(60, None), (61, ""), (None, "w1 w2"), (5, "w1 w2")]
    got = lm.lm_scores(docs(spark, texts)).collect()
    assert len(got) == len(texts)
    count = Counter()
    tokens = [(i, WORD.findall(lower(t)) + [None]) for i, t in texts]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, t in tokens:
        if not held(i):
            count.update(t)
    n, v = sum(count.values()), len(count)
    base = sorted((str(i), round(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in t), 6), len(t), sum(count[w] > 0 for w in t)) for i, t in tokens)
    assert sorted((str(r.doc_id), round(r.base_score, 6), r.n_tokens, r.n_known) for r in got) == base
    assert all(r.train_tokens == n and r.held_out == held(r.doc_id) and r.score <= 0 for r in got)


def plain_lm(texts):
    """Score of each text from raw counts of its n-grams, token by token."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = [WORD.findall(lower(t)) + ["\0"] for _, t in texts]
    c = Counter()
    for (i, _), t in zip(texts, tokens):
        if not held(i):
            line = ["\0", *t]
            c.update((w,) for w in t)
            c.update(zip(line, line[1:]))
            c.update(zip(line, line[1:], line[2:]))
    words = {k[0]: x for k, x in c.items() if len(k) == 1}
    n, v = sum(words.values()), len(words)
    bins = Counter(), Counter()
    for x in words.values():
        b = int(lm.bin_of(np.array([x]))[0])
        bins[0][b] += 1
        bins[1][b] += x

    def l2(x):
        draws = 2.0 ** ((int(lm.bin_of(np.array([x]))[0]) + 0.5) / 8)
        new = sum(bins[1][b] / n * np.exp(-bins[1][b] / bins[0][b] / n * draws) for b in bins[0]) + v / (n + v) if n else 1.0
        return min(lm.NEW * new, 0.999)

    out = []
    for t in tokens:
        line, total = ["\0", *t], 0.0
        for k in range(1, len(line)):
            w, u = line[k], line[k - 1]
            p = (c[(w,)] + 1) / (n + v + 1)
            q = l2(c[(u,)]) if c[(u,)] else 1.0
            p = (1 - q) * c[(u, w)] / c[(u,)] + q * p if c[(u,)] else p
            pair = c[(line[k - 2], u)] if k > 1 else 0
            total += np.log10((1 - lm.L3) * c[(line[k - 2], u, w)] / pair + lm.L3 * p if pair else p)
        out.append(total)
    return out


def test_lm_scores_from_raw_counts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(f"{'Ww'[int(x) % 2]}{int(x)}" for x in rng.zipf(1.6, int(rng.integers(0, 90))) % 40)) for i in range(90)]
    texts += [(None, None), (None, ""), (3, texts[3][1]), (3, texts[3][1]), (91, "one two " * 1500), (92, "never seen before at all")]
    want = Counter((str(i), round(x, 5)) for (i, _), x in zip(texts, plain_lm(texts)))
    for block, bucket, segment in ((12_000_000, 4_000_000, 256), (700, 900, 7)):  # one block; many blocks, buckets and segments
        for name, value in (("BLOCK", block), ("BUCKET", bucket), ("SEGMENT", segment)):
            monkeypatch.setattr(lm, name, value)
        got = lm.lm_scores(docs(spark, texts)).collect()
        assert Counter((str(r.doc_id), round(r.score, 5)) for r in got) == want


def test_lm_pass_carries_its_state():
    """The pass in segments of any length equals one that steps through each whole text; arcs out of a state sum to no more than 1."""
    rng = np.random.default_rng(0)
    lens = rng.integers(1, 60, 20)
    first = np.concatenate([[0], np.cumsum(lens)])
    tokens = rng.integers(1, 9, first[-1]).astype(np.uint64)
    tokens[first[1:] - 1] = lm.END
    counts = []
    for keys in lm._keys(tokens, first, 60):
        _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
        counts.append(np.where(rng.random(len(n)) < 0.8, n, 0)[back])
    total, types = int(counts[0].sum()), 9
    chance = lm.new_word_chance([(0, 10, 10), (8, 5, 12)], 22, 15)
    a = lm.Automaton(tokens, first, counts, total, types, chance)
    whole = a.traverse(first)
    for segment in (1, 4, 1000):
        assert np.allclose(a.traverse(first, segment), whole)
    for k in range(len(lens)):
        state, score = np.array([a.start]), 0.0
        for i in range(first[k], first[k + 1]):
            gain, state = a.step(state, a.w[i : i + 1])
            assert state[0] == a.after[i]
            score += gain[0]
        assert abs(score - whole[k]) < 1e-9
    assert len(np.unique(a.keys)) == len(a.keys) and (np.diff(a.keys) > 0).all()
    assert ((chance > 0) & (chance < 1)).all() and (a.fail_weight <= 0).all() and (a.fail_target <= np.arange(len(a.fail_target))).all()


def test_lm_empty_table_and_no_training(spark):
    assert lm.lm_scores(docs(spark, [])).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = lm.lm_scores(docs(spark, [(only, "a b")])).first()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0


def test_lm_learns_order(spark):
    texts = [(i, "the cat sat on the mat and the dog ran " * 3) for i in range(80)]
    got = lm.lm_scores(docs(spark, texts)).where("held_out").collect()
    assert got and all(r.score > r.base_score for r in got)


# --- 2 licences -----------------------------------------------------------------


def test_license_scan(spark):
    mit = "Copyright (c) 2020 Someone\n\n" + licenses._MIT.upper().replace("SUBLICENSE", "sublicence")
    rows = [(1, mit), (2, "Some words.\nLicensed under CC BY-NC 4.0.\nmore"), (3, None), (4, ""), (5, "released under the MIT licence!"), (6, "x" * 50_000), (None, "words")]
    got = {r.doc_id: r for r in licenses.license_scan(docs(spark, rows)).collect()}
    assert got[1].license == "MIT" and got[2].license is None and got[2].line_licenses == "CC-BY-NC-4.0" and got[2].n_lines == 1
    assert got[5].license == "MIT" and got[3].license is None and got[6].n_lines == 0 and len(got) == 7
    assert licenses.license_scan(docs(spark, [])).count() == 0


# --- 3 token counts -------------------------------------------------------------


def test_separator_counts_stitch_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows, expected = [], []
    for file in range(3):
        lens = rng.integers(0, 40, 50)
        stream = np.concatenate([np.append(rng.integers(0, 9, n), 50) for n in lens] + [np.array([1, 2, 3])]).astype(np.uint16)
        expected += [(file, k, int(n), True) for k, n in enumerate(lens)] + [(file, 50, 3, False)]
        rows += [(file, b, stream[b * 7 : b * 7 + 7].tobytes(), None) for b in range(-(-len(stream) // 7))]
    monkeypatch.setattr(separators, "SUPER", 5)
    blocks = spark.createDataFrame(rows[::-1], separators.BLOCKS)
    got = separators.separator_counts(blocks, eod=50)
    assert sorted((r.file, r.ordinal, r.n_tokens, r.ended) for r in got.collect()) == expected
    assert separators.separator_counts(spark.createDataFrame([], separators.BLOCKS)).count() == 0


def test_token_counts_equal_plain_tokenising(spark, monkeypatch):
    monkeypatch.setattr(separators, "BLOCK", 16)
    texts = [(1, "Hello there, world"), (2, None), (3, ""), (4, "<|endoftext|> ünï " * 30), (None, "x y"), (4, "again")]
    got = sorted((str(r.doc_id), r.n_tokens) for r in separators.token_count_report(docs(spark, texts)).collect())
    enc = separators.load_encoding()
    assert got == sorted((str(i), len(enc.encode_ordinary(t or ""))) for i, t in texts)


def test_token_files_from_binary(spark, tmp_path):
    ids = np.array([5, 6, 9, 9, 7, 9, 8], np.uint16)
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    blocks = separators.read_token_files(spark.read.format("binaryFile").load(str(tmp_path)), block=2)
    got = separators.separator_counts(blocks, eod=9).orderBy("ordinal").collect()
    assert [(r.n_tokens, r.ended) for r in got] == [(2, True), (0, True), (1, True), (1, False)]


# --- 4 chat ---------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", ">", "a", "\n", "é", "|"]), max_size=12).map("".join))
def test_chat_escape_is_reversible(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROL)
    assert chat.parse(chat.TURN + chat.escape("r") + chat.TEXT + out + chat.END) == [("r", text)]


def test_chat_windows_and_read_back(spark):
    rows = [(1, 0, "system", "be kind"), *[(1, k, "user" if k % 2 else "assistant", f"turn {k} " + "word " * (k % 5 * 20)) for k in range(1, 30)]]
    rows += [(2, 0, "assistant", "x " * 3000), (2, 1, None, None), (None, 0, "user", "</s>"), (3, None, "user", "a"), (3, None, "user", "a"), (3, 1, "assistant", "")]
    conv = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    w = chat.chat_windows(conv, budget=120, history=40)
    for r in w.collect():
        turns = chat.parse(r.formatted)
        assert r.n_tokens <= 120 or len(turns) - r.repeated == 1 or r.conv_id == 2
        if r.conv_id == 1:
            assert turns[0] == ("system", "be kind")
    got = {r.conv_id: r for r in chat.read_back(w).collect()}
    assert sorted(map(str, got.values())) == sorted(map(str, chat.read_back(w, in_order=True).collect()))
    by = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)):
        by[c].append((role or "", text or ""))
    for c, turns in by.items():
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        target = "".join(t for r, t in turns if r == "assistant")
        assert got[c].loss_chars == len(target) and got[c].loss_sha256 == hashlib.sha256(target.encode()).hexdigest()
    assert got[1].n_windows > 1
    empty = spark.createDataFrame([], conv.schema)
    assert [r.conv_id for r in chat.chat_report(empty, spark).collect()] == [-1]


# --- 5 top-k --------------------------------------------------------------------


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.2, (130, 16)).astype(np.float32)
    rows = [(i, [float(v) for v in x[i]]) for i in range(130)]
    rows[7] = (7, rows[3][1])  # a tie
    rows += [(7, rows[7][1]), (500, None), (501, [None] + rows[0][1][1:]), (502, [float("nan")] * 16), (None, rows[0][1]), (503, [1.0, 2.0])]
    from pyspark.sql import functions as F

    rows[20] = (10, rows[11][1])  # another vector under the id of a query
    rows += [(30, rows[30][1]), (4, rows[4][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("x")).withColumn("salt", F.lit(1))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, block=32).collect())
    z = [(i, tuple(np.floor(256 * np.array(v, np.float32).astype(float)).astype(int))) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and v[0] == v[0]]
    want = []
    for q in {i for i, _ in z if i % 10 == 0}:
        s = sorted((-int(np.dot(x, y)), c) for x in {v for i, v in z if i == q} for c, y in z if c != q)[:5]
        want += [(q, k + 1, c, -v) for k, (v, c) in enumerate(s)]
    assert got == sorted(want)
    assert topk.topk_report(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_topk_bounds_never_lose_a_candidate():
    rng = np.random.default_rng(3)
    q, c = rng.integers(-200, 200, (5, 12)).astype(float), rng.integers(-200, 200, (40, 12)).astype(float)
    for s in topk.LEVELS[:2]:
        (mq, dq), (mc, dc) = topk.segment_stats(q, s), topk.segment_stats(c, s)
        assert ((mq @ mc.T + dq @ dc.T) >= q @ c.T - 1e-6).all()


def test_topk_wide_values(spark):
    rows = [(0, [1e18, 1.0]), (1, [1e18, 2.0]), (2, [-1e18, 0.0])]
    got = topk.topk_report(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, (1 << 63) - 1), (2, -(1 << 63))]
    rows = [(0, [7.5e305, 1.0]), (1, [1e308, 2.0]), (2, [-1e308, 0.0])]
    got = topk.topk_report(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, (1 << 63) - 1), (2, -(1 << 63))]


def test_topk_equals_its_sql(spark, tmp_path):
    """Operator and SQL on repeated rows, ties and rows that take no part."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(9)
    rows = [(int(i), rng.normal(0, 1, 8).astype(np.float32).tolist()) for i in rng.integers(0, 400, 600)]
    rows += [rows[0], rows[1], (50, None), (100, [None] * 8), (None, [0.0] * 8), (150, [float("inf")] * 8)]
    pq.write_table(pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32()))}), f"{tmp_path}/e.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e.parquet'")
    want = sorted(con.sql("SELECT query_id, rank, vec_id, score FROM (" + topk.ORACLE + ")").fetchall())
    got = sorted(tuple(r) for r in topk.topk_report(spark.read.parquet(f"{tmp_path}/e.parquet")).select("query_id", "rank", "vec_id", "score").collect())
    assert got == want


def test_topk_prunes_blocks_and_loses_nothing():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 200, (6, 32))
    blocks = [np.floor(c + rng.normal(0, 5, (50, 32))) for c in centres]
    q = blocks[0][:10]
    boxes = np.stack([topk.box_of(b) for b in blocks])
    best = max((q @ b.T).max() for b in blocks)
    for limit in (best, best * 0.9, -np.inf, 1e12):
        keep = topk.box_bounds(topk.box_of(q), boxes, limit)
        assert all(keep[i] for i, b in enumerate(blocks) if (q @ b.T).max() >= limit)
    assert topk.box_bounds(topk.box_of(q), boxes, best).sum() < len(blocks) and not topk.box_bounds(topk.box_of(q), boxes, 1e12).any()


# --- 6 personal data ------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", ".", "-", "_", " ", "1", "25", "300", "4111 1111 1111 1111", "+1 (319) 555-5132", "x@y.z", "é", "(", "00"]), max_size=14).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


@pytest.fixture(scope="module")
def network():
    import random

    rng = random.Random(4)
    prose = [" ".join(rng.choice(("the", "and", "of", "words", "call", "today", "mail", "Now", pii._name(rng))) for _ in range(200)) + "." for _ in range(40)]
    return pii.train(prose)


def test_pii_network_adds_spans_and_keeps_base(spark, network, monkeypatch):
    monkeypatch.setattr(pii, "fit", lambda d, sample=0: network)
    texts = [(1, "mail bob.smith@example.com or 10.0.0.1 now"), (2, None), (3, ""), (4, "nothing to see"), (5, "call (319) 555-5132 today please"), (1, "mail bob.smith@example.com or 10.0.0.1 now")]
    got = pii.pii_report(docs(spark, texts)).collect()
    assert len(got) == 6
    for r in got:
        text = dict(texts)[r.doc_id] or ""
        assert r.base_sha256 == pii.base_digest(text)
        spans = [tuple(s.split(":")) for s in r.spans.split(",") if s]
        assert {(k, int(a), int(b)) for k, a, b in spans} >= {(k, a, b) for a, b, k in plain_base(text)}
        assert r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added == len(spans)
    assert next(r for r in got if r.doc_id == 4).spans == ""
    assert next(r for r in got if r.doc_id == 5).n_added == 1


def test_pii_gradient_is_the_slope(monkeypatch):
    monkeypatch.setattr(pii, "LOCAL", 0.0)  # it is not part of the likelihood
    net = pii.Net(1)
    x, gold, lens = np.random.default_rng(0).integers(1, 100, (7, 2)), np.zeros((7, 2), int), np.array([5, 7])
    gold[2:4] = [[1, 1], [2, 2]]
    em, kept = net.run(x, lens, keep=True)
    _, d_em, d_tr = net.crf(em.astype(float), gold, lens)
    g = net.grad(d_em, kept) | {"tr": d_tr}
    for name, at in (("wh", (1, 2, 9)), ("wh", (0, 40, 3)), ("out", (1, 4)), ("out", (2, 20)), ("emb", (3, int(x[0, 0]))), ("wx", (0, 3, 5)), ("wx", (1, 60, 8)), ("tr", (1, 2)), ("tr", (0, 0))):
        old = net.p[name][at]
        values = []
        for step in (1e-2, -1e-2):
            net.p[name][at] = old + step
            values.append(net.crf(net.run(x, lens)[0].astype(float), gold, lens)[0])
        net.p[name][at] = old
        assert abs((values[0] - values[1]) / 2e-2 - g[name][at]) < 5e-3


def test_pii_padding_and_batching_change_nothing(network):
    finder = pii.Finder(network)
    one, _ = finder.emissions(["call (319) 555-5132 today"])
    many, at = finder.emissions(["x" * 700, "call (319) 555-5132 today", "y"])
    assert np.abs(one - many[at[1] : at[2]]).max() < 1e-4


def test_pii_skipping_is_exact(network):
    """Tags of whole texts by Viterbi over every character are those of the stretches alone."""
    import random

    rng, finder = random.Random(8), pii.Finder(network)
    for _ in range(12):
        text = " ".join(pii.made_up(rng)[0] if rng.random() < 0.05 else pii._name(rng) for _ in range(400))
        em, at = finder.emissions([text])
        whole = pii.viterbi(em[:, None], finder.tr, finder.first)[:, 0]
        inside = np.zeros(len(whole), bool)
        for a, b in finder.stretches(em, at):
            inside[a:b] = True
            assert (pii.viterbi(em[a:b, None], finder.tr, finder.first)[:, 0] == whole[a:b]).all()
        assert not whole[~inside].any()


def test_pii_network_finds_planted_variants(network):
    """Fails with an empty network: values that the patterns miss, in text it was not trained on."""
    import random

    rng, finder = random.Random(77), pii.Finder(network)
    texts, want, decoys = [], [], []
    while len(want) < 120:
        value, kind = pii.made_up(rng)
        text = f"some other prose that leads up to it {value} and more that follows after it"
        if kind is None:
            decoys.append(text)
        elif not pii.base_spans(text):
            texts.append(text), want.append((text.index(value), text.index(value) + len(value), kind))
    hit = [any(k == kind and a < b2 and a2 < b for a2, b2, k in found) for (a, b, kind), found in zip(want, finder.find(texts))]
    assert sum(hit) >= 0.8 * len(hit)
    assert sum(map(bool, finder.find(decoys))) <= 0.05 * len(decoys)
    empty = pii.Finder({k: np.zeros_like(v) for k, v in network.items()})
    assert not any(empty.find(texts))


def test_pii_very_long_texts(network, monkeypatch):
    monkeypatch.setattr(pii, "PIECE", 1000)
    finder = pii.Finder(network)
    value = "(319) 555-5132"
    text = ""
    for at in (300, 993, 1500, 2995, 3999):  # across the edges of pieces too
        text = (text + " the and of words" * 300)[:at] + " " + value + " "
    found = finder.find([text])[0]
    assert len(found) == len(set(found)) and len(found) == 5
    assert all("319) 555-5132" in text[a - 1 : b + 1] for a, b, _ in found)
    assert finder.find(["0" * 5000 + ".0.0.0", "7" * 5000])
    assert pii.base_spans("0" * 5000 + ".1.2.3") == [(0, 5006, "ip")]


def test_pii_empty_table_and_clashing_columns(spark, network, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(pii, "fit", lambda d, sample=0: network)
    assert pii.pii_report(docs(spark, [])).count() == 0
    more = docs(spark, [(1, "mail bob@example.com"), (None, "+1 (319) 555-5132")])
    for c in ("spans", "n_email", "kind", "base", "_id"):
        more = more.withColumn(c, F.lit("x"))
    assert sorted(str(r.doc_id) + r.spans for r in pii.pii_report(more).collect()) == ["1email:5:20", "Nonephone:0:17"]
    assert pii.redact(more, network).columns == more.columns


def test_pii_learns_from_any_part_of_a_long_text(spark):
    from pyspark.sql import functions as F

    text = "".join(chr(0x4E00 + k) for k in range(5000))
    rows = docs(spark, [(k, text) for k in range(200)] + [(-1, "short"), (-2, ""), (-3, None)])
    got = rows.select("doc_id", pii.stretch(F.coalesce("text", F.lit("")), F.col("doc_id"), 1000).alias("s")).collect()
    places = [text.index(r.s) for r in got if r.doc_id >= 0]
    assert all(len(r.s) == 1000 for r in got if r.doc_id >= 0) and min(places) < 400 and max(places) > 3600 and max(places) <= 4000
    assert {r.doc_id: r.s for r in got if r.doc_id < 0} == {-1: "short", -2: "", -3: ""}


def test_pii_fit_without_documents(spark, monkeypatch):
    monkeypatch.setattr(pii, "train", lambda texts: texts)
    assert pii.fit(docs(spark, [])) == [] and pii.fit(docs(spark, [(1, "a"), (1, "b"), (None, "c")])) == ["a"]


def test_redact_takes_effect(spark, network):
    r = pii.redact(docs(spark, [(1, "mail bob@example.com now"), (2, None)]), network).orderBy("doc_id").collect()
    assert r[0].text == "mail <email> now" and r[0].n_chars == len(r[0].text) and r[1].text is None


# --- 7 Jaccard join -------------------------------------------------------------


def plain_components(rows):
    def shingle_set(t):
        w = WORD.findall(lower(t))
        return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i != j and a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return sorted((i, len(s), find(i)) for i, s in sets)


def test_jaccard_against_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"v{i}" for i in range(400)]
    rows, passage = [], " ".join(rng.choice(vocabulary, 60))
    for k in range(60):
        words = list(rng.choice(vocabulary, rng.integers(1, 260)))
        base = " ".join(words) + (" " + passage if k % 3 == 0 else "")
        for copy in range(rng.integers(1, 5)):
            w = base.split()
            for _ in range(copy * max(1, len(w) // 90)):
                w[rng.integers(len(w))] = "edit"
            rows.append((len(rows), " ".join(w) if copy != 2 else base.upper()))
    rows += [(900, None), (901, "  \n "), (902, "one two"), (903, "ONE two"), (5, rows[5][1]), (904, "a b c d " * 3000), (905, "a b c d " * 2999)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, rows)).collect())
    assert got == plain_components(rows)


def test_tree_finds_every_pair_within_the_bound(spark, monkeypatch):
    """The self-join of the trees against all pairs of points of a cell."""
    monkeypatch.setattr(jaccard, "LEAF", 4)
    monkeypatch.setattr(jaccard, "COARSE", 16)
    rng = np.random.default_rng(11)
    rows, points = [], {}
    for doc in range(160):
        if doc % 4 and rng.random() < 0.8:  # near another one
            h = points[doc - 1][0].copy()
            h[rng.integers(0, len(h), len(h) // 30)] = rng.integers(0, 1 << 62, len(h) // 30)
        else:
            h = rng.integers(0, 1 << 62, int(rng.integers(30, 300)))
        h = np.unique(h)
        n, g = len(h), jaccard.coordinates_of(len(h))
        point = np.bincount(h & (g - 1), minlength=g)
        points[doc] = h, point
        for cell in (7, 8 + doc % 3):
            rows.append((cell, doc, int(doc // 2 % 9), n, bytearray(jaccard.pack(np.minimum(point, 255).astype(np.uint8))), point.reshape(-1, 16).sum(0).tolist()))
    df = spark.createDataFrame(rows, "cell bigint, doc bigint, comp bigint, n bigint, counts binary, coarse array<int>")
    inside = df.join(df.groupBy("cell").count().withColumnRenamed("count", "m"), "cell")
    leaves = jaccard.tree_leaves(inside)
    assert leaves.count() > 40
    got = {(r.a, r.b) for r in jaccard.leaf_pairs(leaves).mapInPandas(jaccard._leaf_pairs, "a bigint, b bigint").collect()}
    want = set()
    for a in range(160):
        for b in range(a + 1, 160):
            (x, p), (y, q) = points[a], points[b]
            size = min(len(p), len(q))
            overlap = np.minimum(p.reshape(-1, size).sum(0), q.reshape(-1, size).sum(0)).sum()
            if a // 2 % 9 != b // 2 % 9 and jaccard._able(len(x), len(y)) and overlap * 185 >= 85 * (len(x) + len(y)):
                want.add((a, b))
    assert got == want and want


def test_jaccard_dense_group_without_an_original(spark):
    """Copies of a text that is not there, some linked and some not, beside texts that share a passage with them."""
    rng = np.random.default_rng(12)
    base = [f"t{i}" for i in range(600)]
    rows = []
    for k in range(90):
        w = list(base)
        for i in rng.choice(600, 3 + k % 6, replace=False):
            w[i] = f"e{k}x{i}"
        rows.append((1000 - k, " ".join(w)))
    rows += [(k, " ".join(base[:200] + [f"o{k}y{i}" for i in range(30)])) for k in range(20)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, rows)).collect())
    want = plain_components(rows)
    assert got == want and 2 < len({c for _, _, c in want}) < 100


def test_jaccard_empty_and_null_ids(spark):
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0
    got = jaccard.jaccard_components(docs(spark, [(None, "a b c d e"), (3, "a b c d e"), (2, "A b c d e")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("2", "2"), ("3", "2"), ("None", "None")]


def test_linking_sets_share_a_cell():
    rng = np.random.default_rng(5)
    with np.errstate(over="ignore"):
        for n in (6, 11, 12, 31, 33, 60, 64, 200, 520, 1000, 2047, 4100):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2))
            for less, more in ((n * 15 // 100, 0), (0, n * 15 // 85), (n * 7 // 100, n * 7 // 100)):
                b = np.sort(np.concatenate([a[rng.permutation(n)[: n - less]], rng.integers(0, 1 << 63, more, dtype=np.int64).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if 100 * both < 85 * (len(a) + len(b) - both):
                    continue
                cells = [set(np.concatenate([jaccard.cells_of(s, c) for c in jaccard.classes_of(len(s))]).tolist()) for s in (a, b)]
                assert cells[0] & cells[1]


# --- 8 decontamination ----------------------------------------------------------


def test_decontamination_against_brute_force(spark, monkeypatch):
    long = " ".join(f"q{i}" for i in range(14))
    bench = spark.createDataFrame([(1, long), (2, "Short item"), (3, None), (4, "..."), (1, "other text"), (None, "no id here")], "item_id bigint, text string")
    texts = [(1, "x " + long.upper().replace(" ", ", ") + " y"), (2, " ".join(long.split()[:9])), (3, "SHORT-ITEM! short  itemx"), (4, None), (5, ""), (6, "é no id here é"), (1, "again short item")]
    want = None
    for shard in (4_000_000, 20):
        monkeypatch.setattr(decontaminate, "SHARD_CHARS", shard)
        got = decontaminate.contamination_report(docs(spark, texts), bench).collect()
        rows = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got)
        assert want is None or rows == want
        want = rows
    d = lambda ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    assert want == sorted([
        (1, 16, 14, 1, d(["1"]), True), (2, 9, 0, 0, d([]), False), (3, 4, 2, 1, d(["2"]), True), (4, 0, 0, 0, d([]), False),
        (5, 0, 0, 0, d([]), False), (6, 5, 3, 1, d([""]), True), (1, 3, 2, 1, d(["2"]), True),
    ])
    spans = {r.doc_id: r.spans for r in decontaminate.find_contamination(docs(spark, texts[2:3]), bench).collect()}
    assert [(s.start, s.end) for s in spans[3]] == [(0, 10)]
    assert decontaminate.drop_contaminated(docs(spark, texts), bench).count() == 3
    assert decontaminate.contamination_report(docs(spark, texts), bench.limit(0)).where("contaminated").count() == 0


# --- 9 mixing -------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mixing_targets_and_balance(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    rng = np.random.default_rng(6)
    texts, sources = [], []
    for k in range(900):
        s = ["a", "b", "c", "Z", None, "d"][min(5, int(rng.exponential(1.2)))]
        texts.append((k, " ".join(["w"] * int(rng.integers(0, 60)))))
        sources.append(s)
    texts += [(900, None), (1, texts[1][1])]
    sources += ["a", sources[1]]
    df = docs(spark, texts, sources)
    got = mixing.mix_report(df).collect()
    again = mixing.mix_report(df.repartition(3)).collect()
    key = lambda r: (r.doc_id, r.size, r.taken, str(r.source), round(r.target, 6))
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(texts)
    sizes = Counter()
    for (i, t), s in zip(texts, sources):
        sizes[s] += len(WORD.findall(t or ""))
    want = plain_targets(sizes)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) and 0 <= r.taken <= 2 * r.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= 60
    assert mixing.mix_report(docs(spark, [])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(0, 500)), min_size=1, max_size=60), st.integers(0, 9))
def test_flight_keeps_totals(units, seed):
    import random

    prob, x = [p for p, _ in units], [float(s) for _, s in units]
    n, total = sum(prob), sum(p * s for p, s in zip(prob, x))
    held = mixing.flight(prob, x, random.Random(seed))
    assert len(held) <= 2 and all(p in (0.0, 1.0) for i, p in enumerate(prob) if i not in held)
    assert abs(sum(prob) - n) < 1e-5 and abs(sum(p * s for p, s in zip(prob, x)) - total) < 1e-2
    mixing.land(prob, x, random.Random(seed), held)
    assert set(prob) <= {0.0, 1.0}


# --- 10 toxicity ----------------------------------------------------------------


def toxic_corpus(n=240):
    rng = np.random.default_rng(7)
    plain = ["the", "house", "runs", "green", "over", "water", "seven", "paper", "light", "stone"]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, 40 + i % 60))
        bad = i % 4 == 0
        if bad:
            words[int(rng.integers(len(words)))] = ["rubbishperson", "rubbishpersons", "rubbissperson"][i % 3]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out_and_misspellings(spark):
    rows, labels = toxic_corpus()
    rows += [(1000, "the house runs green over rubbishpersom water seven paper light"), (1001, None), (1002, ""), (1003, "the house runs green")]
    lab = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    df = docs(spark, rows)
    got = {r.doc_id: r for r in toxicity.toxicity_report(df, lab).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(got[i].predicted, y) for i, _, y in labels if got[i].held_out]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert got[1000].predicted == 1 and got[1003].predicted == 0 and got[1001].score == got[1002].score < 0.5
    kept = toxicity.drop_toxic(df, toxicity.fit(df, lab))
    assert kept.count() == sum(1 for r in got.values() if not r.predicted) and kept.columns == df.columns


def test_toxicity_without_labels(spark):
    df = docs(spark, [(1, "a b c"), (2, None)])
    got = toxicity.toxicity_report(df, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect()
    assert {round(r.score, 6) for r in got} == {0.5}


def test_extra_columns_do_not_clash(spark):
    from pyspark.sql import functions as F

    rows, labels = toxic_corpus(40)
    extra = docs(spark, rows)
    for c in ("_key", "n", "cell", "a", "b", "score", "bucket", "size", "target", "y", "_id", "block", "comp", "doc", "held"):
        extra = extra.withColumn(c, F.lit("x"))
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("text", F.lit(1))
    assert toxicity.toxicity_report(extra, lab).count() == 40
    assert jaccard.jaccard_components(extra).count() == 40 and mixing.mix_report(extra).count() == 40
    assert lm.lm_scores(extra).count() == 40 and licenses.license_report(extra).count() == 40
    assert separators.token_count_report(extra).count() == 40
    assert decontaminate.contamination_report(extra, lab.select(F.col("doc_id").alias("item_id"), F.lit("zz").alias("text"), "quality")).count() == 40
