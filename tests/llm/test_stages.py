"""Stages of the pipeline and the operators behind them against plain versions, with null and repeated ids."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from seqloom.llm import chat, decontaminate, licenses, mixing, pii, separators, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, rows):
    """rows of (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


@pytest.fixture
def folder(spark, tmp_path):
    """A table folder with benchmark and labels."""
    rng = random.Random(1)
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    bench = " ".join(f"b{i}" for i in range(14))
    spark.createDataFrame([(1, bench)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = ["the", "house", "runs", "green", "over", "water", "seven", "paper", "light", "stone", "under", "tree"]
    rows = []
    for i in range(200):
        words = [rng.choice(plain) + str(rng.randint(0, 9)) for _ in range(60)]
        if i % 4 == 0:
            words[rng.randrange(60)] = "rubbishperson"
        rows.append((i, " ".join(words), "ab"[i % 2]))
    rows += [(1, rows[1][1] + " more", "a"), (1, "a wholly different text that shares the number of another", "a"), (2, rows[2][1], "a")]
    rows += [(None, None, None), (None, rows[3][1], "b"), (None, "one of no number at all, alone", None), (None, "", "b"), (300, "x " + bench, "b")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def jaccard_classes(texts):
    def shingles(t):
        w = WORD.findall((t or "").lower())
        return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def test_near_copies_keep_one_row_of_each_group(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    kept = corpus_pipeline.without_near_copies(spark, table, folder)
    assert kept.columns == table.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    classes = jaccard_classes([t for _, t in rows])
    assert len(got) == len(set(classes)) and not Counter(got) - Counter(rows)
    of = {t: c for (_, t), c in zip(rows, classes)}
    assert len({of[t] for _, t in got if t}) == len([t for _, t in got if t])
    for c in set(classes):  # of each group the smallest doc_id stays
        ids = [i for (i, t), k in zip(rows, classes) if k == c and t]
        if ids:
            assert [i for i, t in got if t and of[t] == c] == [min(ids, key=lambda i: (i is None, i))]
    again = corpus_pipeline.without_near_copies(spark, table.repartition(7), folder).collect()
    assert Counter((r.doc_id, r.text) for r in again) == Counter(got)


def test_near_copies_probe_of_shared_ids(spark, folder):
    three = docs(spark, [(1, "one two three four five", "a"), (1, "six seven eight nine ten", "a"), (2, "eleven twelve thirteen fourteen", "a")])
    assert corpus_pipeline.without_near_copies(spark, three, folder).count() == 3


def test_toxic_stage_is_the_score(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    want = Counter((r.doc_id, r.predicted) for r in toxicity.toxicity_report(table, labels).collect())
    kept = corpus_pipeline.without_toxic(spark, table, folder)
    got = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == table.columns
    assert got == Counter(i for (i, p), n in want.items() for _ in range(n) if not p)


def test_benchmark_stage(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.without_benchmarks(spark, table, folder)
    assert kept.columns == table.columns and kept.count() == table.count() - 1 and not kept.where("doc_id = 300").count()


def test_personal_data_stage(spark, folder, monkeypatch):
    monkeypatch.setattr(pii, "fit", lambda d: {k: np.zeros_like(v) for k, v in pii.Net().p.items()})
    table = docs(spark, [(1, "mail a@b.cd now", "a"), (1, "mail a@b.cd now", "a"), (None, None, "a"), (2, "x" * 30_000 + " 10.0.0.1", None)])
    got = corpus_pipeline.without_personal_data(spark, table, folder)
    assert got.columns == table.columns
    assert Counter((r.doc_id, r.text, r.n_chars) for r in got.collect()) == Counter(
        [(1, "mail <email> now", 16)] * 2 + [(None, None, 0), (2, "x" * 30_000 + " <ip>", 30_005)]
    )


def test_mixing_stage_carries_documents(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.mixed(spark, table, folder)
    assert set(table.columns) <= set(got.columns)
    rows = Counter((r.doc_id, r.text, r.source) for r in table.collect())
    taken = Counter()
    for r in got.collect():
        assert rows[(r.doc_id, r.text, r.source)] and r.copies > 0 and r.taken == r.copies * r.size == r.copies * len(WORD.findall(r.text or ""))
        taken[r.source] += r.taken
    targets = {r.source: r.target for r in got.collect()}
    assert all(abs(taken[s] - t) <= 130 for s, t in targets.items())


def test_run_applies_all_stages(spark, folder, monkeypatch):
    monkeypatch.setattr(pii, "fit", lambda d: {k: np.zeros_like(v) for k, v in pii.Net().p.items()})
    docs_ = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs_ = stage(spark, docs_, folder)
    want = Counter((r.doc_id, r.text, r.copies) for r in docs_.collect())
    assert Counter((r.doc_id, r.text, r.copies) for r in corpus_pipeline.run(spark, folder).collect()) == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "personal_data", "source_mixing"]


# --- operators --------------------------------------------------------------------


def test_log_odds_against_a_plain_version():
    """Every window's n-grams one by one: the same highest window."""
    rng = np.random.default_rng(3)
    weight, bias = rng.normal(size=1 << toxicity.BITS).astype(np.float32), 0.25
    fold = lambda b: b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32

    def plain(text):
        data = [32, *map(fold, text), 32]
        best = None
        for begin in range(0, max(1, len(text) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
            total = count = 0
            for at in range(begin, min(begin + toxicity.WINDOW, len(text) + 1)):
                for order in toxicity.ORDERS:
                    gram = data[at : at + order]
                    if len(gram) < order or 32 in gram[1:-1] or (gram[0] == gram[-1] == 32 and order > 3) or (order == 3 and gram[1] == 32):
                        continue
                    h = gram[0]
                    for b in gram[1:]:
                        h = ((h * 0x01000193) & 0xFFFFFFFF) ^ b
                    total += float(weight[((h * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - toxicity.BITS)])
                    count += 1
            z = total / max(count, toxicity.LEAST)
            best = z if best is None else max(best, z)
        return bias + best

    texts = [b"", b"a", b"Hello, you THERE " * 20, "größe und süße".encode(), b"x" * 61, b"ab cd " * 300]
    got, _ = toxicity.log_odds(texts, weight, bias)
    assert np.allclose(got, [plain(t) for t in texts], atol=1e-4)


def test_toxicity_bounds_count_present_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.append(texts))
    labels = spark.createDataFrame([(i, 1, 1) for i in range(1000)] + [(5003, 1, 0), (5003, 1, 0)], "doc_id bigint, quality int, toxic int")
    table = docs(spark, [(5003, "here", "a"), (7, "there " * 100, "a")])
    toxicity.fit(table, labels, sample=3)
    assert sorted(seen[-1]) == [b"here", b"here", b"there " * 100]
    toxicity.fit(table, labels, sample=2)
    assert len(seen[-1]) == 2
    toxicity.fit(docs(spark, []), labels)
    assert seen[-1] == []


def test_windows_stay_within_the_budget(spark):
    turns = [(1, 0, "system", "s " * 400), *[(1, k, "user" if k % 2 else "assistant", "w " * 197) for k in range(1, 4)], (1, 4, "user", "y " * 900)]
    w = chat.chat_windows(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string"), budget=512, history=128)
    for r in w.collect():
        assert r.n_tokens <= 512 or len(chat.parse(r.formatted)) == 1
    more = spark.createDataFrame([(1, 0, "user", "a", 5, 6)], "conv_id bigint, turn bigint, role string, text string, window int, formatted int")
    assert chat.read_back(chat.chat_windows(more)).count() == 1


def test_plain_bound_loses_no_spelling(spark):
    known = [("A", "license " * 300)]
    texts = [(1, "licence " * 300, "a"), (2, "https " * 300, "a")]
    got = {r.doc_id: r.license for r in licenses.license_scan(docs(spark, texts), known + [("B", "http " * 300)]).collect()}
    assert got == {1: "A", 2: "B"}
    twice = licenses.license_scan(docs(spark, [(1, "Released under the MIT License.", "a"), (1, "x", "a")])).collect()
    assert [r.license for r in twice] == ["MIT", "MIT"]


def test_wide_ids_do_not_wrap(spark, monkeypatch):
    monkeypatch.setattr(separators, "EOD", 70_000)
    table = docs(spark, [(1, "a b", "a"), (2, "", "a"), (None, None, "a")])
    enc = separators.load_encoding()
    assert separators.kind_of(enc, 70_000) == "uint32"
    got = separators.separator_counts(separators.token_files(table, eod=70_000), eod=70_000, kind="uint32").collect()
    assert sorted(r.n_tokens for r in got) == [0, 0, 2]
    assert separators.token_count_report(docs(spark, [])).count() == 0


def test_benchmarks_of_several_shards_and_repeated_items(spark, monkeypatch):
    items = [" ".join(f"q{k}x{i}" for i in range(12)) for k in range(6)]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] * 3, "item_id bigint, text string")
    text = "start " + items[0] + " middle " + items[4] + " " + items[5] + " end"
    for size in (10**6, 40):
        monkeypatch.setattr(decontaminate, "SHARD_CHARS", size)
        r = decontaminate.find_contamination(docs(spark, [(1, text, "a")]), bench).first()
        assert (r.n_words, r.n_hit, list(r.item_ids)) == (39, 36, ["0", "4", "5"]) and len(r.spans) == 2
        assert decontaminate.drop_contaminated(docs(spark, [(1, text, "a"), (2, "fine", "a")]), bench).count() == 1


def test_mixing_spreads_rows_without_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rows = [(None, f"w{i} " * (1 + i % 7), "a") for i in range(200)] + [(3, "same text", "a")] * 40
    got = mixing.mix_report(docs(spark, rows)).collect()
    assert len(got) == 240 and all(0 <= r.taken <= 2 * r.size for r in got)
    assert abs(sum(r.taken for r in got) - got[0].target) <= 20


def test_very_long_texts(spark):
    """One text of some megabytes beside short ones, for the operators that read texts."""
    from seqloom.llm import jaccard, lm

    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(300_000))
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    table = docs(spark, [(1, long + " " + item + " end", "a"), (2, "short text here", "a"), (3, long + " " + item + " end of it", "b")])
    bench = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    c = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.contamination_report(table, bench).collect()}
    assert c == {1: (300_011, 10), 2: (3, 0), 3: (300_013, 10)}
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(table).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id: r.n_tokens for r in lm.lm_scores(table).collect()} == {1: 300_012, 2: 4, 3: 300_014}
    assert {r.doc_id: r.size for r in mixing.mix_report(table).collect()} == {1: 300_011, 2: 3, 3: 300_013}
    model = (np.zeros(1 << toxicity.BITS, np.float32), 0.0)
    assert all(r.score == 0.5 for r in toxicity.score(table, model).collect())
    enc = separators.load_encoding()
    assert {r.doc_id: r.n_tokens for r in separators.token_count_report(table).collect()} == {r.doc_id: len(enc.encode_ordinary(r.text)) for r in table.collect()}


def test_empty_tables(spark):
    empty = docs(spark, [])
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert decontaminate.contamination_report(empty, bench).count() == 0 and decontaminate.drop_contaminated(empty, bench).count() == 0
    assert toxicity.toxicity_report(empty, labels).count() == 0 and mixing.mix(empty).count() == 0


def test_stages_keep_clashing_columns(spark, folder, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(pii, "fit", lambda d: {k: np.zeros_like(v) for k, v in pii.Net().p.items()})
    table = spark.read.parquet(f"{folder}/documents.parquet").limit(40)
    for c in ("_r", "b", "none", "hash", "component_id", "hits", "items", "score", "block", "held", "copies", "_key"):
        table = table.withColumn(c, F.lit("x"))
    table = table.cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, folder).columns == table.columns, name
        assert stage(spark, table, folder).count() > 0
    mixed = corpus_pipeline.mixed(spark, table, folder)
    assert mixed.columns.count("copies") == 1 and mixed.count() > 0


def test_labels_repeat(spark, monkeypatch):
    """A repeated label counts as often as it occurs."""
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.append((texts, y)))
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    toxicity.fit(docs(spark, [(1, "one", "a")]), labels)
    assert seen[-1] == ([b"one"] * 3, [0, 1, 1])
