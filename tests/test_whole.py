"""Queries over tables where every row counts, against plain Python."""

import datetime
import difflib
import random
import re
from collections import Counter, defaultdict

from seqloom.plans import interval_queries, text_queries

TEXTS = [
    None, "", "a", "ab", "abc", "  two words ", "é ü\tß\n\nx", "😀 b😀c", "w" * 350, " ".join(f"w{k}" for k in range(80)),
    "\n".join("  ".join(f"ä{k * j}" for k in range(70)) for j in range(60)),
]


def documents(spark, tmp_path):
    rows = [(k, t, "en") for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_token_offsets_of_all_lengths(spark, tmp_path):
    got = sorted(tuple(r) for r in text_queries.token_offsets(spark, documents(spark, tmp_path)).collect())
    want = [(d, i, m.group(), m.start(), m.end()) for d, t in enumerate(TEXTS) for i, m in enumerate(re.finditer(r"\S+", t or ""))]
    assert got == sorted(want)


def test_char_context_of_all_lengths(spark, tmp_path):
    def middle(t):
        if t is None:
            return (None, None, None)
        k = len(t) // 2
        return (t[max(k - 3, 0):k - 1], t[k - 1], t[k:k + 2]) if k else ("", None, "")

    got = sorted(tuple(r) for r in text_queries.char_context(spark, documents(spark, tmp_path)).select("doc_id", "before", "letter", "after").collect())
    assert got == [(d, *middle(t)) for d, t in enumerate(TEXTS)]


def events(spark, tmp_path):
    """Rows (user_id, ts, event_id, event_type, value) of users below and above any bound, with days without events."""
    draw = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    rows = [
        (u, start + datetime.timedelta(days=day, seconds=draw.randrange(86400)), 0, draw.choice("abcd"), float(draw.randrange(300)))
        for u in (1, 39, 40, 977) for day in (0, 1, 2, 5, 8, 9, 10, 11, 20) for _ in range(draw.randrange(6))
    ]
    rows = [(u, t, k, x, v) for k, (u, t, _, x, v) in enumerate(rows)]
    spark.createDataFrame(rows, "user_id bigint, ts timestamp_ntz, event_id bigint, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path), rows


def user_days(rows):
    """(user_id, date) -> [(place in the user's sequence, event_type)]."""
    days, n = defaultdict(list), Counter()
    for u, t, _, x, _ in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        days[u, t.date()].append((n[u], x))
        n[u] += 1
    return days


ONE = datetime.timedelta(days=1)


def test_greedy_word_match_of_every_user_and_day(spark, tmp_path):
    path, rows = events(spark, tmp_path)
    days, want = user_days(rows), []
    for (u, day), a in days.items():
        rest = list(days.get((u, day + ONE), []))
        for place, x in a:
            at = next((i for i, (_, y) in enumerate(rest) if y == x), None)
            want.append((u, day, place, -1 if at is None else rest[at][0], x))
            rest = rest if at is None else rest[at + 1:]
    got = interval_queries.greedy_word_match(spark, path).select("user_id", "day", "left_pos", "right_pos", "word").collect()
    assert sorted((r[0], r[1], r[2], -1 if r[3] is None else r[3], r[4]) for r in got) == sorted(want)
    assert len(got) == len(rows)


def test_diff_word_errors_of_every_user_and_day(spark, tmp_path):
    path, rows = events(spark, tmp_path)
    days, want = user_days(rows), Counter()
    for u, day in set(days) | {(u, day - ONE) for u, day in days}:
        x, y = ([w for _, w in days.get(k, [])] for k in ((u, day), (u, day + ONE)))
        for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            if tag != "equal":
                want.update(wrong=min(i2 - i1, j2 - j1), missing=max(i2 - i1 - (j2 - j1), 0), added=max(j2 - j1 - (i2 - i1), 0))
    assert {r.kind: r.n for r in interval_queries.diff_word_errors(spark, path).collect()} == dict(want)


def test_sets_of_every_event(spark, tmp_path):
    path, rows = events(spark, tmp_path)
    sets = defaultdict(lambda: (set(), set()))
    for u, t, _, x, _ in rows:
        sets[u, t.date() - t.weekday() * ONE][t.day % 2].add(x)
    want = {}
    for k, (x, y) in sets.items():
        p, r = len(x & y) / len(y) if y else 0, len(x & y) / len(x) if x else 0
        want[k] = (p, r, 2 * p * r / (p + r) if p + r else 0)
    got = {(r.user_id, r.week): r for r in interval_queries.prf_sets(spark, path).collect()}
    assert set(got) == set(want)
    for k, (x, y) in sets.items():
        assert all(abs(a - b) < 1e-5 for a, b in zip((got[k].precision, got[k].recall, got[k].f1), want[k]))
        assert (got[k].missing, got[k].extra) == (",".join(sorted(x - y)), ",".join(sorted(y - x)))
    mean = interval_queries.macro_prf(spark, path).first()
    assert all(abs(mean[i] - sum(w[i] for w in want.values()) / len(want)) < 1e-5 for i in range(3))
