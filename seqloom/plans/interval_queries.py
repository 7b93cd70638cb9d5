"""Interval joins, gaps, assignment, alignment and calibration over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import align, calibrate, evaluate, intervals, report, rules, scoring, severity
from . import acoustics
from .sequence_queries import RULES, SQL_CONTEXT, SQL_MATCH, _context
from .tables import KEY, ORDER, SQL_MICROS, SQL_POS, W, micros, positions, table

HOUR = 3_600_000_000
DAY = 24 * HOUR
SQL_SPANS = f"SELECT user_id, event_id, event_type, {SQL_MICROS} AS t0, {SQL_MICROS} + CAST(round(value * 60) AS BIGINT) * 1000000 AS t1 FROM events"
SQL_WINDOWS = f"""SELECT user_id, d AS ordinal, d * {DAY} + 9 * {HOUR} AS w0, d * {DAY} + 17 * {HOUR} AS w1
    FROM (SELECT DISTINCT user_id FROM events), unnest(range(0, 30)) AS t(d)"""


def _spans(spark, d):
    """Events as intervals: ``value`` minutes long."""
    e = table(spark, d, "events").withColumn("t0", micros())
    return e.select("user_id", "event_id", "event_type", "t0", (F.col("t0") + F.round(F.col("value") * 60).cast("bigint") * 1_000_000).alias("t1"))


def _windows(spark, d):
    """Nine to five of each of the thirty days, for each user."""
    u = table(spark, d, "events").select("user_id").distinct()
    u = u.withColumn("ordinal", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(29).cast("bigint"))))
    return u.select("user_id", "ordinal", (F.col("ordinal") * DAY + 9 * HOUR).alias("w0"), (F.col("ordinal") * DAY + 17 * HOUR).alias("w1"))


def overlap_pairs(spark, d):
    """Working hours and events that share more than ten minutes."""
    j = intervals.overlap_join(_spans(spark, d), _windows(spark, d), KEY, "t0", "t1", "w0", "w1", DAY, 600_000_000)
    return j.select("user_id", "event_id", "ordinal", F.col("overlap").cast("bigint").alias("overlap"))


def overlap_semi(spark, d):
    """Events that overlap an error of the same user by more than five minutes, each once."""
    s = _spans(spark, d)
    e = s.where("event_type = 'error'").select("user_id", F.col("t0").alias("e0"), F.col("t1").alias("e1"))
    o = intervals.overlap_join(s.where("event_type <> 'error'"), e, KEY, "t0", "t1", "e0", "e1", 4 * HOUR, 300_000_000, "left_semi")
    return o.select("user_id", "event_id")


def containment(spark, d):
    """Event starts inside working hours (closed at the start, open at the end)."""
    j = intervals.contains_join(_spans(spark, d), _windows(spark, d), KEY, "t0", "w0", "w1", DAY, closed=False)
    return j.groupBy("user_id").agg(F.count("*").alias("n_inside"))


def midpoint_assign_nearest(spark, d):
    """Each event's working day: the one that holds its midpoint, else the nearest centre."""
    s = _spans(spark, d)
    a = intervals.assign_midpoint(s, _windows(spark, d), KEY, "event_id", (F.col("t0") + F.col("t1")) / 2, "w0", "w1", "ordinal", DAY)
    return a.select("user_id", "event_id", F.col("window").alias("window_ordinal"), "inside")


def silence_complement(spark, d):
    """Quiet times of each user, before the first and after the last event included."""
    g = intervals.complement(_spans(spark, d), KEY, "t0", "t1", ["t0", "event_id"], F.lit(40 * DAY))
    return g.groupBy("user_id").agg(
        F.count("*").alias("n_gaps"), F.sum(F.col("gap_end") - F.col("gap_start")).cast("bigint").alias("quiet_us"),
        F.max(F.col("gap_end") - F.col("gap_start")).cast("bigint").alias("longest_us"),
    )


def pauses(spark, d):
    """Gaps of at least an hour inside a user's overall span."""
    g = intervals.complement(_spans(spark, d), KEY, "t0", "t1", ["t0", "event_id"])
    return g.where(f"ordinal > 1 AND gap_end - gap_start >= {HOUR}").select(
        "user_id", F.col("gap_start").cast("bigint").alias("gap_start"), F.col("gap_end").cast("bigint").alias("gap_end")
    )


def split_segments(spark, d):
    """Time of each user cut at errors; segments under an hour are dropped."""
    s = _spans(spark, d)
    total = s.select("user_id").distinct().withColumn("length", F.lit(31 * DAY))
    g = intervals.segments_from_splits(s.where("event_type = 'error'"), KEY, "t0", total, "length", HOUR)
    return g.select("user_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("start").cast("bigint").alias("start_us"), F.col("end").cast("bigint").alias("end_us"))


def rebase_timestamps(spark, d):
    """Times within a day -> times of the month: minus a padding, plus the day's offset."""
    s = _spans(spark, d).withColumn("day", F.floor(F.col("t0") / DAY))
    local = s.select("user_id", "event_id", "day", (F.col("t0") - F.col("day") * DAY + 500_000).alias("start_us"), (F.col("t1") - F.col("day") * DAY + 500_000).alias("end_us"))
    seg = s.select("day").distinct().withColumns({"offset": F.col("day") * DAY, "padding": F.lit(500_000)})
    return intervals.rebase(local, seg, ["day"], ["start_us", "end_us"], "offset", "padding").select("user_id", "event_id", "start_us", "end_us")


def suffix_align(spark, d):
    """Views and purchases of a user paired from the end."""
    e = table(spark, d, "events")
    v = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"))
    p = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"))
    return align.suffix_align(v, p, KEY, "view_id", "purchase_id").select("user_id", F.col("from_end").cast("bigint").alias("from_end"), "view_id", "purchase_id")


def ordinal_align(spark, d):
    e = table(spark, d, "events")
    v = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"))
    p = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"))
    return align.ordinal_align(v, p, KEY, "click_id", "signup_id").select("user_id", F.col("ordinal").cast("bigint").alias("ordinal"), "click_id", "signup_id")


def count_mismatch(spark, d):
    """Orders whose number of lines differs from the highest line number."""
    li = table(spark, d, "lineitem")
    expected = li.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("m")).select("l_orderkey", F.explode(F.sequence(F.lit(1), "m")).alias("k")).drop("k")
    return align.count_mismatch(expected, li.select("l_orderkey"), ["l_orderkey"])


def _next_days(spark, d):
    """Words of each user's days, and of the days after them under the same key; a day without events has no words."""
    p = positions(spark, d).select("user_id", F.to_date("ts").alias("day"), "pos", F.col("event_type").alias("word"))
    return p, p.withColumn("day", F.date_sub("day", 1))


def greedy_word_match(spark, d):
    """Event types of each day of each user matched greedily, in order, to those of the next day."""
    return align.greedy_word_match(*_next_days(spark, d), ["user_id", "day"], "pos", "word", strict=False)


def diff_word_errors(spark, d):
    """Missing, added and wrong events between each day of each user and the next, by sequence difference."""
    return align.word_errors(align.diff_opcodes(*_next_days(spark, d), ["user_id", "day"], "pos", "word")).groupBy("kind").agg(F.count("*").alias("n"))


def edit_script(spark, d):
    """The edit blocks between each day of each user and the next, by the table function in SQL."""
    align.register_edit_script(spark)
    left, right = _next_days(spark, d)
    one = lambda df, side: df.select(F.struct("user_id", "day").alias("k"), F.lit(side).alias("side"), "pos", "word")
    blocks = spark.sql("SELECT * FROM edit_script(TABLE({rows}), 'k', 'side', 'pos', 'word')", rows=one(left, 0).unionByName(one(right, 1)))
    return blocks.select("k.user_id", "k.day", "tag", "i1", "i2", "j1", "j2")


_SHORT, _LONG = "event_type IN ('view', 'click')", "event_type = 'purchase'"


def _calibration(c):
    return c.select(
        *[k for k in c.columns if k in ("user_id", "event_type")], F.round("unit_ms", 4).alias("unit_ms"), F.round("short_median_ms", 4).alias("short_median_ms"),
        "n_short", "n_long", F.round("short_std_ms", 4).alias("short_std_ms"), "is_default", "tolerance",
    )


def calibrate_group(spark, d):
    """Unit length of each user from short and halved long values."""
    return _calibration(calibrate.calibrate(table(spark, d, "events"), ["user_id"], "value", F.expr(_SHORT), F.expr(_LONG)))


def calibrate_all(spark, d):
    """The same over all rows of a kind by plain medians, where groups are too large for one array."""
    return calibrate.pooled_unit(table(spark, d, "events"), ["event_type"], "value", F.col("value") < 300).select(
        "event_type", "n", F.round("unit_ms", 4).alias("unit_ms"), "is_default"
    )


def calibrate_rollup(spark, d):
    """Median and count at every level: type and day, type, all."""
    e = table(spark, d, "events").withColumn("day", F.dayofmonth("ts"))
    return e.rollup("event_type", "day").agg(F.count("value").alias("n"), F.round(F.median("value"), 4).alias("m")).select(
        F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("day", F.lit(0)).cast("bigint").alias("day"), "n", "m"
    )


def _graded(spark, d):
    e = table(spark, d, "events")
    unit = calibrate.pooled_unit(e, ["event_type"], "value", F.lit(True)).select("event_type", "unit_ms")
    g = e.join(unit, "event_type").withColumn("counts", F.col("value") / F.col("unit_ms"))
    band = severity.range_band(F.col("counts"), F.lit(0.5), F.lit(2.0))
    return g.withColumn("severity", band)


SQL_UNIT = "SELECT event_type, CASE WHEN count(*) FILTER (WHERE value >= 30) >= 5 THEN median(value) FILTER (WHERE value >= 30) ELSE 107.0 END AS unit_ms FROM events GROUP BY event_type"
SQL_GRADED = f"""SELECT e.*, unit_ms, value / unit_ms AS counts, CASE WHEN value / unit_ms BETWEEN 0.5 AND 2.0 THEN NULL
    WHEN (CASE WHEN value / unit_ms < 0.5 THEN 0.5 - value / unit_ms ELSE value / unit_ms - 2.0 END) > 1.0 THEN 'major'
    WHEN (CASE WHEN value / unit_ms < 0.5 THEN 0.5 - value / unit_ms ELSE value / unit_ms - 2.0 END) > 0.5 THEN 'minor' ELSE 'style' END AS severity
    FROM events e JOIN ({SQL_UNIT}) u USING (event_type)"""


def severity_bands(spark, d):
    return _graded(spark, d).groupBy("event_type", "severity").agg(F.count("*").alias("n"))


def severity_downgrade(spark, d):
    g = _graded(spark, d)
    s = severity.near_boundary_downgrade(F.col("severity"), F.col("counts"), F.lit(0.5), F.lit(2.0), F.col("unit_ms"), 40.0)
    return g.withColumn("downgraded", s).groupBy("severity", "downgraded").agg(F.count("*").alias("n"))


def long_vowel_bands(spark, d):
    """The plain long vowel's bands over event values."""
    g = _graded(spark, d)
    return g.withColumn("band", severity.short_long_band(F.col("counts"))).groupBy("band").agg(F.count("*").alias("n"))


def weighted_score(spark, d):
    s = scoring.severity_counts(_graded(spark, d), ["user_id"])
    m = F.col("major"), F.col("minor"), F.col("assessed")
    return s.select(
        "user_id", "assessed", "errors", "major", "minor", "style", F.round(scoring.weighted_score(*m), 4).alias("score"),
        scoring.reliability(m[2]).alias("reliability"),
    )


def chapter_summary(spark, d):
    """Scores by user and day, by user, and in total."""
    g = _graded(spark, d).withColumn("day", F.dayofmonth("ts").cast("bigint"))
    r = scoring.rollup_scores(g, ["user_id", "day"])
    return r.select(
        F.coalesce("user_id", F.lit(-1)).alias("user_id"), F.coalesce("day", F.lit(-1)).alias("day"),
        "assessed", "major", "minor", "style", F.round("score", 4).alias("score"), F.round("raw_score", 4).alias("raw_score"), "reliability"
    )


def score_unweighted(spark, d):
    s = scoring.severity_counts(_graded(spark, d), ["event_type"])
    return s.select("event_type", F.round(scoring.passed_share(F.col("major"), F.col("minor"), F.col("assessed")), 6).alias("score"))


def category_counts_zero_fill(spark, d):
    """Counts for a fixed list of kinds, kinds that never occur included."""
    domain = spark.createDataFrame([(x,) for x in ("click", "error", "purchase", "refund", "signup", "view", "logout")], "event_type string")
    return scoring.counts_with_zeros(table(spark, d, "events"), "event_type", domain)


def top1_first_tie(spark, d):
    return scoring.most_common(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


def category_pivot(spark, d):
    return scoring.pivot_categories(table(spark, d, "events"), ["user_id"], "event_type", {"browse": ["view", "click"], "buy": ["purchase"], "other": ["signup", "error"]})


def multiset_confusion(spark, d):
    """Event types of even against odd days as multisets per user."""
    e = table(spark, d, "events")
    a, b = (e.where(f"dayofmonth(ts) % 2 = {k}").select("user_id", "event_type") for k in (0, 1))
    return evaluate.multiset_confusion(a, b, ["user_id", "event_type"])


def micro_prf(spark, d):
    c = multiset_confusion(spark, d).groupBy("event_type").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    m = evaluate.prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select("event_type", "tp", "fp", "fn", *[F.round(v, 6).alias(k) for k, v in m.items()])


def _sets(spark, d):
    """Kinds of even and of odd days of each user and week; over a whole month nearly all users have all kinds on both."""
    e = table(spark, d, "events").withColumn("week", F.to_date(F.date_trunc("week", "ts")))
    one = lambda k: F.array_sort(F.collect_set(F.when(F.dayofmonth("ts") % 2 == k, F.col("event_type"))))
    return e.groupBy("user_id", "week").agg(one(0).alias("expected"), one(1).alias("found"))


def prf_sets(spark, d):
    m = evaluate.set_metrics(_sets(spark, d), "expected", "found")
    return m.select(
        "user_id", "week", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
        F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"),
    )


def macro_prf(spark, d):
    m = evaluate.set_metrics(_sets(spark, d), "expected", "found")
    return m.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")])


def detection_status(spark, d):
    """How often each expected kind is found, by name contained either way."""
    expected = spark.createDataFrame([(x,) for x in ("view_page", "click", "sign", "refund", "err")], "name string")
    found = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    j = F.broadcast(expected).join(found, F.col("name").contains(F.col("event_type")) | F.col("event_type").contains(F.col("name")), "left")
    g = j.groupBy("name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_hits"))
    return g.withColumn("status", evaluate.detection_status(F.col("n_hits"), 2000))


def quantile_summary(spark, d):
    return evaluate.distribution(table(spark, d, "events"), ["event_type"], "value")


def uneven_histogram(spark, d):
    """Buckets with gaps between them; values in a gap have no bucket."""
    b = evaluate.histogram(F.col("value"), [("0-10", None, 10.0), ("11-50", 11.0, 50.0), ("51-100", 51.0, 100.0), ("over 100", 100.01, None)])
    return table(spark, d, "events").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


def duration_outliers(spark, d):
    """Values below 1 and above 250 by kind of event and reason, most first."""
    return report.duration_outliers(table(spark, d, "events"), "event_type", "value", 1, 250).select("event_type", "reason", "n", F.col("rank").cast("bigint").alias("rank"))


def value_coverage(spark, d):
    """Share of the sum of values that lies in 1-250, by kind."""
    inside = F.when(F.col("value").between(1, 250), F.col("value"))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(100 * evaluate.safe_ratio(F.sum(inside), F.sum("value")), 4).alias("coverage"))


def grouped_report_rows(spark, d):
    """One row a user and day: its kinds as one sorted list, and the first event."""
    e = table(spark, d, "events").select("user_id", F.dayofmonth("ts").cast("bigint").alias("day"), "event_type", "event_id")
    r = report.one_row_a_place(e.withColumn("first_event", F.col("event_id")), ["user_id", "day"], "event_type", "event_id")
    return r.select("user_id", "day", F.array_join("rules", ",").alias("kinds"), "first_event")


def patch_upsert(spark, d):
    """Corrections of some events' kinds: how many rows changed, by kind after the patch."""
    e = table(spark, d, "events").select("event_id", "event_type")
    patch = e.where("event_id % 10 = 3").select("event_id", F.when(F.col("event_id") % 20 == 3, "view").otherwise(F.col("event_type")).alias("event_type"))
    u = align.upsert(e, patch, ["event_id"], "event_type")
    return u.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed"))


def skip_flags(spark, d):
    """Flags of faulty user-days carried to all their events, with the kind of the first fault."""
    e = table(spark, d, "events").withColumn("day", F.dayofmonth("ts"))
    bad = e.where("event_type = 'error' AND value > 100").select("user_id", "day", "event_id", F.when(F.col("value") > 200, "grave").otherwise("plain").alias("fault"))
    j = report.skip_flags(e, bad, ["user_id", "day"], "fault", "event_id")
    return j.groupBy("event_type", F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count_if("skip").alias("n_skipped"), F.count("*").alias("n"))


def verification_targets(spark, d):
    """Priority, error and severity of every event from the rules that match at its place."""
    c = _context(spark, d)
    expected = c.select("user_id", "pos", "symbol", F.col("value").alias("expected_ms"), (F.col("value") / 4).alias("tolerance_ms"))
    apps = rules.match(c, RULES).select("user_id", "pos", "rule")
    t = acoustics.verification_targets(expected, apps, KEY, {r.name: r.category for r in RULES})
    return t.groupBy("symbol", F.array_join("rules", ",").alias("rules"), "priority", "error", "severity").agg(F.count("*").alias("n"))


def balanced_selection(spark, d):
    """At most three users a kind of event, by their first event; kinds in order of appearance, a user once over all."""
    c = table(spark, d, "events").select(F.col("event_type").alias("class"), "user_id", "event_id")
    return report.balanced_selection(c, report.class_ranks(c, "event_id"), "user_id", "event_id", 3)


QUERIES = {f.__name__: f for f in (
    overlap_pairs, overlap_semi, containment, midpoint_assign_nearest, silence_complement, pauses, split_segments, rebase_timestamps, suffix_align,
    ordinal_align, count_mismatch, greedy_word_match, diff_word_errors, edit_script, calibrate_group, calibrate_all, calibrate_rollup, severity_bands,
    severity_downgrade, long_vowel_bands, weighted_score, chapter_summary, score_unweighted, category_counts_zero_fill, top1_first_tie,
    category_pivot, multiset_confusion, micro_prf, prf_sets, macro_prf, detection_status, quantile_summary, uneven_histogram,
    duration_outliers, value_coverage, grouped_report_rows, patch_upsert, skip_flags, verification_targets, balanced_selection,
)}

_SETS = """SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS week, coalesce(list_sort(list(DISTINCT event_type) FILTER (WHERE day(ts) % 2 = 0)), []) AS x, coalesce(list_sort(list(DISTINCT event_type) FILTER (WHERE day(ts) % 2 = 1)), []) AS y
    FROM events GROUP BY ALL"""
_SETM = f"""SELECT user_id, week, CASE WHEN len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(y) END AS p, CASE WHEN len(x) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(x) END AS r,
    list_sort(list_filter(x, lambda v: NOT list_contains(y, v))) AS miss, list_sort(list_filter(y, lambda v: NOT list_contains(x, v))) AS extra FROM ({_SETS})"""
_CONF = """WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE day(ts) % 2 = 0 GROUP BY ALL), f AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE day(ts) % 2 = 1 GROUP BY ALL),
    m AS (SELECT user_id, event_type, coalesce(e.n, 0) AS n_expected, coalesce(f.n, 0) AS n_found FROM e FULL JOIN f USING (user_id, event_type)),
    c AS (SELECT *, least(n_expected, n_found) AS tp, n_expected - least(n_expected, n_found) AS fn, n_found - least(n_expected, n_found) AS fp FROM m)"""
_SEV = "count(*) FILTER (WHERE severity = 'major') AS major, count(*) FILTER (WHERE severity = 'minor') AS minor, count(*) FILTER (WHERE severity = 'style') AS style"
_Q = "list_sort(list({0}))"
#: One step for each of the five kinds, in order of appearance.
_BALANCED = """WITH k AS (SELECT event_type, row_number() OVER (ORDER BY min(event_id), event_type) AS r FROM events GROUP BY event_type),
    c AS (SELECT event_type AS class, r, user_id, min(event_id) AS event_id FROM events JOIN k USING (event_type) GROUP BY ALL)""" + "".join(
    f""", s{i} AS (SELECT * FROM c WHERE r = {i}""" + "".join(f" AND user_id NOT IN (SELECT user_id FROM s{j})" for j in range(1, i)) + " ORDER BY event_id, user_id LIMIT 3)"
    for i in range(1, 6)
) + " " + " UNION ALL ".join(f"SELECT class, user_id, event_id FROM s{i}" for i in range(1, 6))

ORACLES = {
    "overlap_pairs": f"""SELECT s.user_id, event_id, CAST(ordinal AS BIGINT) AS ordinal, CAST(least(t1, w1) - greatest(t0, w0) AS BIGINT) AS overlap
        FROM ({SQL_SPANS}) s JOIN ({SQL_WINDOWS}) w ON s.user_id = w.user_id AND least(t1, w1) - greatest(t0, w0) > 600000000""",
    "overlap_semi": f"""WITH s AS ({SQL_SPANS}) SELECT user_id, event_id FROM s WHERE event_type <> 'error' AND EXISTS (SELECT 1 FROM s e
        WHERE e.user_id = s.user_id AND e.event_type = 'error' AND least(s.t1, e.t1) - greatest(s.t0, e.t0) > 300000000)""",
    "containment": f"""SELECT s.user_id, count(*) AS n_inside FROM ({SQL_SPANS}) s JOIN ({SQL_WINDOWS}) w ON s.user_id = w.user_id AND t0 >= w0 AND t0 < w1 GROUP BY s.user_id""",
    "midpoint_assign_nearest": f"""WITH j AS (SELECT s.user_id, event_id, ordinal, (t0 + t1) / 2 AS m, w0, w1 FROM ({SQL_SPANS}) s JOIN ({SQL_WINDOWS}) w ON s.user_id = w.user_id),
        r AS (SELECT *, m >= w0 AND m <= w1 AS inside, row_number() OVER (PARTITION BY user_id, event_id ORDER BY CASE WHEN m >= w0 AND m <= w1 THEN 0 ELSE 1 END,
            CASE WHEN m >= w0 AND m <= w1 THEN 0 ELSE abs(m - (w0 + w1) / 2) END, ordinal) AS b FROM j)
        SELECT user_id, event_id, CAST(ordinal AS BIGINT) AS window_ordinal, inside FROM r WHERE b = 1""",
    "silence_complement": f"""WITH s AS ({SQL_SPANS}), g AS (SELECT user_id, coalesce(max(t1) OVER (PARTITION BY user_id ORDER BY t0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, t0 AS b FROM s
        UNION ALL SELECT user_id, max(t1), 40 * {DAY} FROM s GROUP BY user_id)
        SELECT user_id, count(*) AS n_gaps, CAST(sum(b - a) AS BIGINT) AS quiet_us, CAST(max(b - a) AS BIGINT) AS longest_us FROM g WHERE b > a GROUP BY user_id""",
    "pauses": f"""WITH s AS ({SQL_SPANS}), g AS (SELECT user_id, max(t1) OVER (PARTITION BY user_id ORDER BY t0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, t0 AS b FROM s)
        SELECT user_id, CAST(a AS BIGINT) AS gap_start, CAST(b AS BIGINT) AS gap_end FROM g WHERE b - a >= {HOUR}""",
    "split_segments": f"""WITH e AS (SELECT user_id, t0 AS edge FROM ({SQL_SPANS}) WHERE event_type = 'error' UNION SELECT DISTINCT user_id, 0 FROM events UNION SELECT DISTINCT user_id, 31 * {DAY} FROM events),
        s AS (SELECT user_id, edge, lead(edge) OVER (PARTITION BY user_id ORDER BY edge) AS nxt FROM e)
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY edge) AS ordinal, CAST(edge AS BIGINT) AS start_us, CAST(nxt AS BIGINT) AS end_us FROM s WHERE nxt - edge >= {HOUR}""",
    "rebase_timestamps": f"SELECT user_id, event_id, CAST(t0 AS BIGINT) AS start_us, CAST(t1 AS BIGINT) AS end_us FROM ({SQL_SPANS})",
    "suffix_align": """WITH v AS (SELECT user_id, event_id AS view_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS from_end FROM events WHERE event_type = 'view'),
        p AS (SELECT user_id, event_id AS purchase_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS from_end FROM events WHERE event_type = 'purchase')
        SELECT user_id, from_end, view_id, purchase_id FROM v JOIN p USING (user_id, from_end)""",
    "ordinal_align": """WITH v AS (SELECT user_id, event_id AS click_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ordinal FROM events WHERE event_type = 'click'),
        p AS (SELECT user_id, event_id AS signup_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ordinal FROM events WHERE event_type = 'signup')
        SELECT user_id, ordinal, click_id, signup_id FROM v JOIN p USING (user_id, ordinal)""",
    "count_mismatch": "SELECT l_orderkey, CAST(max(l_linenumber) AS BIGINT) AS n_expected, count(*) AS n_actual FROM lineitem GROUP BY l_orderkey HAVING max(l_linenumber) <> count(*)",
    "calibrate_group": """WITH l AS (SELECT user_id, coalesce(list_sort(list(value) FILTER (WHERE event_type IN ('view', 'click') AND value BETWEEN 50 AND 300)), []) AS s0,
            coalesce(list_sort(list(value) FILTER (WHERE event_type = 'purchase' AND value >= 50)), []) AS m0 FROM events GROUP BY user_id),
        q AS (SELECT *, s0[len(s0) // 4 + 1] AS a, s0[3 * len(s0) // 4 + 1] AS b FROM l),
        s AS (SELECT *, CASE WHEN len(s0) < 4 THEN s0 ELSE list_filter(s0, lambda x: x >= a - 1.5 * (b - a) AND x <= b + 1.5 * (b - a)) END AS s FROM q),
        g AS (SELECT *, CASE WHEN len(s) > 0 THEN list_filter(m0, lambda x: x > list_median(s)) ELSE m0 END AS m1 FROM s),
        h AS (SELECT *, m1[len(m1) // 4 + 1] AS c, m1[3 * len(m1) // 4 + 1] AS e FROM g),
        k AS (SELECT *, CASE WHEN len(m1) < 4 THEN m1 ELSE list_filter(m1, lambda x: x >= c - 1.5 * (e - c) AND x <= e + 1.5 * (e - c)) END AS m FROM h),
        p AS (SELECT *, list_concat(s, list_transform(m, lambda x: x / 2)) AS pool FROM k)
        SELECT user_id, round(CASE WHEN len(pool) >= 5 THEN list_median(pool) ELSE 107.0 END, 4) AS unit_ms, round(coalesce(list_median(s), 0), 4) AS short_median_ms,
            len(s) AS n_short, len(m) AS n_long, round(CASE WHEN len(s) > 1 THEN list_stddev_samp(s) ELSE 0 END, 4) AS short_std_ms, len(pool) < 5 AS is_default,
            CASE WHEN len(pool) >= 5 THEN CAST(1.0 AS DOUBLE) ELSE CAST(1.6 AS DOUBLE) END AS tolerance FROM p""",
    "calibrate_all": """SELECT event_type, count(*) FILTER (WHERE value >= 30 AND value < 300) AS n, round(median(value) FILTER (WHERE value >= 30 AND value < 300), 4) AS unit_ms,
        count(*) FILTER (WHERE value >= 30 AND value < 300) < 5 AS is_default FROM events GROUP BY event_type""",
    "calibrate_rollup": "SELECT coalesce(event_type, 'all') AS event_type, CAST(coalesce(day(ts), 0) AS BIGINT) AS day, count(value) AS n, round(median(value), 4) AS m FROM events GROUP BY ROLLUP (event_type, day(ts))",
    "severity_bands": f"SELECT event_type, severity, count(*) AS n FROM ({SQL_GRADED}) GROUP BY ALL",
    "severity_downgrade": f"""WITH g AS ({SQL_GRADED}), k AS (SELECT *, CASE WHEN counts < 0.5 THEN 0.5 * unit_ms - counts * unit_ms ELSE counts * unit_ms - 2.0 * unit_ms END AS away FROM g)
        SELECT severity, CASE WHEN severity IN ('major', 'minor') AND away <= 40 THEN CASE WHEN severity = 'major' THEN 'minor' ELSE 'style' END ELSE severity END AS downgraded, count(*) AS n FROM k GROUP BY ALL""",
    "long_vowel_bands": f"""SELECT CASE WHEN counts BETWEEN 1.5 AND 2.5 THEN NULL WHEN counts > 5.5 THEN 'major' WHEN counts > 2.5 THEN 'style' WHEN counts < 1.0 THEN 'major' ELSE 'minor' END AS band, count(*) AS n
        FROM ({SQL_GRADED}) GROUP BY ALL""",
    "weighted_score": f"""SELECT user_id, assessed, errors, major, minor, style, round(greatest(0, 100.0 * (1 - (major + 0.5 * minor) / assessed)), 4) AS score, CASE WHEN assessed >= 10 THEN 'high' ELSE 'low' END AS reliability
        FROM (SELECT user_id, count(*) AS assessed, count(severity) AS errors, {_SEV} FROM ({SQL_GRADED}) GROUP BY user_id)""",
    "chapter_summary": f"""SELECT coalesce(user_id, -1) AS user_id, CAST(coalesce(day, -1) AS BIGINT) AS day, assessed, major, minor, style, round(greatest(0, 100.0 * (1 - (major + 0.5 * minor) / assessed)), 4) AS score,
        round(100.0 * (1 - (major + 0.5 * minor) / assessed), 4) AS raw_score, CASE WHEN assessed >= 10 THEN 'high' ELSE 'low' END AS reliability
        FROM (SELECT user_id, day(ts) AS day, count(*) AS assessed, {_SEV} FROM ({SQL_GRADED}) GROUP BY ROLLUP (user_id, day(ts)))""",
    "score_unweighted": f"SELECT event_type, round((assessed - major - minor) / assessed, 6) AS score FROM (SELECT event_type, count(*) AS assessed, {_SEV} FROM ({SQL_GRADED}) GROUP BY event_type)",
    "category_counts_zero_fill": """SELECT k.event_type, count(e.event_id) AS n FROM (VALUES ('click'), ('error'), ('purchase'), ('refund'), ('signup'), ('view'), ('logout')) AS k(event_type)
        LEFT JOIN events e USING (event_type) GROUP BY k.event_type""",
    "top1_first_tie": """SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS b
        FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)) WHERE b = 1""",
    "category_pivot": """SELECT user_id, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS browse, count(*) FILTER (WHERE event_type = 'purchase') AS buy,
        count(*) FILTER (WHERE event_type IN ('signup', 'error')) AS other FROM events GROUP BY user_id""",
    "multiset_confusion": f"{_CONF} SELECT user_id, event_type, n_expected, n_found, tp, fn, fp FROM c",
    "micro_prf": f"""{_CONF}, g AS (SELECT event_type, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c GROUP BY event_type)
        SELECT event_type, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM g""",
    "prf_sets": f"""SELECT user_id, week, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1,
        array_to_string(miss, ',') AS missing, array_to_string(extra, ',') AS extra FROM ({_SETM})""",
    "macro_prf": f"SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END), 6) AS f1 FROM ({_SETM})",
    "detection_status": """SELECT name, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_hits, CASE WHEN coalesce(sum(n), 0) >= 2000 THEN 'VERIFIED' WHEN coalesce(sum(n), 0) > 0 THEN 'PARTIAL' ELSE 'NOT DETECTED' END AS status
        FROM (VALUES ('view_page'), ('click'), ('sign'), ('refund'), ('err')) AS k(name) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY event_type) e
        ON instr(name, event_type) > 0 OR instr(event_type, name) > 0 GROUP BY name""",
    "quantile_summary": """SELECT event_type, len(v) AS n, v[1] AS least, v[len(v) // 4 + 1] AS q1, v[len(v) // 2 + 1] AS mid, v[3 * len(v) // 4 + 1] AS q3, v[len(v)] AS most
        FROM (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)""",
    "uneven_histogram": """SELECT CASE WHEN value <= 10 THEN '0-10' WHEN value >= 11 AND value <= 50 THEN '11-50' WHEN value >= 51 AND value <= 100 THEN '51-100' WHEN value >= 100.01 THEN 'over 100' END AS bucket,
        count(*) AS n FROM events GROUP BY ALL""",
    "duration_outliers": """WITH o AS (SELECT event_type, CASE WHEN value < 1 THEN 'too_short' WHEN value > 250 THEN 'too_long' END AS reason, count(*) AS n FROM events WHERE value < 1 OR value > 250 GROUP BY ALL)
        SELECT *, row_number() OVER (ORDER BY n DESC, event_type, reason) AS rank FROM o""",
    "grouped_report_rows": "SELECT user_id, CAST(day(ts) AS BIGINT) AS day, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, min(event_id) AS first_event FROM events GROUP BY user_id, day(ts)",
    "patch_upsert": """SELECT t AS event_type, count(*) AS n, count(*) FILTER (WHERE t <> event_type) AS n_changed FROM (SELECT event_type, CASE WHEN event_id % 20 = 3 THEN 'view' ELSE event_type END AS t FROM events) GROUP BY t""",
    "skip_flags": """WITH b AS (SELECT user_id, day(ts) AS day, arg_min(CASE WHEN value > 200 THEN 'grave' ELSE 'plain' END, event_id) AS fault FROM events WHERE event_type = 'error' AND value > 100 GROUP BY ALL)
        SELECT event_type, coalesce(fault, 'none') AS fault, count(fault) AS n_skipped, count(*) AS n FROM events e LEFT JOIN b ON b.user_id = e.user_id AND b.day = day(e.ts) GROUP BY ALL""",
    "verification_targets": f"""WITH c AS ({SQL_CONTEXT}), m AS ({SQL_MATCH}), k AS (SELECT DISTINCT user_id, pos, rule FROM m),
        g AS (SELECT user_id, pos, string_agg(rule, ',' ORDER BY rule) AS rules, min(rule) AS one FROM k GROUP BY user_id, pos),
        cat(rule, category) AS (VALUES {", ".join(f"('{r.name}', '{r.category}')" for r in RULES)})
        SELECT symbol, coalesce(rules, '') AS rules, CAST(CASE WHEN rules IS NULL THEN 0.7 ELSE 1.0 END AS DOUBLE) AS priority, CASE WHEN rules IS NULL THEN 'duration_mismatch' ELSE category || '_error' END AS error,
        CASE WHEN rules IS NULL THEN 'minor' ELSE 'major' END AS severity, count(*) AS n FROM c LEFT JOIN g USING (user_id, pos) LEFT JOIN cat ON cat.rule = one GROUP BY ALL""",
    "balanced_selection": _BALANCED,
    "value_coverage": "SELECT event_type, round(100 * sum(value) FILTER (WHERE value BETWEEN 1 AND 250) / sum(value), 4) AS coverage FROM events GROUP BY event_type",
    "greedy_word_match": f"""WITH RECURSIVE p AS (SELECT user_id, CAST(ts AS DATE) AS day, pos, event_type AS word FROM ({SQL_POS})),
        l AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY pos) AS k FROM p),
        r AS (SELECT user_id, day - 1 AS day, list(struct_pack(p := pos, w := word) ORDER BY pos) AS rl FROM p GROUP BY ALL),
        g AS (SELECT DISTINCT user_id, day, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS left_pos, CAST(NULL AS BIGINT) AS right_pos, CAST(NULL AS VARCHAR) AS word, CAST(-1 AS BIGINT) AS used FROM p
            UNION ALL SELECT user_id, day, k, left_pos, hit, word, coalesce(hit, used) FROM (
                SELECT l.user_id, l.day, l.k, l.pos AS left_pos, l.word, g.used, list_min(list_transform(list_filter(rl, lambda x: x.w = l.word AND x.p > g.used), lambda x: x.p)) AS hit
                FROM g JOIN l ON l.user_id = g.user_id AND l.day = g.day AND l.k = g.k + 1 LEFT JOIN r ON r.user_id = l.user_id AND r.day = l.day))
        SELECT user_id, day, left_pos, right_pos, word FROM g WHERE k > 0""",
}


def split_long_timelines(spark, d):
    """Users' event times as recordings: cut at long pauses until no part exceeds three days; events shared out."""
    from ..operators import repair

    s = _spans(spark, d).withColumn("file_id", F.col("user_id").cast("string"))
    rec = s.groupBy("file_id").agg((F.max("t1") / DAY).alias("duration"), F.count("*").cast("int").alias("n_words"))
    g = intervals.complement(s, ["file_id"], "t0", "t1", ["t0", "event_id"]).where(f"gap_end - gap_start >= {6 * HOUR}")
    quiet = g.select("file_id", (F.col("gap_start") / DAY).alias("start"), (F.col("gap_end") / DAY).alias("end"))
    r = repair.split_recordings(rec, quiet, 3.0)
    return r.select("file_id", "segment", F.round("offset", 6).alias("offset"), F.round("duration", 6).alias("duration"), "first_word", "n_words")


QUERIES["split_long_timelines"] = split_long_timelines
