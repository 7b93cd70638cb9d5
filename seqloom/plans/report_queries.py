"""Reports, selections and samples over the driver tables and literal assessments, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate, report
from .interval_queries import SQL_GRADED, _graded
from .tables import positions, table

_SEV = "count(*) FILTER (WHERE severity = 'major') AS major, count(*) FILTER (WHERE severity = 'minor') AS minor, count(*) FILTER (WHERE severity = 'style') AS style"


def _rows(spark, d):
    """Graded events as assessments: errors count as skipped; the kind of event is the rule."""
    g = _graded(spark, d).withColumn("status", F.when(F.col("event_type") == "error", "skipped").otherwise("assessed"))
    rule = F.when(F.col("event_type") == "view", "madd_tabii").when(F.col("event_type") == "click", "qalqalah").when(F.col("event_type") == "purchase", "tafkhim").otherwise(F.col("event_type"))
    return g.select("user_id", F.dayofmonth("ts").cast("bigint").alias("day"), "event_id", rule.alias("rule"), "status", "severity", "counts")


_ROWS = f"""SELECT user_id, CAST(day(ts) AS BIGINT) AS day, event_id, CASE event_type WHEN 'view' THEN 'madd_tabii' WHEN 'click' THEN 'qalqalah' WHEN 'purchase' THEN 'tafkhim' ELSE event_type END AS rule,
    event_type <> 'error' AS done, severity AS s FROM ({SQL_GRADED})"""
_COUNTS = """count(*) FILTER (WHERE done) AS assessed, count(*) FILTER (WHERE NOT done) AS skipped, count(s) FILTER (WHERE done) AS errors,
    count(*) FILTER (WHERE done AND s = 'major') AS major, count(*) FILTER (WHERE done AND s = 'minor') AS minor, count(*) FILTER (WHERE done AND s = 'style') AS style"""


def verse_report(spark, d):
    """Assessments of several assessors put together, rolled up by user and day."""
    r = _rows(spark, d)
    columns = ["user_id", "day", "event_id", "rule", "status", "severity"]
    parts = [r.where(F.col("rule") == x) for x in ("madd_tabii", "qalqalah", "tafkhim")] + [r.where(~F.col("rule").isin("madd_tabii", "qalqalah", "tafkhim"))]
    return report.roll_up(report.together(*parts, columns=columns), ["user_id", "day"])


def recording_report(spark, d):
    """Counts, passed, categories of errors and confidence by user and day."""
    r = _rows(spark, d)
    meta = r.where("event_id % 2 = 0").select("user_id", "day").distinct().withColumn("confidence", F.lit("high"))
    return report.recording_report(r, ["user_id", "day"], meta)


def overall_scores(spark, d):
    return report.overall_score(recording_report(spark, d), ["user_id"])


def run_summary(spark, d):
    """Scores of each day, and totals."""
    return report.run_summary(_rows(spark, d), "day")


def chapter_files(spark, d):
    """Assessment texts of days: the number of verses and errors that are read back from the JSON."""
    r = _rows(spark, d)
    cal = calibrate.pooled_unit(table(spark, d, "events").withColumn("day", F.dayofmonth("ts").cast("bigint")), ["day"], "value", F.lit(True))
    cal = cal.select("day", "unit_ms", F.lit(80.04).alias("short_median_ms"), "is_default", F.lit(1.0).alias("tolerance"))
    texts = report.chapter_json(r, cal, "day", "user_id", ["event_id", "rule"])
    kind = "chapter bigint, calibration struct<unit_ms:double,short_median_ms:double,is_default:boolean,tolerance:double>, verses array<struct<verse:bigint,assessed:bigint,skipped:bigint,errors:array<struct<event_id:bigint,rule:string,severity:string>>>>"
    back = texts.select("day", F.from_json("value", kind).alias("j"))
    total = lambda c: F.aggregate("j.verses", F.lit(0).cast("bigint"), lambda a, v: a + c(v))
    return back.select(
        "day", F.size("j.verses").cast("bigint").alias("n_verses"), total(lambda v: v["assessed"]).alias("assessed"), total(lambda v: F.size(v["errors"]).cast("bigint")).alias("errors"),
        "j.calibration.unit_ms", "j.calibration.short_median_ms",
    )


def alignment_quality(spark, d):
    """Lines of orders that did not come back, as words and sounds that were aligned."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("word_idx"), "l_returnflag")
    return report.alignment_quality(li, li.where("l_returnflag <> 'R'"), ["l_orderkey"])


def last_segment(spark, d):
    """The last order of each customer."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")
    return report.last_wins(o.withColumn("at", F.col("o_orderkey")), ["o_custkey"], "o_orderkey").drop("at")


def spot_checks(spark, d):
    """Listed users and kinds with the band of their first event, or not evaluated."""
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("purchase").alias("event_type"))
    g = _graded(spark, d).withColumn("band", F.coalesce("severity", F.lit("fine")))
    return report.spot_check(cases, g, ["user_id", "event_type"], "band", "event_id")


def word_sets(spark, d):
    """Places of each user's day without and with an error."""
    p = positions(spark, d).withColumn("day", F.to_date("ts"))
    s = report.word_sets(p.select("user_id", "day", "pos"), p.where("event_type = 'error'").select("user_id", "day", "pos"), ["user_id", "day"], "pos")
    return s.select("user_id", "day", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("verified", "skipped")])


def ranked_counts(spark, d):
    """Priorities of orders, the most frequent first, equal ones in order of appearance."""
    r = report.ranked_counts(table(spark, d, "orders"), "o_orderpriority", "o_orderkey")
    return r.withColumn("rank", F.col("rank").cast("bigint"))


def first_examples(spark, d):
    """The first three errors of each user."""
    e = table(spark, d, "events").where("event_type = 'error'").select("user_id", "event_id")
    return report.first_examples(e, ["user_id"], ["event_id"], 3).withColumn("example", F.col("example").cast("bigint"))


def seeded_sample(spark, d):
    """Fifty orders without replacement by the digest of a seed and the key."""
    return report.seeded_sample(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 50, "seed-1:")


def time_stamps(spark, d):
    """Prices as times in milliseconds, and rounded half to even."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", report.time_stamp(F.col("o_totalprice")).alias("stamp"), F.bround(F.floor(F.col("o_totalprice")) / 2, 0).alias("half"))


def values_at(spark, d):
    """Values of each user's events interpolated at every tenth of their number of events."""
    p = positions(spark, d)
    points = p.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.explode(F.sequence(F.lit(-1), F.lit(10))).alias("k"), "n")
    points = points.select("user_id", (F.col("n") * F.col("k") / 10).alias("x"))
    return report.values_at(p, ["user_id"], "pos", "value", points, "x").select("user_id", F.round("x", 6).alias("x"), F.round("value", 4).alias("value"))


def calibration_scopes(spark, d):
    """Unit length of each user, of even and odd users, and of all, for groups of any size."""
    e = table(spark, d, "events")
    scopes = F.array(*[F.struct(F.lit(n).alias("scope"), k.cast("bigint").alias("k")) for n, k in (("user", F.col("user_id")), ("parity", F.col("user_id") % 2), ("all", F.lit(0)))])
    e = e.withColumn("s", F.explode(scopes)).select("s.*", "value", "event_type")
    c = calibrate.calibrate_any_size(e, ["scope", "k"], "value", F.col("event_type").isin("view", "click"), F.col("event_type") == "purchase")
    return c.select("scope", "k", F.round("unit_ms", 4).alias("unit_ms"), F.round("short_median_ms", 4).alias("short_median_ms"), "n_short", "n_long", "is_default", "tolerance")


QUERIES = {f.__name__: f for f in (
    verse_report, recording_report, overall_scores, run_summary, chapter_files, alignment_quality, last_segment, spot_checks, word_sets, ranked_counts,
    first_examples, seeded_sample, time_stamps, values_at, calibration_scopes,
)}

_CATEGORY = ", ".join(f"count(s) FILTER (WHERE done AND rule IN ({', '.join(repr(r) for r in names)})) AS n_{c}" for c, names in report.CATEGORIES.items())
_RECORDING = f"""SELECT *, greatest(assessed - major - minor, 0) AS passed FROM (
    SELECT user_id, day, {_COUNTS}, {_CATEGORY}, CASE WHEN count(*) FILTER (WHERE event_id % 2 = 0) > 0 THEN 'high' ELSE 'low' END AS confidence FROM ({_ROWS}) GROUP BY user_id, day)"""

ORACLES = {
    "verse_report": f"SELECT user_id, day, {_COUNTS} FROM ({_ROWS}) GROUP BY user_id, day",
    "recording_report": _RECORDING,
    "overall_scores": f"""SELECT user_id, count(*) AS n_verses, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(assessed) AS BIGINT) AS assessed, CAST(sum(passed) AS BIGINT) AS passed,
        round(sum(passed) / greatest(sum(assessed), 1) * 100, 1) AS score FROM ({_RECORDING}) GROUP BY user_id""",
    "run_summary": f"""WITH c AS (SELECT day, {_COUNTS} FROM ({_ROWS}) GROUP BY day)
        SELECT *, round(100.0::DOUBLE * (1 - (major + 0.5::DOUBLE * minor) / greatest(assessed, 1)), 1) AS score, CAST(sum(errors) OVER () AS BIGINT) AS total_errors, CAST(sum(assessed) OVER () AS BIGINT) AS total_assessed, CAST(sum(skipped) OVER () AS BIGINT) AS total_skipped FROM c""",
    "chapter_files": f"""WITH u AS (SELECT day(ts) AS day, round(CASE WHEN count(*) FILTER (WHERE value >= 30) >= 5 THEN median(value) FILTER (WHERE value >= 30) ELSE 107.0 END, 1) AS unit_ms FROM events GROUP BY 1)
        SELECT day, count(DISTINCT user_id) AS n_verses, count(*) FILTER (WHERE done) AS assessed, count(s) FILTER (WHERE done) AS errors, any_value(unit_ms) AS unit_ms, 80.0::DOUBLE AS short_median_ms FROM ({_ROWS}) JOIN u USING (day) GROUP BY day""",
    "alignment_quality": """WITH q AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS words_expected, count(DISTINCT l_suppkey) FILTER (WHERE l_returnflag <> 'R') AS words_aligned, count(*) AS phones_expected,
        count(*) FILTER (WHERE l_returnflag <> 'R') AS phones_aligned FROM lineitem GROUP BY l_orderkey) SELECT *, round(phones_aligned / phones_expected, 4) AS coverage FROM q""",
    "last_segment": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey",
    "spot_checks": f"""WITH g AS (SELECT user_id, arg_min(coalesce(severity, 'fine'), event_id) AS band FROM ({SQL_GRADED}) WHERE event_type = 'purchase' GROUP BY user_id)
        SELECT c_custkey AS user_id, 'purchase' AS event_type, coalesce(band, 'not evaluated') AS band FROM customer LEFT JOIN g ON user_id = c_custkey""",
    "word_sets": """WITH p AS (SELECT user_id, CAST(ts AS DATE) AS day, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
        SELECT user_id, day, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE event_type <> 'error'), '') AS verified, coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE event_type = 'error'), '') AS skipped FROM p GROUP BY ALL""",
    "ranked_counts": "SELECT *, row_number() OVER (ORDER BY n DESC, first_seen) AS rank FROM (SELECT o_orderpriority, count(*) AS n, min(o_orderkey) AS first_seen FROM orders GROUP BY 1)",
    "first_examples": "SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS example FROM events WHERE event_type = 'error') WHERE example <= 3",
    "seeded_sample": "SELECT o_orderkey, md5('seed-1:' || o_orderkey) AS draw FROM orders ORDER BY draw, o_orderkey LIMIT 50",
    "time_stamps": """WITH t AS (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS t, CAST(floor(o_totalprice) AS BIGINT) AS f FROM orders)
        SELECT o_orderkey, (t // 60000) || ':' || lpad(CAST(t % 60000 // 1000 AS VARCHAR), 2, '0') || '.' || lpad(CAST(t % 1000 AS VARCHAR), 3, '0') AS stamp, CAST(CASE WHEN f % 2 = 0 THEN f // 2 WHEN (f // 2) % 2 = 0 THEN f // 2 ELSE f // 2 + 1 END AS DOUBLE) AS half FROM t""",
    "values_at": """WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
        x AS (SELECT DISTINCT user_id, n * k / 10 AS x, n FROM p, unnest(range(-1, 11)) AS t(k)),
        j AS (SELECT x.user_id, x, a.value AS va, b.value AS vb, x - floor(x) AS f FROM x JOIN p a ON a.user_id = x.user_id AND a.pos = greatest(0, least(x.n - 1, floor(x))) JOIN p b ON b.user_id = x.user_id AND b.pos = greatest(0, least(x.n - 1, ceil(x))))
        SELECT user_id, round(x, 6) AS x, round(va + (vb - va) * f, 4) AS value FROM j""",
    "calibration_scopes": """WITH e AS (SELECT 'user' AS scope, user_id AS k, value, event_type FROM events UNION ALL SELECT 'parity', user_id % 2, value, event_type FROM events UNION ALL SELECT 'all', 0, value, event_type FROM events),
        l AS (SELECT scope, k, coalesce(list_sort(list(value) FILTER (WHERE event_type IN ('view', 'click') AND value BETWEEN 50 AND 300)), []) AS s0,
            coalesce(list_sort(list(value) FILTER (WHERE event_type = 'purchase' AND value >= 50)), []) AS m0 FROM e GROUP BY scope, k),
        q AS (SELECT *, s0[len(s0) // 4 + 1] AS a, s0[3 * len(s0) // 4 + 1] AS b FROM l),
        s AS (SELECT *, CASE WHEN len(s0) < 4 THEN s0 ELSE list_filter(s0, lambda x: x >= a - 1.5 * (b - a) AND x <= b + 1.5 * (b - a)) END AS s FROM q),
        s2 AS (SELECT *, list_median(s) AS sm FROM s),
        g AS (SELECT *, CASE WHEN len(s) > 0 THEN list_filter(m0, lambda x: x > sm) ELSE m0 END AS m1 FROM s2),
        h AS (SELECT *, m1[len(m1) // 4 + 1] AS c, m1[3 * len(m1) // 4 + 1] AS f FROM g),
        i AS (SELECT *, CASE WHEN len(m1) < 4 THEN m1 ELSE list_filter(m1, lambda x: x >= c - 1.5 * (f - c) AND x <= f + 1.5 * (f - c)) END AS m FROM h),
        p AS (SELECT *, list_concat(s, list_transform(m, lambda x: x / 2)) AS pool FROM i)
        SELECT scope, k, round(CASE WHEN len(pool) >= 5 THEN list_median(pool) ELSE 107.0 END, 4) AS unit_ms, round(coalesce(sm, 0), 4) AS short_median_ms, len(s) AS n_short, len(m) AS n_long, len(pool) < 5 AS is_default,
        CASE WHEN len(pool) >= 5 THEN 1.0::DOUBLE ELSE 1.6::DOUBLE END AS tolerance FROM p""",
}
