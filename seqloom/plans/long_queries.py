"""Sequences and intervals of any length: all events as one sequence, spans beside one of a month."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, scan
from .interval_queries import SQL_SPANS, _spans
from .tables import SQL_MICROS, micros, table

#: The one sequence of all events.
KEY, ORDER = ["stream"], ["ts", "event_id"]
MINUTE, MONTH = 60_000_000, 31 * 24 * 3_600_000_000
W = "OVER (ORDER BY ts, event_id)"


def _stream(spark, d):
    e = table(spark, d, "events").select("ts", "event_id", "user_id", "event_type", "value")
    return e.withColumn("stream", F.lit(0))


def overlaps_of_any_length(spark, d):
    """Errors' spans against all spans and one of the whole month for each user, in cells of a minute."""
    s = _spans(spark, d).select("user_id", "event_id", "t0", "t1")
    month = s.select("user_id").distinct().select("user_id", F.lit(-1).cast("bigint").alias("event_id"), F.lit(0).cast("bigint").alias("t0"), F.lit(MONTH).alias("t1"))
    e = _spans(spark, d).where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("t0").alias("e0"), F.col("t1").alias("e1"))
    j = intervals.overlap_join(s.unionByName(month), e, ["user_id"], "t0", "t1", "e0", "e1", MINUTE)
    return j.select("user_id", "event_id", "error_id", "overlap")


def errors_within_spans(spark, d):
    """For each event's span or month, how many errors start in it."""
    s = _spans(spark, d).select("user_id", "event_id", "t0", "t1")
    month = s.select("user_id").distinct().select("user_id", F.lit(-1).cast("bigint").alias("event_id"), F.lit(0).cast("bigint").alias("t0"), F.lit(MONTH).alias("t1"))
    e = _spans(spark, d).where("event_type = 'error'").select("user_id", F.col("t0").alias("at"))
    j = intervals.contains_join(e, s.unionByName(month), ["user_id"], "at", "t0", "t1", MINUTE)
    return j.groupBy("user_id", "event_id").agg(F.count("*").alias("n_errors"))


def stream_neighbours(spark, d):
    """Neighbours and edges in the sequence of all events."""

    def columns(w):
        return {
            "type_p2": F.lag("event_type", 2).over(w), "type_p1": F.lag("event_type").over(w), "type_n1": F.lead("event_type").over(w),
            "is_first": F.lag(F.lit(1)).over(w).isNull(), "is_last": F.lead(F.lit(1)).over(w).isNull(),
        }

    h = scan.halo_windows(_stream(spark, d), KEY, ORDER, micros(), columns, before=2, after=1)
    return h.select("event_id", "type_p2", "type_p1", "type_n1", "is_first", "is_last")


def stream_quietest(spark, d):
    """Smoothed over five rows, the least value of all events and where it first is; and how many rises of two rows there are."""

    def columns(w):
        return {
            "smooth": F.round(F.avg("value").over(w.rowsBetween(-2, 2)), 6),
            "rise": (F.col("value") > 60) & (F.lead("value").over(w) > 60),
        }

    h = scan.halo_windows(_stream(spark, d), KEY, ORDER, micros(), columns, before=2, after=2)
    least = F.min(F.struct("smooth", "ts", "event_id")).alias("b")
    return h.agg(least, F.count(F.when(F.col("rise"), 1)).alias("n_rises")).select(
        F.col("b.event_id").alias("event_id"), F.col("b.smooth").alias("least"), "n_rises"
    )


def stream_running(spark, d):
    """Purchases so far, a time axis of durations, and the last error before or at each event."""
    is_error = F.col("event_type") == "error"
    s = scan.running(
        _stream(spark, d).withColumn("duration", F.round(F.col("value") * 100).cast("bigint")), KEY, ORDER, micros(),
        {"n_purchases": (F.col("event_type") == "purchase").cast("bigint"), "xmax": F.col("duration"), "place": F.lit(1).cast("bigint")},
        {"last_error": F.when(is_error, F.col("event_id"))},
    )
    return s.select("event_id", "place", "n_purchases", (F.col("xmax") - F.col("duration")).alias("xmin"), "xmax", "last_error")


def stream_runs(spark, d):
    """Runs of at least two values over 20, one of them over 80, in the sequence of all events."""
    return scan.run_lengths(_stream(spark, d), KEY, ORDER, micros(), F.col("value") > 20, 2, F.col("value") > 80).drop("stream")


def user_runs(spark, d):
    """The same for each user: keys of any size in one plan."""
    return scan.run_lengths(_stream(spark, d), ["user_id"], ORDER, micros(), F.col("value") > 20, 2, F.col("value") > 80)


def ranks_of_types(spark, d):
    """Nearest-rank quartiles and tenths of values by type, each type far more than a task's share."""
    ranks = {"p10": (1, 10), "q1": (1, 4), "mid": (1, 2), "q3": (3, 4), "p90": (9, 10)}
    return scan.exact_ranks(table(spark, d, "events"), ["event_type"], "value", ranks)


QUERIES = {
    f.__name__: f
    for f in (overlaps_of_any_length, errors_within_spans, stream_neighbours, stream_quietest, stream_running, stream_runs, user_runs, ranks_of_types)
}

_WITH_MONTH = f"s AS ({SQL_SPANS}), a AS (SELECT user_id, event_id, t0, t1 FROM s UNION ALL SELECT DISTINCT user_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), {MONTH} FROM s)"


def _runs_sql(key: str) -> str:
    part = f"PARTITION BY {key}" if key else ""
    head, on = (f"{key}, ", f"PARTITION BY {key}") if key else ("", "")
    return f"""
WITH r AS (SELECT {head}value, row_number() OVER ({part} ORDER BY ts, event_id) AS p, value > 20 AS f FROM events),
i AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER ({on} ORDER BY p) AS run FROM r)
SELECT {head}CAST(run AS BIGINT) AS run, min(p) AS first_pos, max(p) AS last_pos, count(*) AS length
FROM i WHERE f GROUP BY {head}run HAVING count(*) >= 2 AND max(value) > 80"""


ORACLES = {
    "overlaps_of_any_length": f"""
WITH {_WITH_MONTH}
SELECT a.user_id, a.event_id, e.event_id AS error_id, least(a.t1, e.t1) - greatest(a.t0, e.t0) AS overlap
FROM a JOIN s e ON a.user_id = e.user_id AND e.event_type = 'error' AND least(a.t1, e.t1) - greatest(a.t0, e.t0) > 0""",
    "errors_within_spans": f"""
WITH {_WITH_MONTH}
SELECT a.user_id, a.event_id, count(*) AS n_errors
FROM a JOIN s e ON a.user_id = e.user_id AND e.event_type = 'error' AND e.t0 BETWEEN a.t0 AND a.t1 GROUP BY a.user_id, a.event_id""",
    "stream_neighbours": f"""
SELECT event_id, lag(event_type, 2) {W} AS type_p2, lag(event_type) {W} AS type_p1, lead(event_type) {W} AS type_n1,
  row_number() {W} = 1 AS is_first, row_number() {W} = count(*) OVER () AS is_last FROM events""",
    "stream_quietest": f"""
WITH s AS (SELECT event_id, ts, round(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth,
  value > 60 AND lead(value) {W} > 60 AS rise FROM events)
SELECT (SELECT event_id FROM s ORDER BY smooth, ts, event_id LIMIT 1) AS event_id, (SELECT min(smooth) FROM s) AS least,
  (SELECT count(*) FROM s WHERE rise) AS n_rises""",
    "stream_running": f"""
WITH e AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS duration FROM events)
SELECT event_id, row_number() {W} AS place, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) {W} AS BIGINT) AS n_purchases,
  CAST(sum(duration) {W} AS BIGINT) - duration AS xmin, CAST(sum(duration) {W} AS BIGINT) AS xmax,
  last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) {W} AS last_error FROM e""",
    "stream_runs": _runs_sql(""),
    "user_runs": _runs_sql("user_id"),
    "ranks_of_types": """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, max(CASE WHEN r = n // 10 THEN value END) AS p10, max(CASE WHEN r = n // 4 THEN value END) AS q1,
  max(CASE WHEN r = n // 2 THEN value END) AS mid, max(CASE WHEN r = 3 * n // 4 THEN value END) AS q3, max(CASE WHEN r = 9 * n // 10 THEN value END) AS p90
FROM r GROUP BY event_type""",
}
