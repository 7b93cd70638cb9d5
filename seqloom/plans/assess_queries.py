"""Assessors, votes and repairs over sounds made of events, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import assess, repair, severity
from . import recitation
from .scripted import SOUNDS, choice, choice_sql
from .tables import SQL_POS, positions

#: Rules that sounds are under, by the rest of their event's id.
RULES = (
    "iqlab", "ghunnah_mushaddadah_noon", "ikhfaa_light", "ikhfaa_heavy", "qalqalah_major", "qalqalah_minor", "tafkhim", "vowel_backing_after_emphatic_short",
    "vowel_backing_before_emphatic_long", "madd_tabii", "madd_muttasil", "madd_munfasil", "none",
)
CONFIDENCE = ("low", "failed", "high", "high", "high", "high", "high")
HALVES = ("first", "second")
#: Labels of frames, in order of priority.
LABELS = ("click", "view", "purchase", "signup", "error")


def _sounds(spark, d):
    """Events as sounds of their user's chapter: five milliseconds for each unit of value."""
    i = F.col("event_id")
    return positions(spark, d).select(
        "event_id", "value", F.col("user_id").alias("chapter"), F.lit(1).alias("verse"), "pos", F.floor(F.col("pos") / 5).alias("word_idx"), F.lit("w").alias("word"),
        choice(SOUNDS, i % len(SOUNDS)).alias("ipa"), (F.col("value") * 5).alias("duration_ms"), (F.col("value") * 20).alias("word_ms"), F.array(choice(RULES, i % len(RULES))).alias("rules"),
        choice(CONFIDENCE, i % 7).alias("confidence"), (i % 17 == 0).alias("skip"), (i % 11 == 0).alias("is_final"), choice(HALVES, i % 9).alias("geminate_position"),
        F.when(i % 9 == 0, F.col("value") * 6).alias("geminate_total_ms"),
    )


def _calibration(sounds):
    return sounds.select("chapter").distinct().select("chapter", F.lit(100.0).alias("unit_ms"), F.lit(80.0).alias("short_median_ms"), F.lit(1.0).alias("tolerance"))


_S = f"""SELECT event_id, value, user_id, pos, {choice_sql(SOUNDS, f'event_id % {len(SOUNDS)}')} AS ipa, value * 5 AS ms, {choice_sql(RULES, f'event_id % {len(RULES)}')} AS rule,
    {choice_sql(CONFIDENCE, 'event_id % 7')} AS confidence, event_id % 17 = 0 AS skip, event_id % 11 = 0 AS is_final, {choice_sql(HALVES, 'event_id % 9')} AS half,
    CASE WHEN event_id % 9 = 0 THEN value * 6 END AS paired FROM ({SQL_POS})"""
_UNSURE = "(skip OR confidence IN ('low', 'failed'))"
_ONE = "coalesce(half <> 'second', true)"


def nasal_sounds(spark, d):
    """Bands of nasal sounds by their measured or aligned length, pauses and unstable pitch allowed for."""
    i = F.col("event_id")
    s = _sounds(spark, d).withColumns({
        "acoustic_ms": F.when(i % 5 == 0, F.col("value") * 4), "voiced": F.when(i % 3 == 0, (i % 10) / 10), "pitch_std": F.when(i % 3 == 0, (i % 40).cast("double")),
    })
    return assess.assess_nasal(s, _calibration(s), ["chapter"]).select("event_id", "rule", "status", "severity")


def echoed_sounds(spark, d):
    i = F.col("event_id")
    s = _sounds(spark, d).withColumns({
        "peak_ratio": F.when(i % 6 > 0, F.col("value") / 20), "sustain_ms": (i % 40).cast("double"), "skip_reason": F.when(i % 8 == 0, "no_closure_detected"),
    })
    return assess.assess_echo(s).select("event_id", "rule", "status", "echo", "severity")


def timbre(spark, d):
    """Concealed nasals by mean nasality; heavy sounds and backed vowels by their second formant."""
    i = F.col("event_id")
    s = _sounds(spark, d).withColumns({"mean_nasality": F.when(i % 6 > 0, F.col("value") / 100), "f2_hz": F.when(i % 5 > 0, F.col("value") * 30)})
    parts = [a.select("event_id", "rule", "status", "verdict", "severity") for a in (assess.assess_concealed(s), assess.assess_heavy(s), assess.assess_backing(s))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def long_vowels(spark, d):
    """Bands of long vowels, with the sounds beside them."""
    s = _sounds(spark, d)
    a = severity.assess_long_vowels(s, _calibration(s), ["chapter"])
    return a.select("event_id", "rule", "effective", "status", "severity", "expected", "actual")


def frame_votes(spark, d):
    """The kind of event that each user has most often in a stretch of seven, clicks before views and so on."""
    f = positions(spark, d).groupBy("user_id", F.floor(F.col("pos") / 7).alias("stretch")).agg(F.collect_list("event_type").alias("labels"))
    return f.select("user_id", "stretch", assess.majority_vote(F.col("labels"), LABELS).alias("vote"))


def unit_pool(spark, d):
    """Sounds that may tell the length of a count."""
    return _sounds(spark, d).where(assess.eligible_for_unit()).select("event_id", "duration_ms")


def recovered_segments(spark, d):
    """Short segments merged with what follows, long ones cut at marks: fifty events of a user are a recording."""
    p = _sounds(spark, d).select(F.concat_ws("-", "chapter", F.floor(F.col("pos") / 50)).alias("file_id"), (F.col("pos") % 50).cast("double").alias("at"), "event_id")
    seg = p.where("event_id % 3 = 0").select("file_id", F.col("at").alias("start"), (F.col("at") + 1 + F.col("event_id") % 4).alias("end"))
    want = seg.select("file_id", F.col("start").cast("int").alias("verse"), F.lit(2.0).alias("length"))
    return repair.recover_segments(seg, want, 0.6, p.where("event_id % 5 = 0").select("file_id", F.col("at").alias("at")), 1.5)


def allocated_words(spark, d):
    """Each user's events as a recording, a second for each unit of value, cut at silences before every fourth event until no part exceeds 300 seconds, words shared out by length."""
    p = positions(spark, d).withColumn("file_id", F.col("user_id").cast("string"))
    so_far = F.sum("value").over(Window.partitionBy("user_id").orderBy("pos"))
    rec = p.groupBy("file_id").agg(F.sum("value").alias("duration"), F.count("*").cast("int").alias("n_words"))
    still = p.withColumn("start", so_far).where("pos % 4 = 3").select("file_id", "start", (F.col("start") + 0.5).alias("end"))
    return repair.split_recordings(rec, still, 300.0)


_ALL = recitation.Config(trim_finals=True, pair_geminates=True, grade_confidence=True)


def postprocessed(spark, d):
    """Long last sounds trimmed, pairs of equal sounds, and confidence lowered beside failed ones."""
    s = _sounds(spark, d).select("chapter", "pos", F.col("ipa").substr(1, 1).alias("symbol"), "duration_ms", "confidence")
    p = recitation.postprocess(s, ["chapter"], _ALL)
    return p.select("chapter", "pos", F.round("trimmed", 4).alias("trimmed"), "pair", F.round("pair_total", 4).alias("pair_total"), "confidence")


QUERIES = {f.__name__: f for f in (
    nasal_sounds, echoed_sounds, timbre, long_vowels, frame_votes, unit_pool, recovered_segments, allocated_words, postprocessed,
)}

_IN = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
_MEASURED = lambda names, measure, skipped, verdict: f"""SELECT event_id, rule, CASE WHEN {skipped} THEN 'skipped' ELSE 'assessed' END AS status, CASE WHEN NOT {skipped} THEN {verdict} END AS verdict
    FROM (SELECT *, {measure} AS m FROM ({_S})) WHERE rule IN {_IN(names)} AND {_ONE}"""  # noqa: E731

ORACLES = {
    "nasal_sounds": f"""WITH s AS (SELECT *, coalesce(CASE WHEN event_id % 5 = 0 THEN value * 4 END, paired, ms) AS length FROM ({_S}) WHERE rule IN {_IN(assess.NASAL_COUNTS)} AND {_ONE}),
        b AS (SELECT *, length / 100 AS c, CASE WHEN rule IN {_IN(assess.CONCEALED)} THEN CASE WHEN length < 60 THEN 'major' WHEN length < 100 THEN 'minor' WHEN length <= 300 THEN NULL WHEN length <= 700 THEN 'style' ELSE 'minor' END
            WHEN length < 80 THEN 'major' WHEN length < 120 THEN 'minor' WHEN length <= 280 THEN NULL WHEN length <= 800 THEN 'style' WHEN length <= 1200 THEN 'minor' ELSE 'major' END AS s0 FROM s),
        c AS (SELECT *, CASE WHEN s0 IN ('major', 'minor') AND length > 1500 THEN 'style' ELSE s0 END AS s1 FROM b),
        e AS (SELECT *, CASE WHEN s1 = 'minor' AND c < 1.2 AND length <= 110 THEN 'style' ELSE s1 END AS s2 FROM c)
        SELECT event_id, rule, CASE WHEN {_UNSURE} THEN 'skipped' ELSE 'assessed' END AS status, CASE WHEN {_UNSURE} THEN NULL
        WHEN s2 = 'minor' AND c BETWEEN 8 AND 12 AND event_id % 3 = 0 AND NOT (event_id % 10 > 5 AND event_id % 40 < 30) THEN 'style' ELSE s2 END AS severity FROM e""",
    "echoed_sounds": f"""WITH s AS (SELECT *, value / 20 AS r, event_id % 40 AS hold, event_id % 6 = 0 OR event_id % 8 = 0 OR {_UNSURE} OR coalesce(paired, ms) < 30 AS gone FROM ({_S}) WHERE rule IN {_IN(assess.ECHOED)} AND {_ONE}),
        e AS (SELECT *, CASE WHEN gone THEN NULL WHEN r < 1.5 THEN 'absent' WHEN hold < 20 THEN 'weak' ELSE 'present' END AS echo FROM s)
        SELECT event_id, rule, CASE WHEN gone THEN 'skipped' ELSE 'assessed' END AS status, echo,
        CASE WHEN echo = 'absent' THEN CASE WHEN rule = 'qalqalah_major' THEN 'major' ELSE 'minor' END WHEN echo = 'weak' THEN CASE WHEN rule = 'qalqalah_major' THEN 'minor' ELSE 'style' END END AS severity FROM e""",
    "timbre": f"""SELECT *, CASE WHEN verdict IN ('izhar_error', 'tarqiq_error', 'front_vowel_error') THEN 'major' WHEN verdict IN ('under_nasalized', 'borderline') THEN 'minor' WHEN verdict = 'over_nasalized' THEN 'style' END AS severity FROM (
        {_MEASURED(assess.CONCEALED, "CASE WHEN event_id % 6 > 0 THEN value / 100 END", f"(m IS NULL OR {_UNSURE})", "CASE WHEN m < 0.05 THEN 'izhar_error' WHEN m < 0.08 THEN 'under_nasalized' WHEN m <= 0.55 THEN 'pass' ELSE 'over_nasalized' END")}
        UNION ALL {_MEASURED(assess.HEAVY, "CASE WHEN event_id % 5 > 0 THEN value * 30 END", f"(m IS NULL OR {_UNSURE})", "CASE WHEN m < 1200 THEN 'pass' WHEN m <= 1500 THEN 'borderline' ELSE 'tarqiq_error' END")}
        UNION ALL {_MEASURED(assess.BACKED, "CASE WHEN event_id % 5 > 0 THEN value * 30 END", "(m IS NULL OR skip)", "CASE WHEN m < 1400 THEN 'pass' WHEN m <= 2500 THEN 'borderline' ELSE 'front_vowel_error' END")})""",
    "frame_votes": f"""WITH c AS (SELECT user_id, pos // 7 AS stretch, event_type, count(*) AS n FROM ({SQL_POS}) GROUP BY ALL)
        SELECT user_id, stretch, vote FROM (SELECT *, event_type AS vote, row_number() OVER (PARTITION BY user_id, stretch ORDER BY n DESC, list_position({list(LABELS)}, event_type)) AS r FROM c) WHERE r = 1""",
    "unit_pool": f"""SELECT event_id, ms AS duration_ms FROM ({_S}) WHERE confidence = 'high' AND NOT skip AND NOT is_final AND half IS NULL AND ipa IN ('a', 'i', 'u') AND ms >= 30
        AND NOT (starts_with(rule, 'madd_') OR starts_with(rule, 'ghunnah_') OR starts_with(rule, 'qalqalah'))""",
    "postprocessed": f"""WITH s AS (SELECT user_id AS chapter, pos, substring(ipa, 1, 1) AS x, ms, confidence AS c FROM ({_S})),
        n AS (SELECT *, lag(x) OVER w AS xb, lead(x) OVER w AS xa, lag(ms) OVER w AS mb, lead(ms) OVER w AS ma, lead(1) OVER w IS NULL AS final, sum(ms) OVER p - ms AS others, count(*) OVER p AS k
            FROM s WINDOW w AS (PARTITION BY chapter ORDER BY pos), p AS (PARTITION BY chapter)),
        t AS (SELECT *, CASE WHEN final AND k > 1 AND ms > 3 * others / (k - 1) THEN others / (k - 1) END AS trimmed FROM n),
        g AS (SELECT *, CASE WHEN c IN ('failed', 'low') THEN c WHEN abs(ms - 30) <= 0.5 OR trimmed IS NOT NULL THEN 'low' ELSE 'high' END AS own FROM t),
        h AS (SELECT *, lag(own) OVER w = 'failed' OR coalesce(lead(own) OVER w = 'failed', false) AS beside FROM g WINDOW w AS (PARTITION BY chapter ORDER BY pos))
        SELECT chapter, pos, round(trimmed, 4) AS trimmed, CASE WHEN x = xa THEN 'first' WHEN x = xb THEN 'second' END AS pair, round(CASE WHEN x = xa THEN ms + ma WHEN x = xb THEN ms + mb END, 4) AS pair_total,
        CASE WHEN own <> 'failed' AND coalesce(beside, false) THEN 'low' ELSE own END AS confidence FROM h""",
}
