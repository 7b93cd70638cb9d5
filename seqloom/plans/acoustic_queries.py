"""Expected acoustics, statistics and ranges over sounds made of events and verses made of benchmark texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import report
from ..sources import inventory
from . import acoustics as A
from . import phonology
from .tables import KEY, positions, table
from .scripted import SQL_DOCUMENT_VERSES, SQL_RANGES, SQL_SOUNDS, benchmark_verses, document_verses, event_ranges, event_sounds

INVENTORY = """
consonants:
- {symbol: q, arabic: "ق", features: {manner: stop, place: uvular, voicing: false, emphatic: false}, duration_factor: 1.0}
- {symbol: n, arabic: "ن", features: {manner: nasal, place: dental, voicing: true, emphatic: false}, duration_factor: 1.1}
- {symbol: "sˤ", arabic: "ص", features: {manner: fricative, place: dental, voicing: false, emphatic: true}}
vowels:
- {symbol: "aː", features: {height: low, backness: front, length: long}, duration_factor: 2.0, formants: {f1: 700, f2: 1200, f3: 2500}}
- {symbol: u, features: {height: high, backness: back, length: short}, formants: {f1: 350, f2: 800, f3: 2200}}
geminates: {description: not a list}
"""
SPELLING = 'consonant_mappings: {"ب": b, "ت": t, "ث": "θ", "ا": {not: plain}}'
DEFAULTS = "pitch: {baseline: {male: 130}, tolerance: {max_deviation: 20}}"
FINAL = ["verse", "pos"]


def _apps(spark, d):
    return A.applications_by_place(event_ranges(spark, d), ["verse"])


def applications_by_place(spark, d):
    """Rules at each sound from applications over ranges of places."""
    return _apps(spark, d).join(event_sounds(spark, d), FINAL).select("verse", "pos", "symbol", "rule")


def expected_pitch(spark, d):
    p = A.expected_pitch(event_sounds(spark, d), _apps(spark, d), ["verse"], inventory.parse(DEFAULTS))
    return p.select("verse", "pos", "symbol", *[F.round(c, 4).alias(c) for c in ("f0", "f0_end", "f0_low", "f0_high")], "contour")


def expected_formants(spark, d):
    return A.expected_formants(event_sounds(spark, d), _apps(spark, d), ["verse"])


def expected_nasality(spark, d):
    return A.expected_nasality(event_sounds(spark, d), _apps(spark, d), ["verse"])


def sound_statistics(spark, d):
    """Words and classes of sounds of each verse."""
    return A.sequence_statistics(event_sounds(spark, d), ["verse"], [*A.FORMANTS, "aw", "aj"])


def feature_statistics(spark, d):
    """Number, total and mean of values and the range of pitch of each user's events."""
    p = positions(spark, d)
    durations = p.select("user_id", "pos", F.col("value").alias("expected_ms"))
    s = A.feature_statistics(durations, p.select("user_id", (F.col("value") * 2).alias("f0")), KEY)
    return s.select("user_id", "n", *[F.round(c, 4).alias(c) for c in ("total_ms", "mean_ms", "f0_least", "f0_most")])


def sequence_slices(spark, d):
    """Two events before and one after each error of value above 200."""
    p = positions(spark, d)
    centres = p.where("event_type = 'error' AND value > 200").select("user_id", F.col("pos").alias("centre"))
    return A.around(p, KEY, centres, 2, 1).select("user_id", "centre", "pos", "event_type")


def tolerance_tests(spark, d):
    """Lines whose quantity is acceptable against bounds (0: none), and how far it is from 25."""
    li = table(spark, d, "lineitem")
    low = F.when(F.col("l_linenumber") % 2 == 0, 10.0).otherwise(0.0)
    high = F.when(F.col("l_linenumber") % 3 == 0, F.lit(None).cast("double")).otherwise(40.0)
    q = F.col("l_quantity")
    expected = F.when(F.col("l_linenumber") == 1, 0.0).otherwise(25.0)
    return li.groupBy("l_linenumber").agg(
        F.count_if(A.acceptable(q, low, high)).alias("n_fine"), F.round(F.sum(A.deviation(q, expected)), 2).alias("away"),
        F.round(F.avg(A.relative_deviation(q, expected)), 4).alias("percent_away"),
    )


def sound_inventory(spark, d):
    """Sounds of an inventory file beside the sounds of events; what the inventory lacks is a plain consonant."""
    i = inventory.sounds_of(spark, inventory.parse(INVENTORY))
    s = inventory.with_dimensions(event_sounds(spark, d), i)
    return s.select("verse", "pos", "symbol", "kind", "place", "emphatic", "duration_factor", "f2")


def spelling_map(spark, d):
    """Letters of all verses by the sounds of a spelling file; only its plain entries count."""
    m = inventory.spelling_of(inventory.parse(SPELLING))
    of = spark.createDataFrame(sorted(m.items()), "letter string, sound string")
    letters = T.character_counts(document_verses(spark, d)).withColumnRenamed("ch", "letter")
    return letters.join(of, "letter").select("letter", "sound", "n")


def verse_targets(spark, d):
    """Priority, error and severity of every sound of the verses."""
    s = phonology.phonemize(benchmark_verses(spark, d))
    apps = phonology.apply_rules(s)
    categories = {r.name: r.category for r in phonology.RULES}
    t = A.verification_targets(phonology.expected_durations(s, apps), apps, phonology.VERSE, categories)
    return t.groupBy("chapter", "verse", "priority", "error", "severity").agg(F.count("*").alias("n"), F.round(F.sum("expected_ms"), 3).alias("expected_ms"))


def request_problems(spark, d):
    """What is wrong with requests made of lines: how often."""
    li = table(spark, d, "lineitem").select((F.col("l_partkey") % 130).alias("chapter"), (F.col("l_linenumber") - 1).alias("first"), (F.col("l_quantity").cast("int") - 10).alias("last"))
    return li.groupBy(report.request_problem(F.col("chapter"), F.col("first"), F.col("last")).alias("problem")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    applications_by_place, expected_pitch, expected_formants, expected_nasality, sound_statistics, feature_statistics, sequence_slices, tolerance_tests,
    sound_inventory, spelling_map, verse_targets, request_problems,
)}

_S = SQL_SOUNDS
_A = f"SELECT verse, unnest(range(start_pos, end_pos + 1)) AS pos, rule FROM ({SQL_RANGES})"
_IN = lambda x: "(" + ", ".join(f"'{v}'" for v in x) + ")"
_F = "(VALUES " + ", ".join(f"('{k}', {v[0]}::DOUBLE, {v[1]}::DOUBLE, {v[2]}::DOUBLE)" for k, v in A.FORMANTS.items()) + ") AS f(symbol, f1, f2, f3)"
_N = "(VALUES " + ", ".join(f"('{k}', {v[0]}::DOUBLE, {v[1]}::DOUBLE)" for k, v in A.NASALITY.items()) + ") AS n(rule, strength, counts)"

ORACLES = {
    "applications_by_place": f"SELECT s.verse, CAST(s.pos AS BIGINT) AS pos, symbol, rule FROM ({_S}) s JOIN ({_A}) a ON a.verse = s.verse AND a.pos = s.pos",
    "expected_pitch": f"""WITH p AS (SELECT s.*, 130.0 * CASE WHEN symbol IN {_IN(A.EMPHATIC)} THEN 0.9 ELSE 1.0 END * CASE WHEN symbol IN {_IN(A.THROAT)} THEN 0.85 ELSE 1.0 END
            * CASE WHEN symbol IN {_IN(A.HIGH_VOWELS)} THEN 1.1 ELSE 1.0 END * pow(0.9::DOUBLE, coalesce(n, 0)) AS f0 FROM ({_S}) s LEFT JOIN (SELECT verse, pos, count(*) AS n FROM ({_A}) WHERE rule LIKE 'raa_tafkheem%' GROUP BY verse, pos) a ON a.verse = s.verse AND a.pos = s.pos)
        SELECT verse, pos, symbol, round(f0, 4)::DOUBLE AS f0, round(f0 - CASE WHEN verse_final THEN 50 WHEN word_final THEN 30 ELSE 0 END, 4)::DOUBLE AS f0_end, round(f0 - 20, 4)::DOUBLE AS f0_low, round(f0 + 20, 4)::DOUBLE AS f0_high,
        CASE WHEN word_final THEN 'falling' ELSE 'level' END AS contour FROM p""",
    "expected_formants": f"""WITH s AS (SELECT *, coalesce(a IN {_IN(A.EMPHATIC)}, false) OR coalesce(b IN {_IN(A.EMPHATIC)}, false) AS near FROM ({_S}))
        SELECT verse, pos, symbol, f1 + CASE WHEN near THEN 50 ELSE 0 END AS f1, f2 - CASE WHEN near THEN 200 ELSE 0 END - 200 * coalesce(n, 0) AS f2, f3
        FROM s JOIN {_F} USING (symbol) LEFT JOIN (SELECT verse, pos, count(*) AS n FROM ({_A}) WHERE rule IN {_IN(A.LOWER_F2)} GROUP BY verse, pos) x USING (verse, pos)""",
    "expected_nasality": f"""WITH g AS (SELECT verse, pos, max(strength) AS top, arg_max(counts, rule) AS counts,
            arg_max(CASE WHEN contains(rule, 'idgham') THEN 0.9 WHEN contains(rule, 'iqlab') THEN 0.85 WHEN contains(rule, 'ikhfaa') THEN 0.75 END, rule) FILTER (WHERE regexp_matches(rule, 'idgham|iqlab|ikhfaa')) AS kind
            FROM ({_A}) JOIN {_N} USING (rule) GROUP BY verse, pos)
        SELECT s.verse, s.pos, symbol, CAST(coalesce(kind, top, 0.6) AS DOUBLE) AS strength, coalesce(counts, 1.0) AS counts FROM ({_S}) s LEFT JOIN g ON g.verse = s.verse AND g.pos = s.pos WHERE top IS NOT NULL OR symbol IN ('m', 'n')""",
    "sound_statistics": f"""SELECT verse, count(*) AS n_sounds, count(DISTINCT word_idx) AS n_words, count(*) FILTER (WHERE symbol IN {_IN(A.FORMANTS)}) AS n_vowels,
        count(*) FILTER (WHERE symbol NOT IN {_IN(A.FORMANTS)}) AS n_consonants, count(*) FILTER (WHERE symbol IN ('m', 'n')) AS n_nasals, count(*) FILTER (WHERE symbol IN {_IN(A.EMPHATIC)}) AS n_emphatics FROM ({_S}) GROUP BY verse""",
    "feature_statistics": "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total_ms, round(avg(value), 4) AS mean_ms, round(min(value * 2), 4) AS f0_least, round(max(value * 2), 4) AS f0_most FROM events GROUP BY user_id",
    "sequence_slices": """WITH p AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)
        SELECT c.user_id, c.pos AS centre, p.pos, p.event_type FROM p c JOIN p ON p.user_id = c.user_id AND p.pos BETWEEN c.pos - 2 AND c.pos + 1 WHERE c.event_type = 'error' AND c.value > 200""",
    "tolerance_tests": """WITH q AS (SELECT l_linenumber, l_quantity AS q, CASE WHEN l_linenumber % 2 = 0 THEN 10 END AS low, CASE WHEN l_linenumber % 3 <> 0 THEN 40 END AS high, CASE WHEN l_linenumber = 1 THEN 0 ELSE 25 END AS x FROM lineitem)
        SELECT l_linenumber, count(*) FILTER (WHERE (low IS NULL OR q >= low) AND (high IS NULL OR q <= high)) AS n_fine, round(sum(q - x), 2) AS away, round(avg(CASE WHEN x = 0 THEN 0 ELSE (q - x) / x * 100 END), 4) AS percent_away FROM q GROUP BY l_linenumber""",
    "sound_inventory": f"""SELECT verse, pos, symbol, coalesce(kind, 'consonants') AS kind, place, coalesce(emphatic, false) AS emphatic, coalesce(f, 1.0::DOUBLE) AS duration_factor, f2 FROM ({_S}) LEFT JOIN (VALUES
        ('q', 'consonants', 'uvular', false, 1.0::DOUBLE, NULL::DOUBLE), ('n', 'consonants', 'dental', false, 1.1, NULL), ('sˤ', 'consonants', 'dental', true, 1.0, NULL), ('aː', 'vowels', NULL, false, 2.0, 1200), ('u', 'vowels', NULL, false, 1.0, 800))
        AS i(symbol, kind, place, emphatic, f, f2) USING (symbol)""",
    "spelling_map": f"""SELECT letter, CASE letter WHEN 'ب' THEN 'b' WHEN 'ت' THEN 't' WHEN 'ث' THEN 'θ' END AS sound, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS letter FROM ({SQL_DOCUMENT_VERSES}))
        WHERE letter IN ('ب', 'ت', 'ث') GROUP BY letter""",
    "request_problems": """WITH r AS (SELECT l_partkey % 130 AS chapter, l_linenumber - 1 AS first, CAST(trunc(l_quantity) AS INTEGER) - 10 AS last FROM lineitem)
        SELECT CASE WHEN chapter NOT BETWEEN 1 AND 114 THEN 'chapter must be between 1 and 114' WHEN first < 1 THEN 'the first verse must be at least 1' WHEN last < first THEN 'the last verse must not be before the first'
        WHEN last - first > 20 THEN 'no more than 20 verses at once' END AS problem, count(*) AS n FROM r GROUP BY ALL""",
}
