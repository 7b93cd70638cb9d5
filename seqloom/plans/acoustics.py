"""Expected pitch, formants and nasality of sounds, tolerances, and targets for a verification.

sounds: key, pos, symbol, word_final, verse_final; applications: key, pos, rule. Everything is a
projection over one window of the sequence and one join of the rules' effects, gathered by place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.context import ordered
from ..sources.inventory import setting

#: Sounds by their part in pitch and nasality.
EMPHATIC, THROAT = ("tˤ", "dˤ", "ðˤ", "sˤ"), ("q", "x", "ɣ", "ħ", "ʕ")
HIGH_VOWELS, NASAL = ("i", "iː", "u", "uː"), ("m", "n")
#: Fixed values: (F1, F2, F3) in Hz of each vowel.
FORMANTS = {
    "a": (700.0, 1200.0, 2500.0), "i": (300.0, 2300.0, 3000.0), "u": (350.0, 800.0, 2200.0), "ɑ": (700.0, 1000.0, 2500.0),
    "aː": (700.0, 1200.0, 2500.0), "iː": (300.0, 2300.0, 3000.0), "uː": (350.0, 800.0, 2200.0), "ɑː": (700.0, 1000.0, 2500.0),
}
#: What rules do: lowering of F2 in Hz, factor of pitch, nasality (strength, counts).
LOWER_F2 = {"vowel_backing_after_emphatic_short": 200.0, "vowel_backing_after_emphatic_long": 200.0, "vowel_backing_before_emphatic_short": 200.0}
PITCH_FACTOR = {"raa_tafkheem_with_fatha": 0.9, "raa_tafkheem_with_damma": 0.9, "raa_tafkheem_sakinah_after_fatha": 0.9}
NASALITY = {
    "ghunnah": (0.9, 2.0), "ghunnah_mushaddadah_noon": (0.9, 2.0), "ghunnah_mushaddadah_meem": (0.9, 2.0), "idgham_ghunnah_noon": (0.9, 2.0),
    "iqlab": (0.9, 2.0), "ikhfaa_light": (0.7, 2.0), "ikhfaa_heavy": (0.7, 2.0), "idgham_shafawi_meem": (0.9, 2.0), "ikhfaa_shafawi": (0.8, 2.0),
}
#: Strength by the kind of nasality that a rule's name tells.
STRENGTH = {"idgham": 0.9, "iqlab": 0.85, "ikhfaa": 0.75}
OWN_NASALITY = (0.6, 1.0)


def _map(table: Mapping, key: Column, kind: str = "double") -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[key] if pairs else F.lit(None).cast(kind)


def expected_pitch(sounds: DataFrame, apps: DataFrame, key: Sequence[str], defaults: Mapping | None = None) -> DataFrame:
    """key, pos, symbol, f0, f0_end, f0_low, f0_high, contour."""
    d = lambda path, built_in: float(setting(dict(defaults or {}), "pitch." + path, built_in))
    at = [*key, "pos"]
    factor = apps.groupBy(*at).agg(F.product(F.coalesce(_map(PITCH_FACTOR, F.col("rule")), F.lit(1.0))).alias("_factor"))
    s = F.col("symbol")
    f0 = (
        F.lit(d("baseline.male", 120)) * F.when(s.isin(*EMPHATIC), d("emphatic_factor", 0.9)).otherwise(1.0)
        * F.when(s.isin(*THROAT), d("pharyngeal_factor", 0.85)).otherwise(1.0) * F.when(s.isin(*HIGH_VOWELS), d("high_vowel_factor", 1.1)).otherwise(1.0)
        * F.coalesce("_factor", F.lit(1.0))
    )
    fall = F.when(F.col("verse_final"), d("contours.final_fall.f0_delta", -50)).when(F.col("word_final"), d("contours.falling.f0_delta", -30)).otherwise(0.0)
    wide = d("tolerance.max_deviation", 30)
    return sounds.join(factor, at, "left").select(
        *at, "symbol", f0.alias("f0"), (f0 + fall).alias("f0_end"), (f0 - wide).alias("f0_low"), (f0 + wide).alias("f0_high"),
        F.when(F.col("verse_final") | F.col("word_final"), "falling").otherwise("level").alias("contour"),
    )


def expected_formants(sounds: DataFrame, apps: DataFrame, key: Sequence[str], defaults: Mapping | None = None) -> DataFrame:
    """key, pos, symbol, f1, f2, f3 of vowels; beside an emphatic sound they shift, and rules lower F2."""
    d = lambda path, built_in: float(setting(dict(defaults or {}), "formants." + path, built_in))
    at, w = [*key, "pos"], ordered(key, ["pos"])
    lower = apps.groupBy(*at).agg(F.sum(F.coalesce(_map(LOWER_F2, F.col("rule")), F.lit(0.0))).alias("_lower"))
    near = F.coalesce(F.lag("symbol").over(w).isin(*EMPHATIC), F.lit(False)) | F.coalesce(F.lead("symbol").over(w).isin(*EMPHATIC), F.lit(False))
    s = sounds.withColumn("_near", near).where(F.col("symbol").isin(*FORMANTS)).join(lower, at, "left")
    hz = lambda i, shift: _map({k: v[i] for k, v in FORMANTS.items()}, F.col("symbol")) + F.when(F.col("_near"), shift).otherwise(0.0)
    return s.select(
        *at, "symbol", hz(0, d("emphatic_effects.f1_shift", 50)).alias("f1"),
        (hz(1, d("emphatic_effects.f2_shift", -200)) - F.coalesce("_lower", F.lit(0.0))).alias("f2"), hz(2, d("emphatic_effects.f3_shift", 0)).alias("f3"),
    )


def expected_nasality(sounds: DataFrame, apps: DataFrame, key: Sequence[str]) -> DataFrame:
    """key, pos, symbol, strength, counts of nasal sounds and of sounds under a rule that makes them nasal.

    The kind of nasality in a rule's name sets the strength, the last rule in order of names deciding;
    otherwise it is the strongest of the rules; a sound that is nasal by itself has its own.
    """
    at = [*key, "pos"]
    known = apps.withColumns({"_s": _map({k: v[0] for k, v in NASALITY.items()}, F.col("rule")), "_c": _map({k: v[1] for k, v in NASALITY.items()}, F.col("rule"))})
    kind = None
    for name, strength in STRENGTH.items():
        test = F.contains("rule", F.lit(name))
        kind = F.when(test, strength) if kind is None else kind.when(test, strength)
    g = known.where("_s IS NOT NULL").groupBy(*at).agg(
        F.max("_s").alias("_max"), F.max_by("_c", "rule").alias("_counts"), F.max_by(kind, F.when(kind.isNotNull(), F.col("rule"))).alias("_kind")
    )
    own = F.col("symbol").isin(*NASAL)
    return sounds.join(g, at, "left").where(F.col("_max").isNotNull() | own).select(
        *at, "symbol", F.coalesce("_kind", "_max", F.lit(OWN_NASALITY[0])).alias("strength"), F.coalesce("_counts", F.lit(OWN_NASALITY[1])).alias("counts")
    )


def acceptable(actual: Column, low: Column, high: Column) -> Column:
    """Within bounds; a bound that is null or 0 is none."""
    return ~F.coalesce((low != 0) & (actual < low), F.lit(False)) & ~F.coalesce((high != 0) & (actual > high), F.lit(False))


def deviation(actual: Column, expected: Column) -> Column:
    return actual - expected


def relative_deviation(actual: Column, expected: Column) -> Column:
    """In per cent of what was expected; 0 where nothing was."""
    return F.when(expected == 0, 0.0).otherwise((actual - expected) / expected * 100)


def verification_targets(expected: DataFrame, apps: DataFrame, key: Sequence[str], categories: Mapping[str, str]) -> DataFrame:
    """expected(key, pos, symbol, expected_ms, tolerance_ms) with the rules at each place (sorted), priority, the error that a
    mismatch is, and its severity: sounds under a rule come first."""
    at = [*key, "pos"]
    g = apps.groupBy(*at).agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    j = expected.join(g, at, "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<string>")))
    ruled = F.size("rules") > 0
    first = F.coalesce(_map(dict(categories), F.get("rules", F.lit(0)), "string"), F.lit("general"))
    return j.withColumns({
        "priority": F.when(ruled, 1.0).otherwise(0.7), "error": F.when(ruled, F.concat(first, F.lit("_error"))).otherwise("duration_mismatch"),
        "severity": F.when(ruled, "major").otherwise("minor"),
    })


def sequence_statistics(sounds: DataFrame, key: Sequence[str], vowels: Sequence[str], nasal: Sequence[str] = NASAL, emphatic: Sequence[str] = EMPHATIC) -> DataFrame:
    """Sounds, words and classes of sounds of each sequence."""
    s = F.col("symbol")
    return sounds.groupBy(*key).agg(
        F.count("*").alias("n_sounds"), F.countDistinct("word_idx").alias("n_words"), F.count_if(s.isin(*vowels)).alias("n_vowels"),
        F.count_if(~s.isin(*vowels)).alias("n_consonants"), F.count_if(s.isin(*nasal)).alias("n_nasals"), F.count_if(s.isin(*emphatic)).alias("n_emphatics"),
    )


def feature_statistics(durations: DataFrame, pitch: DataFrame, key: Sequence[str]) -> DataFrame:
    """Number, total and mean of expected durations, and the range of expected pitch, of each sequence."""
    d = durations.groupBy(*key).agg(F.count("*").alias("n"), F.sum("expected_ms").alias("total_ms"), F.avg("expected_ms").alias("mean_ms"))
    return d.join(pitch.groupBy(*key).agg(F.min("f0").alias("f0_least"), F.max("f0").alias("f0_most")), list(key), "left")


def around(sounds: DataFrame, key: Sequence[str], centres: DataFrame, before: int, after: int) -> DataFrame:
    """centres(key, centre): the sounds from ``before`` places before each centre to ``after`` places after it."""
    spread = centres.select(*key, "centre", F.explode(F.sequence(F.col("centre") - before, F.col("centre") + after)).alias("pos"))
    return spread.join(sounds, [*key, "pos"])


def applications_by_place(apps: DataFrame, key: Sequence[str], first: str = "start_pos", last: str = "end_pos") -> DataFrame:
    """Applications over ranges of places, ends included -> one row for each place and rule."""
    return apps.select(*key, "rule", F.explode(F.sequence(first, last)).alias("pos"))
