"""Severity of measured durations: bands, artifact tests and downgrades as ordered CASE columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .context import ordered, whole

#: Allowed counts (least, most) for each long-vowel rule.
LONG_RANGES = {
    "madd_tabii": (1.5, 2.5),
    "madd_muttasil": (4.0, 5.5),
    "madd_munfasil": (1.5, 5.5),
    "madd_lazim_kalimi": (5.5, 6.5),
    "madd_arid_lissukun": (1.5, 6.5),
    "madd_silah_kubra": (4.0, 5.5),
}
MAJOR_FROM, MINOR_FROM = 1.0, 0.5
CEILING = 2.0
WORD_TOO_LONG_MS = 1500.0
NASALS = ("m", "n")
NASAL_ABSORBS_MS = 400.0
OVERLONG = 1.5
FRAME_MS = 30.0


def short_long_band(counts: Column) -> Column:
    """The plain long vowel: 1.5-2.5 right, up to 5.5 style, 1.0-1.5 minor, beyond major; null if right."""
    return (
        F.when(counts.between(1.5, 2.5), None).when(counts > 5.5, "major").when(counts > 2.5, "style")
        .when(counts < 1.0, "major").otherwise("minor")
    )


def range_band(counts: Column, least: Column, most: Column, tolerance: Column | float = 1.0) -> Column:
    """Distance from a range: beyond 1.0 x tolerance major, beyond 0.5 x tolerance minor, else style."""
    t = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    away = F.when(counts < least, least - counts).otherwise(counts - most)
    return F.when(counts.between(least, most), None).when(away > t * MAJOR_FROM, "major").when(away > t * MINOR_FROM, "minor").otherwise("style")


def near_boundary_downgrade(severity: Column, counts: Column, least: Column, most: Column, unit_ms: Column, within_ms: float = FRAME_MS) -> Column:
    """One step down where the distance to the nearer bound is at most a frame of the aligner."""
    away = F.when(counts < least, least * unit_ms - counts * unit_ms).otherwise(counts * unit_ms - most * unit_ms)
    low = F.when(severity == "major", "minor").otherwise("style")
    return F.when(severity.isin("major", "minor") & (away <= within_ms), low).otherwise(severity)


def upper_bands(value: Column, bands: Mapping[float, str], beyond: str) -> Column:
    """The label of the first upper bound that value does not exceed."""
    out = None
    for bound, label in sorted(bands.items()):
        out = F.when(value <= bound, label) if out is None else out.when(value <= bound, label)
    return out.otherwise(beyond) if out is not None else F.lit(beyond)


def assess_long_vowels(phones: DataFrame, calibration: DataFrame, key: list[str], ranges: Mapping[str, tuple[float, float]] = LONG_RANGES) -> DataFrame:
    """A row for each (phone, long-vowel rule): status (assessed, skipped) and severity (null if right).

    phones: key, verse, pos, word_idx, word, ipa, start, duration_ms, word_ms, rules (array),
    confidence, skip, is_final, geminate_total_ms. calibration: key, unit_ms,
    short_median_ms, tolerance (few rows, one a recording).
    """
    seq = [*key, "verse"]
    w = ordered(seq, ["pos"])
    p = phones.withColumns(
        {
            "prev_conf": F.lag("confidence").over(w), "prev_ms": F.lag("duration_ms").over(w), "prev_word": F.lag("word_idx").over(w),
            "next_conf": F.lead("confidence").over(w), "next_ms": F.lead("duration_ms").over(w), "next_ipa": F.lead("ipa").over(w),
            "last_word": F.max("word_idx").over(whole(seq, ["pos"])),
        }
    )
    names = F.array(*[F.lit(r) for r in ranges])
    p = p.withColumn("rule", F.explode(F.filter("rules", lambda r: F.array_contains(names, r)))).join(calibration, key)
    ms = F.coalesce("geminate_total_ms", "duration_ms")
    p = p.withColumn("ms", ms).withColumn("counts", F.col("ms") / F.col("unit_ms"))
    relabel = (F.col("rule") == "madd_tabii") & F.col("is_final")
    p = p.withColumn("effective", F.when(relabel, "madd_arid_lissukun").otherwise(F.col("rule")))
    bound = lambda i: F.create_map(*[x for r, v in ranges.items() for x in (F.lit(r), F.lit(v[i]))])[F.col("effective")]
    p = p.withColumns({"least": bound(0), "most": bound(1)})
    plain = F.col("effective") == "madd_tabii"
    skipped = (
        F.col("skip") | F.col("confidence").isin("low", "failed")
        | ((F.col("short_median_ms") > 0) & (F.col("ms") <= F.col("short_median_ms")))
        | (F.col("ms") > F.col("most") * CEILING * F.col("unit_ms"))
    )
    c, least, most, unit = F.col("counts"), F.col("least"), F.col("most"), F.col("unit_ms")
    s0 = F.when(plain, short_long_band(c)).otherwise(range_band(c, least, most, F.col("tolerance")))
    pausal = (F.col("effective") == "madd_arid_lissukun") & (F.col("is_final") | (F.col("word_idx") == F.col("last_word")))
    p = p.withColumn("s0", s0)
    p = p.withColumn("s1", F.when(pausal & F.col("s0").isin("major", "minor") & (c > most), "style").otherwise(F.col("s0")))
    artifact = F.coalesce(
        ((F.col("next_conf") == "low") & (F.col("next_ms") <= FRAME_MS))
        | (F.col("next_ipa").isin(*NASALS) & (F.col("next_ms") > NASAL_ABSORBS_MS)), F.lit(False)
    ) | (F.col("word_ms") > WORD_TOO_LONG_MS) | (F.col("duration_ms") > OVERLONG * most * unit) | F.coalesce(
        (F.col("prev_word") == F.col("word_idx")) & (F.col("prev_conf") == "low") & (F.col("prev_ms") <= FRAME_MS), F.lit(False)
    )
    p = p.withColumn("s2", F.when(F.col("s1").isin("major", "minor") & artifact, "style").otherwise(F.col("s1")))
    upper = F.when(plain, 5.5).otherwise(most)
    p = p.withColumn("s3", near_boundary_downgrade(F.col("s2"), c, least, upper, unit))
    floor = (F.col("s3") == "minor") & (c < least) & (F.col("ms") <= F.col("short_median_ms") + FRAME_MS)
    p = p.withColumn("severity", F.when(floor, "style").otherwise(F.col("s3")))
    return p.withColumns(
        {
            "status": F.when(skipped, "skipped").otherwise("assessed"),
            "severity": F.when(~skipped, F.col("severity")),
            "expected": (least + most) / 2, "actual": F.bround(c, 2),
        }
    ).drop("s0", "s1", "s2", "s3")
