"""Assessments of measured sounds: duration, nasality, echo and formant bands by rule.

Inputs are tables of sounds with their rules and, where a measure is acoustic, its columns
from ``functions.signal.measure``. A null measure (no recording) is skipped, never graded.
Each function returns one row for each (sound, rule) with ``status`` and ``severity``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of each assessment.
NASAL_COUNTS = {
    "ghunnah_mushaddadah_noon": 2.0, "ghunnah_mushaddadah_meem": 2.0, "idgham_ghunnah_noon": 2.0, "iqlab": 2.0,
    "ikhfaa_light": 1.5, "ikhfaa_heavy": 1.5,
}
CONCEALED = ("ikhfaa_light", "ikhfaa_heavy")
ECHOED = ("qalqalah_major", "qalqalah_minor", "qalqalah_with_shaddah", "qalqalah_emphatic", "qalqalah_non_emphatic")
HEAVY = ("tafkhim",)
BACKED = ("vowel_backing_after_emphatic_short", "vowel_backing_before_emphatic_short", "vowel_backing_before_emphatic_long")
#: A nasal longer than this has taken in a pause; the aligner's frame; pitch recheck in counts.
PAUSE_MS, FRAME_MS, PITCH_LOW, PITCH_HIGH = 1500.0, 30.0, 8.0, 12.0
VOICED, STABLE_HZ = 0.5, 30.0


def two_count_band(counts: Column) -> Column:
    return (
        F.when(counts < 0.8, "major").when(counts < 1.2, "minor").when(counts <= 2.8, None).when(counts <= 8.0, "style")
        .when(counts <= 12.0, "minor").otherwise("major")
    )


def concealed_band(counts: Column) -> Column:
    return F.when(counts < 0.6, "major").when(counts < 1.0, "minor").when(counts <= 3.0, None).when(counts <= 7.0, "style").otherwise("minor")


def nasality_band(ratio: Column) -> Column:
    """Peak share of low energy: from 0.15 present, from 0.08 uncertain, else absent."""
    return F.when(ratio >= 0.15, None).when(ratio >= 0.08, "style").otherwise("major")


def concealment_verdict(mean: Column) -> Column:
    """Mean share of low energy of a concealed nasal."""
    return F.when(mean < 0.05, "izhar_error").when(mean < 0.08, "under_nasalized").when(mean <= 0.55, "pass").otherwise("over_nasalized")


def verdict_severity(verdict: Column) -> Column:
    return (
        F.when(verdict.isin("izhar_error", "tarqiq_error", "front_vowel_error"), "major").when(verdict.isin("under_nasalized", "borderline"), "minor")
        .when(verdict == "over_nasalized", "style")
    )


def echo_severity(rule: Column, label: Column) -> Column:
    """absent and weak echoes weigh more for the strong rule."""
    strong = rule == "qalqalah_major"
    return F.when(label == "present", None).when(strong, F.when(label == "absent", "major").otherwise("minor")).when(label == "absent", "minor").otherwise("style")


def heavy_verdict(f2: Column) -> Column:
    return F.when(f2 < 1200, "pass").when(f2 <= 1500, "borderline").otherwise("tarqiq_error")


def backing_verdict(f2: Column) -> Column:
    return F.when(f2 < 1400, "pass").when(f2 <= 2500, "borderline").otherwise("front_vowel_error")


def by_rule(sounds: DataFrame, rules: Sequence[str]) -> DataFrame:
    """A row for each of a sound's rules that is among ``rules``; second halves of pairs are left out."""
    names = F.array(*[F.lit(r) for r in rules])
    kept = sounds.where(~F.coalesce(F.col("geminate_position") == "second", F.lit(False)))
    return kept.withColumn("rule", F.explode(F.filter("rules", lambda r: F.array_contains(names, r))))


def unusable() -> Column:
    return F.col("skip") | F.col("confidence").isin("low", "failed")


def assess_nasal(sounds: DataFrame, calibration: DataFrame, key: Sequence[str]) -> DataFrame:
    """Length of nasal sounds in counts. Optional columns: acoustic_ms (measured length),
    voiced, pitch_std (pitch of the span; an unstable one shows a taken-in pause)."""
    for name in ("acoustic_ms", "voiced", "pitch_std"):
        if name not in sounds.columns:
            sounds = sounds.withColumn(name, F.lit(None).cast("double"))
    s = by_rule(sounds, tuple(NASAL_COUNTS)).join(calibration, list(key))
    s = s.withColumn("ms", F.coalesce("acoustic_ms", "geminate_total_ms", "duration_ms")).withColumn("counts", F.col("ms") / F.col("unit_ms"))
    band = F.when(F.col("rule").isin(*CONCEALED), concealed_band(F.col("counts"))).otherwise(two_count_band(F.col("counts")))
    grave = lambda c: F.coalesce(c.isin("major", "minor"), F.lit(False))
    s = s.withColumn("a", F.when(grave(band) & (F.col("ms") > PAUSE_MS), "style").otherwise(band))
    near = (F.col("a") == "minor") & (F.col("counts") < 1.2) & (F.col("ms") <= F.col("short_median_ms") + FRAME_MS)
    s = s.withColumn("b", F.when(near, "style").otherwise(F.col("a")))
    unstable = F.col("voiced").isNotNull() & ~((F.col("voiced") > VOICED) & (F.col("pitch_std") < STABLE_HZ))
    checked = (F.col("b") == "minor") & F.col("counts").between(PITCH_LOW, PITCH_HIGH) & unstable
    severity = F.when(checked, "style").otherwise(F.col("b"))
    return s.withColumns({"status": F.when(unusable(), "skipped").otherwise("assessed"), "severity": F.when(~unusable(), severity)}).drop("a", "b")


def _measured(sounds: DataFrame, rules: Sequence[str], measure: str, verdict: Column, low_counts: bool = True) -> DataFrame:
    skipped = F.col(measure).isNull() | (unusable() if low_counts else F.col("skip"))
    s = by_rule(sounds, rules).withColumn("status", F.when(skipped, "skipped").otherwise("assessed"))
    s = s.withColumn("verdict", F.when(~skipped, verdict))
    return s.withColumn("severity", verdict_severity(F.col("verdict")))


def assess_concealed(sounds: DataFrame) -> DataFrame:
    """Needs ``mean_nasality``."""
    return _measured(sounds, CONCEALED, "mean_nasality", concealment_verdict(F.col("mean_nasality")))


def assess_heavy(sounds: DataFrame) -> DataFrame:
    """Needs ``f2_hz`` at the middle."""
    return _measured(sounds, HEAVY, "f2_hz", heavy_verdict(F.col("f2_hz")))


def assess_backing(sounds: DataFrame) -> DataFrame:
    """Needs ``f2_hz``; an uncertain alignment still counts here."""
    return _measured(sounds, BACKED, "f2_hz", backing_verdict(F.col("f2_hz")), low_counts=False)


def assess_echo(sounds: DataFrame, ratio_from: float = 1.5, sustain_from_ms: float = 20.0, least_ms: float = 30.0) -> DataFrame:
    """Needs ``peak_ratio``, ``sustain_ms`` and, where ``functions.signal.echo`` gave one, ``skip_reason``;
    labels present, weak and absent. Sounds shorter than ``least_ms`` cannot hold a closure and a release."""
    if "skip_reason" not in sounds.columns:
        sounds = sounds.withColumn("skip_reason", F.lit(None).cast("string"))
    skipped = F.col("peak_ratio").isNull() | F.col("skip_reason").isNotNull() | unusable() | (F.coalesce("geminate_total_ms", "duration_ms") < least_ms)
    label = F.when(F.col("peak_ratio") < ratio_from, "absent").when(F.col("sustain_ms") < sustain_from_ms, "weak").otherwise("present")
    s = by_rule(sounds, ECHOED).withColumns({"status": F.when(skipped, "skipped").otherwise("assessed"), "echo": F.when(~skipped, label)})
    return s.withColumn("severity", F.when(~skipped, echo_severity(F.col("rule"), F.col("echo"))))


def majority_vote(labels: Column, priority: Sequence[str]) -> Column:
    """The most frequent label of an array; of equally frequent ones the first in ``priority``."""
    def count(label: str) -> Column:
        return F.size(F.filter(labels, lambda x: x == label))

    best = F.array_max(F.array(*[F.struct(count(v).alias("n"), F.lit(-i).alias("rank"), F.lit(v).alias("label")) for i, v in enumerate(priority)]))
    return F.when(best["n"] > 0, best["label"])


def eligible_for_unit(long_rules: Sequence[str] = ("madd_", "ghunnah_", "qalqalah"), least_ms: float = 30.0) -> Column:
    """Sounds that may tell the length of one count: sure, short, of no rule that lengthens, not paired and not last."""
    free = ~F.exists("rules", lambda r: F.greatest(*[r.startswith(p) for p in long_rules]))
    sure = (F.col("confidence") == "high") & ~F.col("skip") & ~F.col("is_final") & F.col("geminate_position").isNull()
    return sure & F.col("ipa").isin("a", "i", "u") & (F.col("duration_ms") >= least_ms) & free
