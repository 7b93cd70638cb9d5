"""Reports over assessments: verse and chapter roll-ups, run summaries, spot checks, balanced choices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import passed_share, unclamped_score

#: Rules of each category of a recording's report; the names that ``plans.phonology`` emits stand beside the report's own.
CATEGORIES = {
    "madd": (
        "madd_tabii", "madd_muttasil", "madd_munfasil", "madd_lazim", "madd_lazim_kalimi", "madd_lazim_muthaqqal_kalimi", "madd_aarid", "madd_arid_lissukun", "madd_leen", "madd_badal",
        "madd_silah_kubra", "madd_silah_sughra",
    ),
    "ghunnah": ("ghunnah", "ghunnah_mushaddadah_noon", "ghunnah_mushaddadah_meem", "ghunnah_idgham_with_ghunnah", "idgham_ghunnah_noon", "idgham_shafawi_meem", "iqlab"),
    "qalqalah": ("qalqalah", "qalqalah_minor", "qalqalah_major", "qalqalah_with_shaddah", "qalqalah_emphatic", "qalqalah_non_emphatic"),
    "ikhfa": ("ikhfa_haqiqi", "ikhfaa_light", "ikhfaa_heavy", "ikhfa_shafawi", "ikhfaa_shafawi", "ikhfa_meem_saakin"),
    "vowel_backing": (
        "emphatic_backing", "pharyngeal_backing", "vowel_backing_after_emphatic_short", "vowel_backing_after_emphatic_long", "vowel_backing_before_emphatic_short",
        "vowel_backing_before_emphatic_long",
    ),
    "tafkhim": ("tafkhim",),
}


def together(*assessments: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All rows of several assessors, in the columns that a report needs; ``assessor`` is their number."""
    parts = [a.select(*columns, F.lit(i).alias("assessor")) for i, a in enumerate(assessments)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _sums() -> dict[str, Column]:
    done = F.col("status") == "assessed"
    counts = {s: F.count_if(done & (F.col("severity") == s)) for s in ("major", "minor", "style")}
    return {"assessed": F.count_if(done), "skipped": F.count_if(~done), "errors": F.count_if(done & F.col("severity").isNotNull())} | counts


def roll_up(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows(key, status, severity) -> assessed, skipped, errors and errors of each severity."""
    return rows.groupBy(*key).agg(*[c.alias(n) for n, c in _sums().items()])


def recording_report(rows: DataFrame, verse: Sequence[str], metadata: DataFrame, rule: str = "rule") -> DataFrame:
    """Per verse: counts, passed (assessed without major and minor, at least 0), errors of each category, and the
    confidence of its segment ("low" where none is known; where ``metadata`` repeats a verse, that of its greatest
    ``ordinal``, or without that column the greatest in order of text, so a verse is one row)."""
    bad = (F.col("status") == "assessed") & F.col("severity").isNotNull()
    by = rows.groupBy(*verse).agg(
        *[c.alias(n) for n, c in _sums().items()], *[F.count_if(bad & F.col(rule).isin(*names)).alias(f"n_{c}") for c, names in CATEGORIES.items()]
    )
    by = by.withColumn("passed", F.greatest(F.col("assessed") - F.col("major") - F.col("minor"), F.lit(0)))
    latest = F.col("ordinal") if "ordinal" in metadata.columns else F.col("confidence")
    one = metadata.groupBy(*verse).agg(F.max_by("confidence", F.struct(latest, "confidence")).alias("confidence"))
    return by.join(one, list(verse), "left").withColumn("confidence", F.coalesce("confidence", F.lit("low")))


def overall_score(verses: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per recording: verses, errors, assessed, and the share that passed in per cent, one decimal."""
    g = verses.groupBy(*key).agg(F.count("*").alias("n_verses"), F.sum("errors").alias("errors"), F.sum("assessed").alias("assessed"), F.sum("passed").alias("passed"))
    return g.withColumn("score", F.round(F.col("passed") / F.greatest("assessed", F.lit(1)) * 100, 1))


def chapter_json(rows: DataFrame, calibration: DataFrame, chapter: str, verse: str, details: Sequence[str]) -> DataFrame:
    """chapter, value: an assessment file's text: calibration, and each verse with its counts and errors in order."""
    bad = (F.col("status") == "assessed") & F.col("severity").isNotNull()
    errors = F.array_sort(F.collect_list(F.when(bad, F.struct(*details, "severity"))))
    v = rows.groupBy(chapter, verse).agg(errors.alias("errors"), *[_sums()[n].alias(n) for n in ("assessed", "skipped")])
    c = v.groupBy(chapter).agg(F.array_sort(F.collect_list(F.struct(F.col(verse).alias("verse"), "assessed", "skipped", "errors"))).alias("verses"))
    cal = calibration.select(chapter, F.struct(F.round("unit_ms", 1).alias("unit_ms"), F.round("short_median_ms", 1).alias("short_median_ms"), "is_default", "tolerance").alias("calibration"))
    return c.join(cal, chapter, "left").select(chapter, F.to_json(F.struct(F.col(chapter).alias("chapter"), "calibration", "verses")).alias("value"))


def run_summary(rows: DataFrame, chapter: str) -> DataFrame:
    """One row a chapter with its score, and the totals of the run on every row."""
    g = roll_up(rows, [chapter])
    all_ = Window.partitionBy()  # one row a chapter
    return g.withColumn("score", F.round(unclamped_score(F.col("major"), F.col("minor"), F.col("assessed")), 1)).withColumns(
        {f"total_{n}": F.sum(n).over(all_) for n in ("errors", "assessed", "skipped")}
    )


def alignment_quality(expected: DataFrame, aligned: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per verse: words and sounds that were expected and that were aligned, and the share of sounds, four decimals."""
    side = lambda df, name: df.groupBy(*key).agg(F.countDistinct("word_idx").alias(f"words_{name}"), F.count("*").alias(f"phones_{name}"))
    j = side(expected, "expected").join(side(aligned, "aligned"), list(key), "full_outer")
    names = ["words_expected", "words_aligned", "phones_expected", "phones_aligned"]
    j = j.select(*key, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    return j.withColumn("coverage", F.when(F.col("phones_expected") > 0, F.round(F.col("phones_aligned") / F.col("phones_expected"), 4)).otherwise(0.0))


def last_wins(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One row of each key: the last in ``order``."""
    others = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*others), order)
    return rows.groupBy(*key).agg(best.alias("_b")).select(*key, *[F.col(f"_b.{c}").alias(c) for c in others])


def spot_check(cases: DataFrame, details: DataFrame, on: Sequence[str], label: str, order: str, missing: str = "not evaluated") -> DataFrame:
    """Each case with the label of the first detail that fits it, or ``missing``."""
    first = details.groupBy(*on).agg(F.min_by(label, order).alias("_found"))
    return cases.join(first, list(on), "left").withColumn(label, F.coalesce("_found", F.lit(missing))).drop("_found")


def one_row_a_place(details: DataFrame, key: Sequence[str], rule: str, order: str) -> DataFrame:
    """Details of one place under several rules become one row: its rules, sorted, and the other columns of the first."""
    others = [c for c in details.columns if c not in (*key, rule)]
    g = details.groupBy(*key).agg(F.sort_array(F.collect_set(rule)).alias("rules"), F.min_by(F.struct(*others), order).alias("_f"))
    return g.select(*key, "rules", *[F.col(f"_f.{c}").alias(c) for c in others])


def word_sets(words: DataFrame, errors: DataFrame, key: Sequence[str], position: str) -> DataFrame:
    """Per verse: sorted positions of verified words and of skipped ones (those with an error), which share none."""
    bad = errors.select(*key, position).distinct().withColumn("_bad", F.lit(True))
    j = words.join(bad, [*key, position], "left")
    pick = lambda test: F.sort_array(F.collect_set(F.when(test, F.col(position))))
    return j.groupBy(*key).agg(pick(F.col("_bad").isNull()).alias("verified"), pick(F.col("_bad").isNotNull()).alias("skipped"))


def skip_flags(words: DataFrame, errors: DataFrame, on: Sequence[str], kind: str, order: str) -> DataFrame:
    """Words with ``skip`` and the kind of their first error."""
    first = errors.groupBy(*on).agg(F.min_by(kind, order).alias(kind))
    return words.join(first, list(on), "left").withColumn("skip", F.col(kind).isNotNull())


def duration_outliers(df: DataFrame, group: str, value: str, low: float, high: float) -> DataFrame:
    """Values out of bounds by group and reason, with their rank: most first, then by group."""
    reason = F.when(F.col(value) < low, "too_short").when(F.col(value) > high, "too_long")
    g = df.groupBy(group, reason.alias("reason")).agg(F.count("*").alias("n")).where("reason IS NOT NULL")
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), group, "reason")))  # a row a group and reason


def ranked_counts(df: DataFrame, value: str, order: str) -> DataFrame:
    """Counts of each value, the most frequent first; of equally frequent ones the first seen. Values are few (rules)."""
    g = df.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "first_seen")))


def first_examples(df: DataFrame, key: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("example", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("example") <= n)


def seeded_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows without replacement, the same for one seed however rows are partitioned: those of the smallest digest."""
    return df.withColumn("draw", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))).orderBy("draw", key).limit(n)


def class_ranks(candidates: DataFrame, order: str) -> DataFrame:
    """class, rank (from 1): classes in order of their first candidate, of equal ones by name."""
    first = candidates.where("class IS NOT NULL").groupBy("class").agg(F.min(order).alias("_o"))
    return first.select("class", F.row_number().over(Window.orderBy("_o", "class")).alias("rank"))  # a row a class


def _cut(df: DataFrame) -> DataFrame:
    """The rows, written in the shared folder of checkpoints; on one machine that names none, in one of the warehouse."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(folder or df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_selections")
    return df.checkpoint()


def balanced_selection(candidates: DataFrame, ranks: DataFrame, item: str, order: str, each: int) -> DataFrame:
    """At most ``each`` items a class, by ``order`` and item; an item is used once over all classes, by the class of the lowest ``rank``.

    The same as if classes chose one after another, but all of them choose at once: each takes its
    first items, an item keeps the best class that takes it, and is closed to all classes behind
    that one; this repeats until no item is taken twice. After k rounds the first k classes are
    settled, mostly many more. A class of rank r can lose each * (r - 1) items, so more than
    each * r of its candidates are never looked at. Rows without a class, an item or a rank take no part.
    """
    n = ranks.count()
    place = F.row_number().over(Window.partitionBy("class").orderBy(order, item))
    best = candidates.where(F.col("class").isNotNull() & F.col(item).isNotNull()).groupBy("class", item).agg(F.min(order).alias(order))
    # the literal bound cuts a large class before it is exchanged
    best = best.withColumn("_k", place).where(F.col("_k") <= each * n)
    pool = _cut(best.join(ranks.select("class", "rank"), "class").where(F.col("_k") <= each * F.col("rank")).drop("_k"))
    left = pool.count()
    while True:
        taken = pool.withColumn("_k", place).where(F.col("_k") <= each).drop("_k")
        held = taken.groupBy(item).agg(F.min("rank").alias("_held"))
        pool = _cut(pool.join(held, item, "left").where("_held IS NULL OR rank <= _held").select("class", item, order, "rank"))
        before, left = left, pool.count()
        if left == before:
            return taken.select("class", item, order)


def passed(verses: DataFrame) -> DataFrame:
    return verses.withColumn("passed_share", passed_share(F.col("major"), F.col("minor"), F.col("assessed")))


def request_problem(chapter: Column, first: Column, last: Column, most: int = 20, chapters: int = 114) -> Column:
    """Why a request for verses is turned away; null: it is not."""
    return (
        F.when((chapter < 1) | (chapter > chapters), f"chapter must be between 1 and {chapters}").when(first < 1, "the first verse must be at least 1")
        .when(last < first, "the last verse must not be before the first").when(last - first > most, f"no more than {most} verses at once")
    )


def time_stamp(ms: Column) -> Column:
    """m:ss.mmm of a time in milliseconds."""
    t = F.round(ms).cast("bigint")
    return F.format_string("%d:%02d.%03d", F.floor(t / 60000), F.floor(t % 60000 / 1000), t % 1000)


def values_at(df: DataFrame, key: Sequence[str], x: str, y: str, points: DataFrame, at: str) -> DataFrame:
    """Linear interpolation of y at each point between its neighbours in x; the nearest value beyond the ends."""
    both = df.select(*key, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.lit(0).alias("_p")).unionByName(
        points.select(*key, F.col(at).cast("double").alias("_x"), F.lit(None).cast("double").alias("_y"), F.lit(1).alias("_p"))
    )
    known = F.when(F.col("_p") == 0, F.struct("_x", "_y"))
    w = Window.partitionBy(*key).orderBy("_x", "_p")
    back = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    s = both.withColumns({"_a": back, "_b": ahead}).where("_p = 1")
    inside = F.col("_a._y") + (F.col("_b._y") - F.col("_a._y")) * (F.col("_x") - F.col("_a._x")) / (F.col("_b._x") - F.col("_a._x"))
    value = F.when(F.col("_a").isNull(), F.col("_b._y")).when(F.col("_b").isNull() | (F.col("_a._x") == F.col("_x")), F.col("_a._y")).otherwise(inside)
    return s.select(*key, F.col("_x").alias(at), value.alias(y))
