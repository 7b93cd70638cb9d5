"""Literal cases whose rows are worked out by hand, and settings of defaults files."""

import duckdb
import pytest
import recorded_rows
from fixture_cases import ORACLES, QUERIES
from test_queries import plain

from seqloom.sources import inventory


#: Worked out by hand, then recorded.
ROWS = ORACLES | {n: sql for n, sql in recorded_rows.ORACLES.items() if n in QUERIES}


@pytest.mark.parametrize("name", sorted(ROWS))
def test_case(spark, name):
    df = QUERIES[name](spark, "")
    got = sorted(repr([plain(v) for v in r]) for r in df.collect())
    rows = duckdb.connect().sql(ROWS[name])
    assert sorted(df.columns) == sorted(rows.columns)
    assert got == sorted(repr([plain(v) for v in r]) for r in rows.select(*(f'"{c}"' for c in df.columns)).fetchall())


def test_settings():
    """Settings of a defaults file, built-in values where it has none."""
    given = inventory.parse("pitch: {baseline: {male: 130}, tolerance: {max_deviation: 20}}")
    paths = (("pitch.baseline.male", 120), ("pitch.baseline.female", 220), ("pitch.tolerance.max_deviation", 30))
    assert [inventory.setting(given, p, b) for p, b in paths] == [130, 220, 20]


def test_report_counts_the_assessors_own_rules(spark):
    """Every rule that an assessor grades falls into a category of the recording's report, and a repeated verse stays one row."""
    from seqloom.operators import assess, report, severity

    names = [*severity.LONG_RANGES, *assess.NASAL_COUNTS, *assess.ECHOED, *assess.HEAVY, *assess.BACKED]
    rows = spark.createDataFrame([(1, r, "assessed", "major") for r in names], "verse int, rule string, status string, severity string")
    meta = spark.createDataFrame([(1, 0, "high"), (1, 2, "medium"), (1, 1, "low")], "verse int, ordinal int, confidence string")
    (r,) = report.recording_report(rows, ["verse"], meta).collect()
    assert sum(r[f"n_{c}"] for c in report.CATEGORIES) == r.errors == len(names)
    assert r.n_qalqalah == len(assess.ECHOED) and r.n_vowel_backing == len(assess.BACKED) and r.confidence == "medium"


def test_uploads(spark):
    from pyspark.sql import functions as F

    from seqloom.sources import corpus

    cases = [
        ("a.wav", b"RIFFxxxx", None), ("a.WAV", b"RIFF", None), ("a.mp3", b"\xff\xfb\x90", None), ("a.aac", b"\xff\xf1", None), ("a.m4a", b"0000ftypM4A", None), ("a.wav", b"nothing", "format is not supported"),
        ("a", b"RIFF", "format is not supported"), (None, b"RIFF", "format is not supported"), ("a.txt", b"RIFF", "format is not supported"), ("a.ogg", b"", "file is empty"), ("a.ogg", None, "file is empty"), ("a.ogg", b"OggS" + b"x" * 100, "file is too large"),
    ]
    df = spark.createDataFrame([(n, None if b is None else bytearray(b), x) for n, b, x in cases], "name string, content binary, want string")
    got = df.select("want", corpus.upload_problem(F.col("name"), F.col("content"), 100).alias("problem")).collect()
    assert [r.problem for r in got] == [r.want for r in got]
