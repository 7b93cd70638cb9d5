"""Recordings from intake to assessable sounds: preprocessing, segmentation and postprocessing, each step by a switch.

Every step is off unless the configuration asks for it, and works on many recordings at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signal
from ..operators import align, context, intervals, repair


@dataclass(frozen=True)
class Config:
    find_restarts: bool = False
    flag_repetitions: bool = False
    recover_segments: bool = False
    trim_finals: bool = False
    pair_geminates: bool = False
    grade_confidence: bool = False
    #: Least frames of 30 ms of a silence between verses, and of one in a segment that is too long.
    silence_frames: int = 10
    tight_frames: int = 5
    #: A segment is short below, and long above, these multiples of its expected length.
    short: float = 0.5
    long: float = 2.0


def preprocess(files: DataFrame, config: Config, read=signal.content) -> DataFrame:
    """files(file_id, content) -> file_id, from_ms (start of the last attempt), length_ms, repeated (spans that are said again).

    ``read`` makes a recording's bytes from a row, here and below.
    """

    def rows(r, x, rate):
        start = (signal.restart_ms(x, rate) if config.find_restarts else None) or 0
        spans = signal.repetitions(x, rate) if config.flag_repetitions else []
        yield r["file_id"], start, len(x) * 1000 // rate, [{"start_ms": a, "end_ms": b} for a, b in spans if a >= start]

    return signal.over_files(files, rows, "file_id string, from_ms bigint, length_ms bigint, repeated array<struct<start_ms:bigint,end_ms:bigint>>", read)


def boundaries(files: DataFrame, expected: DataFrame, least_frames: int, limit: bool, read=signal.content) -> DataFrame:
    """file_id, at: middles of silences; with ``limit`` no more than the recording's verses (``expected``) leave between them."""

    def rows(r, x, rate):
        for at in signal.dual_silences(x, rate, least_frames, expected=len(r["segments"]) - 1 if limit else None):
            yield r["file_id"], float(at)

    asked = signal.with_segments(expected, files, ["file_id"]).where("file IS NOT NULL")
    return signal.over_files(asked, rows, "file_id string, at double", lambda r: read(r["file"]))


def segment(files: DataFrame, prepared: DataFrame, expected: DataFrame, config: Config, read=signal.content) -> DataFrame:
    """expected(file_id, verse, length) in ms -> file_id, ordinal, start, end, confidence: a recording cut between its verses."""
    total = prepared.select("file_id", F.col("from_ms").cast("double").alias("from_ms"), F.col("length_ms").cast("double").alias("length_ms"))
    cuts = boundaries(files, expected, config.silence_frames, True, read)
    parts = intervals.segments_from_splits(cuts, ["file_id"], "at", total, "length_ms").join(total, "file_id")
    parts = parts.where(F.col("end") > F.col("from_ms")).select("file_id", F.greatest("start", "from_ms").alias("start"), "end")
    if not config.recover_segments:
        w = Window.partitionBy("file_id").orderBy("start")
        return parts.select("file_id", F.row_number().over(w).alias("ordinal"), "start", "end", F.lit("high").alias("confidence"))
    return repair.recover_segments(parts, expected, config.short, boundaries(files, expected, config.tight_frames, False, read), config.long)


def postprocess(sounds: DataFrame, key: Sequence[str], config: Config) -> DataFrame:
    """sounds(key, pos, symbol, duration_ms, confidence) with trimmed finals, geminate pairs and graded confidence, as asked."""
    order, out = ["pos"], sounds
    if config.trim_finals:
        out = context.with_final_trim(out, key, order, "duration_ms")
    if config.pair_geminates:
        out = context.with_equal_pairs(out, key, order, "symbol", "duration_ms")
    if config.grade_confidence:
        flags = {"confidence": "confidence", "ms": "duration_ms"} | ({"trimmed": "_trimmed"} if config.trim_finals else {})
        out = out.withColumn("_trimmed", F.col("trimmed").isNotNull() if config.trim_finals else F.lit(False))
        out = out.withColumn("confidence", align.confidence(flags)).drop("_trimmed")
        bad = F.col("confidence") == "failed"
        near = context.neighbour_flag(bad, key, order)
        out = out.withColumn("confidence", F.when(~bad & near, "low").otherwise(F.col("confidence")))
    return out
