"""Sequential repairs of one recording at a time: splitting, merging, word allocation.

Each decision depends on the one before, so a recording is handled as a group in pandas; a
recording has at most a few thousand segments, and recordings spread over all tasks.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_points(duration: float, silences: Sequence[tuple[float, float]], limit: float) -> list[float]:
    """Times to cut at until no part exceeds ``limit`` seconds.

    A part that is too long is cut at its best silence (long, and near the middle), at least one
    second from its ends, or in the middle where it has none, and so are its halves. Without any
    silence half a second inside the recording there is one cut, in the middle.
    """
    quiet = np.array([((a + b) / 2, b - a) for a, b in sorted(silences) if 0.5 < (a + b) / 2 < duration - 0.5]).reshape(-1, 2)
    if duration > limit and not len(quiet):
        return [duration / 2]

    def cuts(low: float, high: float) -> list[float]:
        if high - low <= limit:
            return []
        at = (low + high) / 2
        here = quiet[(quiet[:, 0] > low + 1) & (quiet[:, 0] < high - 1)]
        if len(here):
            at = float(here[(here[:, 1] * (1 - np.abs(here[:, 0] - at) / (high - low))).argmax(), 0])
        return [*cuts(low, at), at, *cuts(at, high)]

    return cuts(0.0, duration)


def allocate(n_words: int, durations: Sequence[float]) -> list[int]:
    """Words of each segment in proportion to its length (rounded half to even), one at least,
    one left for each segment to come; the last takes the rest."""
    if not len(durations):
        return []
    shares = np.rint(np.asarray(durations, float) / sum(durations) * n_words).astype(int)
    most = n_words - np.arange(len(durations) - 1, 0, -1)  # words used up to a segment leave one for each after it
    edges = list(itertools.accumulate(zip(shares, most), lambda used, s: used + max(1, min(s[0], s[1] - used)), initial=0))
    return np.diff([*edges, max(n_words, edges[-1])]).tolist()


def merge_short(segments: Sequence[tuple[float, float]], expected: Sequence[float], least: float) -> list[tuple[float, float, str]]:
    """(start, end, confidence): a segment shorter than ``least`` times its expected length joins its successor.

    The i-th segment is held against the i-th expected length, the last of them for any more;
    0 means unknown. A short last segment stays, with low confidence.
    """
    out, rest = [], iter(enumerate(segments))
    for i, (start, end) in rest:
        short = end - start < least * want_of(expected, i)
        follower = next(rest, None) if short else None
        out.append((start, follower[1][1], "recovered") if follower else (start, end, "low" if short else "high"))
    return out


def want_of(expected: Sequence[float], i: int) -> float:
    return expected[min(i, len(expected) - 1)] if len(expected) else 0.0


def split_long(segments: Sequence[tuple[float, float, str]], expected: Sequence[float], most: float, marks: Sequence[float]) -> list[tuple[float, float, str]]:
    """The second pass: a segment longer than ``most`` times its expected length is cut at the marks
    (middles of silences, found more readily than before) inside it; without one it stays."""
    out = []
    for i, (start, end, state) in enumerate(segments):
        want = want_of(expected, i)
        inside = [m for m in sorted(marks) if start < m < end] if 0 < want * most < end - start else []
        edges = [start, *inside, end]
        out += [(a, b, "recovered" if inside else state) for a, b in zip(edges, edges[1:])]
    return out


def split_recordings(recordings: DataFrame, silences: DataFrame, limit: float) -> DataFrame:
    """recordings(file_id, duration, n_words), silences(file_id, start, end) -> segments:
    file_id, segment, offset, duration, first_word, n_words. A short recording is one segment."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        columns = ["file_id", "segment", "offset", "duration", "first_word", "n_words"]
        if "duration" not in a.columns or not len(a):
            return pd.DataFrame({c: [] for c in columns}, dtype=object)
        quiet = sorted(zip(b["start"], b["end"])) if "start" in b.columns else []
        rows = []
        for file_id, duration, n in zip(a["file_id"], a["duration"], a["n_words"]):
            edges = [0.0, *split_points(duration, quiet, limit), duration]
            lens = [y - x for x, y in zip(edges, edges[1:])]
            at = 0
            for k, (offset, length, words) in enumerate(zip(edges, lens, allocate(int(n), lens))):
                rows.append((file_id, k + 1, offset, length, at, words))
                at += words
        return pd.DataFrame(rows, columns=columns, dtype=object)

    left = recordings.select("file_id", "duration", "n_words").groupBy("file_id")
    return left.cogroup(silences.select("file_id", "start", "end").groupBy("file_id")).applyInPandas(
        run, "file_id string, segment int, offset double, duration double, first_word int, n_words int"
    )


def recover_segments(segments: DataFrame, expected: DataFrame, least: float = 0.5, marks: DataFrame | None = None, most: float = 2.0) -> DataFrame:
    """segments(file_id, start, end), expected(file_id, verse, length), marks(file_id, at) ->
    file_id, ordinal, start, end, confidence: short segments merged, then long ones cut at marks."""
    side = lambda df, kind, *cols: df.select("file_id", F.lit(kind).alias("kind"), *[c.cast("double").alias(n) for c, n in zip(cols, "xy")])
    rows = side(segments, 0, F.col("start"), F.col("end")).unionByName(side(expected, 1, F.col("verse"), F.col("length")))
    if marks is not None:
        rows = rows.unionByName(side(marks, 2, F.col("at"), F.lit(None)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = lambda k: sorted(zip(pdf.x[pdf.kind == k], pdf.y[pdf.kind == k]))
        want = [length for _, length in part(1)]
        found = split_long(merge_short(part(0), want, least), want, most, [at for at, _ in part(2)])
        return pd.DataFrame([(pdf.file_id.iloc[0], k + 1, *f) for k, f in enumerate(found)], columns=["file_id", "ordinal", "start", "end", "confidence"], dtype=object)

    return rows.groupBy("file_id").applyInPandas(run, "file_id string, ordinal int, start double, end double, confidence string")
