"""Signal measures over recordings made of events: a tone or silence for each event, twenty to a file.

A tone's level is the same in every frame that a kernel looks at, as each piece lasts whole frames
of whole periods, so SQL can tell from the events alone what a kernel must find.
"""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signal
from ..sources import corpus
from . import recitation
from .scripted import choice
from .tables import SQL_POS, positions

RATE = signal.RATE
#: Events in a file, and milliseconds of a frame.
FILE, FRAME = 20, 30
#: Levels over the closure's of the two parts after it.
RISES = (1.0, 1.7, 3.0, 5.0, 8.0)
WHOLE_MS = 10_000_000.0


def _pieces(spark, d) -> DataFrame:
    """file_id, idx, frames, level, hz, first (frames before it) of every event."""
    quiet = F.col("event_type") == "error"
    p = positions(spark, d).select(
        F.concat_ws("-", "user_id", F.floor(F.col("pos") / FILE)).alias("file_id"), (F.col("pos") % FILE).alias("idx"), "event_id", "event_type",
        F.when(quiet, 12 + F.col("event_id") % 3 * 30).otherwise(2 + F.col("event_id") % 4).cast("int").alias("frames"),
        F.when(quiet, 0.0).otherwise(0.2 + F.col("event_id") % 10 * 0.07).alias("level"), F.lit(300.0).alias("hz"),
    )
    w = Window.partitionBy("file_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return p.withColumn("first", F.coalesce(F.sum("frames").over(w), F.lit(0)))


SQL_PIECES = f"""SELECT *, CAST(sum(frames) OVER (PARTITION BY file_id ORDER BY idx) AS BIGINT) - frames AS first, CAST(sum(frames) OVER (PARTITION BY file_id) AS BIGINT) AS total FROM (
    SELECT user_id || '-' || (pos // {FILE}) AS file_id, pos % {FILE} AS idx, event_id, event_type, event_type = 'error' AS quiet,
    CASE WHEN event_type = 'error' THEN 12 + event_id % 3 * 30 ELSE 2 + event_id % 4 END AS frames FROM ({SQL_POS}))"""
#: Runs of sound and of silence: a run is what has equally many of the other kind before it.
SQL_RUNS = f"""SELECT file_id, quiet, total, min(first) AS a, max(first + frames) AS b FROM (
    SELECT *, sum(CASE WHEN quiet THEN 1 ELSE 0 END) OVER w AS q, sum(CASE WHEN quiet THEN 0 ELSE 1 END) OVER w AS s FROM ({SQL_PIECES}) WINDOW w AS (PARTITION BY file_id ORDER BY idx))
    GROUP BY file_id, quiet, total, CASE WHEN quiet THEN s ELSE q END"""


@lru_cache(4096)
def _tone(hz: float, level: float) -> np.ndarray:
    """The samples after which a tone of whole Hz repeats."""
    return (np.sin(2 * np.pi * hz * np.arange(RATE // math.gcd(RATE, int(hz))) / RATE) * level * 32767).astype(np.int16)


def made(row: dict) -> bytes:
    """A 16-bit file of the tones of a row's pieces (idx, frames, level, hz), each frame ``frame_ms`` long."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(RATE)
        parts = sorted(row["pieces"], key=lambda p: p["idx"])
        w.writeframes(np.concatenate([np.resize(_tone(p["hz"], p["level"]), p["frames"] * RATE * row["frame_ms"] // 1000) for p in parts]).tobytes())
    return out.getvalue()


def scores(pieces: DataFrame, frame_ms: int = FRAME) -> DataFrame:
    """file_id, pieces, frame_ms: what ``made`` turns into a recording, where it is read; twenty pieces or so.

    A second of sound is 32,000 bytes and its piece a few, so scores are what is shuffled and joined.
    """
    g = signal.spread(pieces).groupBy("file_id").agg(F.collect_list(F.struct("idx", "frames", F.col("level").cast("double").alias("level"), "hz")).alias("pieces"))
    return g.withColumn("frame_ms", F.lit(frame_ms))


def recordings(pieces: DataFrame, frame_ms: int = FRAME, stored: Callable[[bytes], bytes] = bytes) -> DataFrame:
    """file_id, content: the recordings themselves, a few at a time, as they are to be ``stored``."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 16):
                rows = batch.slice(k, 16).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([r["file_id"] for r in rows], pa.string()), pa.array((stored(made(r)) for r in rows), pa.binary())], names=["file_id", "content"])

    return scores(pieces, frame_ms).mapInArrow(run, "file_id string, content binary")


def _files(spark, d, stored: Callable[[bytes], bytes] = bytes) -> DataFrame:
    return recordings(_pieces(spark, d), stored=stored)


def _numbers(spark, d, rows) -> DataFrame:
    """A row for each number that ``rows(samples, rate)`` gives of each recording."""
    each = lambda r, x, rate: [(r["file_id"], k, int(v)) for k, v in enumerate(rows(x, rate))]
    return signal.over_files(scores(_pieces(spark, d)), each, "file_id string, ordinal bigint, ms bigint", made)


def voice_activity(spark, d):
    """Starts and ends of speech, in order."""
    return _numbers(spark, d, lambda x, rate: [v for s in signal.voice_activity(x, rate) for v in s])


def restarts(spark, d):
    """Where the last attempt begins; recordings without a long pause, or that end in one, have none."""
    return _numbers(spark, d, lambda x, rate: [v for v in [signal.restart_ms(x, rate)] if v is not None])


def repeated_phrases(spark, d):
    """Phrases that the next one repeats."""
    return _numbers(spark, d, lambda x, rate: [v for s in signal.repetitions(x, rate) for v in s])


def silent_boundaries(spark, d):
    """Middles of the pauses, and of the longest of them."""

    def rows(r, x, rate):
        for expected in (None, 1):
            yield from ((r["file_id"], k, at, expected or 0) for k, at in enumerate(signal.dual_silences(x, rate, expected=expected)))

    return signal.over_files(scores(_pieces(spark, d)), rows, "file_id string, ordinal bigint, ms bigint, expected int", made)


def nasal_stretches(spark, d):
    """The longest stretch of low energy of each recording, where views sound low and all others high."""
    p = _pieces(spark, d).withColumns({
        "frames": (6 + F.col("event_id") % 4 * 3).cast("int"), "level": F.lit(0.5), "hz": F.when(F.col("event_type") == "view", 300.0).otherwise(2000.0),
    })
    seg = p.select("file_id").distinct().select("file_id", F.lit(0.0).alias("start_ms"), F.lit(WHOLE_MS).alias("end_ms"))
    m = signal.measure(seg, scores(p, 10), lambda x, rate: signal.nasal_stretch(x, rate, 200.0), "acoustic_ms double, found boolean, corrected boolean", made)
    return m.select("file_id", "acoustic_ms", "found", "corrected")


def echoes(spark, d):
    """A closure, two rises and silence for each event: the peak, how long it is sustained, and when it is released."""
    e = _pieces(spark, d)
    rise = lambda n: choice(RISES, n % len(RISES))
    c = 0.01 * (1 + F.col("event_id") % 4)
    parts = F.array(*[
        F.struct(F.lit(n).alias("frames"), (c * up).alias("level"))
        for n, up in ((10, F.lit(1.0)), (10, rise(F.col("event_id"))), (20, rise(F.floor(F.col("event_id") / len(RISES)))), (20, F.lit(0.0)))
    ])
    p = e.select("file_id", "idx", F.posexplode(parts).alias("part", "x")).select("file_id", (F.col("idx") * 4 + F.col("part")).alias("idx"), "x.frames", "x.level", F.lit(500.0).alias("hz"))
    seg = e.select("file_id", "event_id", (F.col("idx") * 300.0).alias("start_ms"), (F.col("idx") * 300.0 + 300.0).alias("end_ms"))

    def kernel(x, rate):
        got = signal.echo(x, rate, 100.0)
        return got and got | {"skip_reason": got["skip"]}

    m = signal.measure(seg, scores(p, 5), kernel, "peak_ratio double, sustain_ms double, release_ms double, skip_reason string", made)
    return m.select("event_id", F.round("peak_ratio").alias("peak_ratio"), "sustain_ms", "release_ms", "skip_reason")


def segment_files(spark, d):
    """Every stretch of sound cut out with 100 ms of silence on both sides, read back."""
    p = _pieces(spark, d)
    w = Window.partitionBy("file_id").orderBy("idx")
    runs = p.withColumn("_q", F.sum(F.when(F.col("level") == 0, 1).otherwise(0)).over(w)).where("level > 0")
    seg = runs.groupBy("file_id", "_q").agg(
        (F.min("first") * float(FRAME)).alias("start_ms"), (F.max(F.col("first") + F.col("frames")) * float(FRAME)).alias("end_ms")
    ).withColumn("segment", F.col("_q").cast("int"))
    absent = seg.limit(1).withColumn("file_id", F.lit("absent"))
    parts = corpus.segment_files(seg.unionByName(absent), scores(p), 100.0, made)

    def rows(r, x, rate):
        yield f"{r['file_id']}/{r['segment']}", len(x) / rate * 1000, float(np.abs(x[: rate // 10]).max() == 0)

    return signal.over_files(parts, rows, "file_id string, ms double, quiet double")


_STEPS = recitation.Config(find_restarts=True)


def preprocessed(spark, d):
    """Start of the last attempt and length of each recording, with and without the step."""
    f = scores(_pieces(spark, d))
    both = [recitation.preprocess(f, c, made).withColumn("steps", F.lit(n)) for n, c in (("all", _STEPS), ("none", recitation.Config()))]
    return both[0].unionByName(both[1]).select("file_id", "steps", "from_ms", "length_ms", F.size("repeated").cast("bigint").alias("n_repeated"))


def segmented(spark, d):
    """Recordings cut at their longest silences, one to three verses each, where the last attempt alone counts."""
    p = _pieces(spark, d)
    f = scores(p)
    n = p.groupBy("file_id").agg(F.count("*").alias("n"))
    want = n.select("file_id", F.explode(F.sequence(F.lit(1), (1 + F.col("n") % 3).cast("int"))).alias("verse"), F.lit(1000.0).alias("length"))
    return recitation.segment(f, recitation.preprocess(f, _STEPS, made), want, _STEPS, made)


QUERIES = {f.__name__: f for f in (
    voice_activity, restarts, repeated_phrases, silent_boundaries, nasal_stretches, echoes, segment_files, preprocessed, segmented,
)}

_SPEECH = f"SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY a) - 1 AS k FROM ({SQL_RUNS}) WHERE NOT quiet"
_RESTARTS = f"""SELECT file_id, max(a) FILTER (WHERE (a - before) * {FRAME} >= 2000) * {FRAME} AS ms FROM (
    SELECT *, lag(b) OVER (PARTITION BY file_id ORDER BY a) AS before, max(b) OVER (PARTITION BY file_id) AS last FROM ({_SPEECH}))
    WHERE (total - last) * {FRAME} < 2000 GROUP BY file_id"""
_QUIET = f"""SELECT r.file_id, 15 * (a + b) AS ms, row_number() OVER (PARTITION BY r.file_id ORDER BY b - a DESC, a) AS longest, total
    FROM ({SQL_RUNS}) r WHERE quiet AND r.file_id IN (SELECT file_id FROM ({_SPEECH}))
    AND 15 * (a + b) > greatest(200, total * {FRAME} // 100) AND 15 * (a + b) < total * {FRAME} - greatest(200, total * {FRAME} // 100)"""
_UP = lambda n: "[" + ", ".join(f"{x}::DOUBLE" for x in RISES) + f"][{n} % {len(RISES)} + 1]"

ORACLES = {
    "voice_activity": f"SELECT file_id, 2 * k AS ordinal, a * {FRAME} AS ms FROM ({_SPEECH}) UNION ALL SELECT file_id, 2 * k + 1, b * {FRAME} FROM ({_SPEECH})",
    "restarts": f"SELECT file_id, CAST(0 AS BIGINT) AS ordinal, ms FROM ({_RESTARTS}) WHERE ms IS NOT NULL",
    "silent_boundaries": f"""SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY ms) - 1 AS ordinal, ms, 0 AS expected FROM ({_QUIET})
        UNION ALL SELECT file_id, 0, ms, 1 FROM ({_QUIET}) WHERE longest = 1""",
    "nasal_stretches": f"""WITH p AS (SELECT *, event_type = 'view' AS low, 6 + event_id % 4 * 3 AS n FROM ({SQL_PIECES})),
        r AS (SELECT file_id, sum(n) AS n FROM (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY idx) AS g FROM p) WHERE low GROUP BY file_id, g),
        b AS (SELECT p.file_id, max(r.n) AS n FROM (SELECT DISTINCT file_id FROM p) p LEFT JOIN r ON r.file_id = p.file_id GROUP BY p.file_id)
        SELECT file_id, CAST(coalesce(n * 10, 200) AS DOUBLE) AS acoustic_ms, n IS NOT NULL AS found, n IS NOT NULL AND abs(n * 10 - 200) > 10 AS corrected FROM b""",
    "echoes": f"""WITH e AS (SELECT event_id, {_UP('event_id')} AS u, {_UP('(event_id // 5)')} AS v FROM events)
        SELECT event_id, CASE WHEN greatest(u, v) <= 2 THEN round(greatest(u, v)) WHEN u > 2 THEN greatest(u, v) ELSE v END AS peak_ratio,
        CAST(CASE WHEN greatest(u, v) <= 2 THEN 0 WHEN u > 2 THEN CASE WHEN v > 1.2 THEN 150 ELSE 50 END ELSE 100 END AS DOUBLE) AS sustain_ms,
        CAST(CASE WHEN greatest(u, v) <= 2 THEN 0 WHEN u > 2 THEN 50 ELSE 100 END AS DOUBLE) AS release_ms, CASE WHEN greatest(u, v) <= 2 THEN 'no_closure_detected' END AS skip_reason FROM e""",
    "segment_files": f"""SELECT file_id || '/' || q AS file_id, CAST(sum(frames) * {FRAME} + 200 AS DOUBLE) AS ms, 1.0::DOUBLE AS quiet FROM (
        SELECT *, CAST(sum(CASE WHEN quiet THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY idx) AS BIGINT) AS q FROM ({SQL_PIECES})) WHERE NOT quiet GROUP BY file_id, q""",
    "preprocessed": f"""WITH f AS (SELECT DISTINCT file_id, total * {FRAME} AS n FROM ({SQL_PIECES}))
        SELECT f.file_id, 'all' AS steps, coalesce(ms, 0) AS from_ms, n AS length_ms, CAST(0 AS BIGINT) AS n_repeated FROM f LEFT JOIN ({_RESTARTS}) r ON r.file_id = f.file_id
        UNION ALL SELECT file_id, 'none', 0, n, 0 FROM f""",
    "segmented": f"""WITH f AS (SELECT file_id, any_value(total) * {FRAME} AS n, count(*) % 3 AS cuts FROM ({SQL_PIECES}) GROUP BY file_id),
        e AS (SELECT file_id, 0 AS cut_at FROM f UNION SELECT file_id, n FROM f UNION SELECT q.file_id, ms FROM ({_QUIET}) q JOIN f ON f.file_id = q.file_id AND longest <= cuts),
        s AS (SELECT e.file_id, cut_at, lead(cut_at) OVER (PARTITION BY e.file_id ORDER BY cut_at) AS e, coalesce(ms, 0) AS since FROM e LEFT JOIN ({_RESTARTS}) r ON r.file_id = e.file_id)
        SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY cut_at) AS ordinal, CAST(greatest(cut_at, since) AS DOUBLE) AS start, CAST(e AS DOUBLE) AS "end", 'high' AS confidence FROM s WHERE e > since""",
}
