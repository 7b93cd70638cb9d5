"""Signal measures on arrays of samples: framed energy, band ratios, echo, pitch.

Kernels take one numpy array; ``measure`` runs them over many segments of many recordings
with one decode a recording (segments join their file as an array). They are small and free of
outside libraries, so results are defined by this file.
"""

from __future__ import annotations

import io
import wave

import numpy as np

RATE = 16_000


def decode_wav(content: bytes) -> tuple[np.ndarray, int]:
    """Samples of the first channel in [-1, 1] and the rate, for 16-bit files."""
    with wave.open(io.BytesIO(content)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit audio is read")
        raw = np.frombuffer(w.readframes(w.getnframes()), np.int16)
        return raw[:: w.getnchannels()].astype(np.float32) / 32768.0, w.getframerate()


def segment(samples: np.ndarray, rate: int, start_ms: float, end_ms: float, least: int = 512) -> np.ndarray | None:
    """Samples of a time range, clamped to the recording; None if fewer than ``least``."""
    a, b = max(0, int(start_ms * rate / 1000)), min(len(samples), int(end_ms * rate / 1000))
    return samples[a:b] if b - a >= least else None


def frames(x: np.ndarray, size: int, step: int) -> np.ndarray:
    """Overlapping frames as rows; the tail that fills none is left out."""
    if len(x) < size:
        return np.zeros((0, size), x.dtype)
    return np.lib.stride_tricks.sliding_window_view(x, size)[::step]


def rms(x: np.ndarray, size: int) -> np.ndarray:
    f = frames(x, size, size).astype(np.float64)
    return np.sqrt((f * f).mean(1) + 1e-12)


def nasality(x: np.ndarray, rate: int = RATE, size: int = 160, fft: int = 512) -> np.ndarray:
    """Share of the energy in 200-4000 Hz that lies in 200-400 Hz, for each 10 ms frame."""
    f = frames(x, size, size).astype(np.float64) * np.hanning(size)
    hz = np.fft.rfftfreq(fft, 1 / rate)
    heard = (hz >= 200) & (hz <= 4000)
    power = np.abs(np.fft.rfft(f, fft)[:, heard]) ** 2
    low, all_ = power[:, hz[heard] <= 400].sum(1), power.sum(1)
    return np.where(all_ < 1e-12, 0.0, low / np.maximum(all_, 1e-12))


def longest_run(flags: np.ndarray, least: int = 3, gap: int = 2) -> tuple[int, int] | None:
    """(first, last) of the longest stretch of runs of ``least`` true flags; runs that begin at most
    ``gap`` places after one's end join it; the first stretch on ties."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    runs = [(a, b - 1) for a, b in edges.reshape(-1, 2) if b - a >= least]
    if not runs:
        return None
    starts = [k for k in range(len(runs)) if not k or runs[k][0] - runs[k - 1][1] > gap]
    joined = [(runs[a][0], runs[b - 1][1]) for a, b in zip(starts, [*starts[1:], len(runs)])]
    first, last = max(joined, key=lambda r: r[1] - r[0])
    return int(first), int(last)


#: A nasal stretch begins above this share; its least length, frame and search margin.
NASAL_FROM, NASAL_LEAST_MS, NASAL_FRAME_MS, NASAL_MARGIN_MS = 0.12, 50.0, 10.0, 100.0


def nasal_stretch(x: np.ndarray, rate: int = RATE, aligned_ms: float | None = None, threshold: float = NASAL_FROM) -> dict[str, float] | None:
    """The longest stretch of three or more frames above ``threshold``: where it starts, its length,
    peak and mean share, whether it is long enough (``found``), and whether its length differs from the
    aligner's by more than a frame. ``x`` is the sound with its search margin; None without a frame."""
    share = nasality(x, rate)
    if not len(share):
        return None
    run = longest_run(share > threshold)
    if run is None:
        return {"start_ms": 0.0, "acoustic_ms": aligned_ms or 0.0, "peak_nasality": float(share.max()), "mean_nasality": float(share.mean()), "found": False, "corrected": False}
    inside, length = share[run[0] : run[1] + 1], (run[1] - run[0] + 1) * NASAL_FRAME_MS
    long_enough = length >= NASAL_LEAST_MS
    corrected = not long_enough or aligned_ms is not None and abs(length - aligned_ms) > NASAL_FRAME_MS
    return {
        "start_ms": run[0] * NASAL_FRAME_MS, "acoustic_ms": length, "peak_nasality": float(inside.max()), "mean_nasality": float(inside.mean()),
        "found": bool(long_enough), "corrected": bool(corrected),
    }


def nasal_span_ms(x: np.ndarray, rate: int = RATE) -> float | None:
    """Length of the nasal stretch in milliseconds; None where none is long enough."""
    got = nasal_stretch(x, rate)
    return got["acoustic_ms"] if got and got["found"] else None


#: Fixed values of the echo test: frame, tail after the sound, quiet window, search window after the
#: release, rise of a release, closure that is none, peak and sustain over the baseline.
ECHO_FRAME_MS, ECHO_TAIL_MS, ECHO_QUIET_MS = 5.0, 100.0, 20.0
ECHO_SEARCH_MS, ECHO_RISE, ECHO_NO_CLOSURE, ECHO_PEAK, ECHO_SUSTAIN = (20.0, 80.0), 2.0, 0.5, 1.5, 1.2


def echo(x: np.ndarray, rate: int = RATE, length_ms: float | None = None, closure_ms: float | None = None) -> dict | None:
    """Echo of a stop: closure, release, and the peak in the search window after the release.

    ``x`` is the sound and its tail; ``length_ms`` the sound's own length (all but the tail), and
    ``closure_ms`` the end of its closure (half of it). The baseline is the quietest window of the
    closure. ``skip`` says why nothing can be measured; None: fewer than four frames.
    """
    level = rms(x, int(rate * ECHO_FRAME_MS / 1000))
    n = len(level)
    if n < 4:
        return None
    own = max(2, int((len(x) / rate * 1000 - ECHO_TAIL_MS if length_ms is None else length_ms) / ECHO_FRAME_MS))
    own = min(own, n)
    closure = own // 2 if closure_ms is None else min(int(closure_ms / ECHO_FRAME_MS), own)
    closure = max(1, closure)
    quiet = min(int(ECHO_QUIET_MS / ECHO_FRAME_MS), closure)
    base = float(np.convolve(level[:closure], np.ones(quiet) / quiet, "valid").min())
    top = float(level.max())
    out = {"baseline": base, "peak_ratio": top / base, "sustain_ms": 0.0, "release_ms": 0.0, "skip": None}
    high = level > ECHO_RISE * base
    rises = np.flatnonzero(high[closure:-1] & high[closure + 1 :])
    if base >= ECHO_NO_CLOSURE * top or not len(rises):
        return out | {"skip": "no_closure_detected"}
    release = closure + int(rises[0])
    out["release_ms"] = release * ECHO_FRAME_MS
    low, up = (release + int(ms / ECHO_FRAME_MS) for ms in ECHO_SEARCH_MS)
    if low >= n:
        return out | {"skip": "echo_window_overflow"}
    peak = low + int(level[low : min(up, n)].argmax())
    # the stretch around the peak that stays above the sustain level, back to the release at most
    lower = np.flatnonzero(level <= ECHO_SUSTAIN * base)
    left = max([release, *(lower[lower < peak] + 1)])
    right = min([n - 1, *(lower[lower > peak] - 1)])
    return out | {"peak_ratio": float(level[peak]) / base, "sustain_ms": float((right - left + 1) * ECHO_FRAME_MS)}


def voice_activity(x: np.ndarray, rate: int = RATE, frame_ms: int = 30, share: float = 0.1, floor: float = 1e-4) -> list[tuple[int, int]]:
    """(start_ms, end_ms) of speech: frames whose level exceeds ``share`` of the loudest frame's (and
    a floor). An energy test in place of a trained detector, so results are defined here."""
    level = rms(x, int(rate * frame_ms / 1000))
    if not len(level):
        return []
    on = level > max(share * float(level.max()), floor)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8))).reshape(-1, 2)
    end = len(x) * 1000 // rate
    return [(int(a * frame_ms), end if b == len(on) else int(b * frame_ms)) for a, b in edges]


#: A pause that may hide a restart, and loudness that a fresh start keeps to.
RESTART_PAUSE_MS, RESTART_RATIO, RESTART_SLACK_MS = 2000, (0.2, 5.0), 50
#: Correlation above which a segment repeats its predecessor, and the least length of a segment.
REPEAT_CORR, REPEAT_LEAST = 0.85, 160


def _part(x: np.ndarray, rate: int, span: tuple[int, int]) -> np.ndarray:
    return x[int(span[0] * rate / 1000) : int(span[1] * rate / 1000)]


def restart_ms(x: np.ndarray, rate: int = RATE) -> int | None:
    """Where the last attempt begins: the speech after the last long pause, if it is about as loud as the opening."""
    speech = voice_activity(x, rate)
    pauses = [b[0] for a, b in zip(speech, speech[1:]) if b[0] - a[1] >= RESTART_PAUSE_MS]
    end = len(x) * 1000 // rate
    tail = [end] if speech and end - speech[-1][1] >= RESTART_PAUSE_MS else []
    if len(speech) < 2 or not [*pauses, *tail]:
        return None
    after = [s for s in speech if s[0] >= [*pauses, *tail][-1] - RESTART_SLACK_MS]
    loud = lambda s: float(np.sqrt((_part(x, rate, s).astype(np.float64) ** 2).mean()))
    first = max(loud(speech[0]), 1e-10)
    return next((s[0] for s in after if RESTART_RATIO[0] < loud(s) / first < RESTART_RATIO[1]), None)


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Pearson's; 0 where it is not defined."""
    if len(a) < 2 or len(b) < 2 or a.std() < 1e-10 or b.std() < 1e-10:
        return 0.0
    return float(np.corrcoef(a, b)[0, 1])


def repetitions(x: np.ndarray, rate: int = RATE, above: float = REPEAT_CORR) -> list[tuple[int, int]]:
    """Speech that the next speech repeats: neighbours of at most twofold length whose levels, at the
    shorter one's resolution, correlate above ``above``."""
    speech, out = voice_activity(x, rate), []
    for one, two in zip(speech, speech[1:]):
        parts = [_part(x, rate, s) for s in (one, two)]
        if min(map(len, parts)) < REPEAT_LEAST:
            continue
        levels = [np.sqrt(np.maximum(rms(p, int(rate * 0.02)) ** 2 - 1e-12, 0)) for p in parts]
        n = min(map(len, levels))
        if n and max(map(len, levels)) <= 2 * n:
            grid = np.linspace(0, 1, n)
            same = [np.interp(grid, np.linspace(0, 1, len(v)), v) for v in levels]
            if correlation(*same) > above:
                out.append(one)
    return out


def dual_silences(x: np.ndarray, rate: int = RATE, least_frames: int = 10, share: float = 0.05, expected: int | None = None, frame_ms: int = 30) -> list[int]:
    """Middles (ms) of stretches of at least ``least_frames`` frames that are neither speech nor above
    ``share`` of the loudest level, away from the edges; the longest ``expected`` of them, in order of time."""
    level = rms(x, int(rate * frame_ms / 1000))
    if not len(level) or level.max() < 1e-10:
        return []
    speech = np.zeros(len(level), bool)
    for a, b in voice_activity(x, rate, frame_ms):
        speech[a // frame_ms : -(-b // frame_ms)] = True
    quiet = ~speech & (level < share * level.max())
    runs = np.flatnonzero(np.diff(np.concatenate([[False], quiet, [False]]).astype(np.int8))).reshape(-1, 2)
    total = len(level) * frame_ms
    margin = max(200, int(total * 0.01))
    found = [(int((a + b) / 2 * frame_ms), b - a) for a, b in runs if b - a >= least_frames]
    found = [f for f in found if margin < f[0] < total - margin]
    if expected is not None:
        found = sorted(found, key=lambda f: -f[1])[:expected]
    return sorted(f[0] for f in found)


def cut_wav(content: bytes, start_ms: float, end_ms: float, padding_ms: float = 0.0) -> bytes:
    """A 16-bit mono file of a time range, with silence before and after it."""
    return cut_wavs(content, [(start_ms, end_ms)], padding_ms)[0]


def cut_wavs(content: bytes, spans: list[tuple[float, float]], padding_ms: float = 0.0) -> list[bytes]:
    """The same of many time ranges of a recording, which is decoded once."""
    x, rate = decode_wav(content)
    pad = np.zeros(int(rate * padding_ms / 1000), np.float32)
    files = []
    for start_ms, end_ms in spans:
        part = _part(x, rate, (int(max(0, start_ms)), int(end_ms)))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
            w.writeframes((np.concatenate([pad, part, pad]) * 32768).clip(-32768, 32767).astype(np.int16).tobytes())
        files.append(out.getvalue())
    return files


def pitch(x: np.ndarray, rate: int = RATE, low: float = 60.0, high: float = 400.0) -> tuple[float, float, float]:
    """(mean Hz, standard deviation, voiced share) by autocorrelation of 40 ms frames."""
    size = int(rate * 0.04)
    found = []
    f = frames(x, size, size // 2).astype(np.float64)
    for row in f:
        row = row - row.mean()
        energy = (row * row).sum()
        if energy < 1e-6:
            continue
        corr = np.correlate(row, row, "full")[size - 1 :] / energy
        a, b = int(rate / high), min(int(rate / low), size - 1)
        lag = a + int(corr[a:b].argmax())
        if corr[lag] > 0.3:
            found.append(rate / lag)
    if not found:
        return 0.0, 0.0, 0.0
    return float(np.mean(found)), float(np.std(found)), len(found) / max(1, len(f))


def linear_prediction(x: np.ndarray, order: int) -> np.ndarray:
    """Burg's coefficients a[0] = 1, ..., a[order] of the prediction error filter."""
    f, b, a = x[1:].astype(np.float64), x[:-1].astype(np.float64), np.ones(1)
    for _ in range(order):
        power = (f * f).sum() + (b * b).sum()
        k = -2.0 * (f * b).sum() / power if power > 0 else 0.0
        a = np.append(a, 0.0) + k * np.append(a, 0.0)[::-1]
        f, b = (f + k * b)[1:], (b + k * f)[:-1]
    return a


def formants(x: np.ndarray, rate: int = RATE, ceiling: float = 5500.0, n: int = 5) -> list[float]:
    """Resonances in Hz below ``ceiling`` of the middle 50 ms, lowest first, from the roots of the filter."""
    size = min(len(x), int(rate * 0.05))
    at = (len(x) - size) // 2
    part = x[at : at + size].astype(np.float64)
    part = np.append(part[0], part[1:] - 0.97 * part[:-1]) * np.hanning(size) if size > 2 * n + 2 else part
    if size <= 2 * n + 2 or not part.any():
        return []
    roots = np.roots(linear_prediction(part, 2 * n))
    roots = roots[np.imag(roots) > 0]
    hz, width = np.angle(roots) * rate / (2 * np.pi), -np.log(np.abs(roots)) * rate / np.pi
    return sorted(float(f) for f, w in zip(hz, width) if 90 < f < ceiling - 50 and w < 700)


def content(row: dict) -> bytes:
    """A recording's bytes from its row."""
    return row["content"]


def spread(df):
    """Rows of a recording together, recordings dealt over all cores. Rows of few bytes take long here, so their
    number of tasks is not left to their bytes, by which Spark would put them all into one."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, "file_id")


def over_files(files, rows, schema: str, read=content):
    """Rows that ``rows(row, samples, rate)`` gives of each recording, which is there only while it is measured."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                out += rows(row, *decode_wav(read(row)))
            columns = zip(*out) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], names=kinds.names)

    return files.mapInArrow(run, schema)


def with_segments(segments, files, columns: list[str]):
    """A row for each recording that has segments: file_id, ``segments`` (an array of ``columns``), ``file`` (the
    first row of the recording, null where it is absent).

    Segments and files are dealt together and once, so no join can gather all of them in one place.
    """
    from pyspark.sql import functions as F

    parts = segments.select("file_id", F.struct(*columns).alias("segment"))
    whole = files.select("file_id", F.struct(*files.columns).alias("file"))
    both = spread(parts.unionByName(whole, allowMissingColumns=True))
    found = both.groupBy("file_id").agg(F.collect_list("segment").alias("segments"), F.first("file", ignorenulls=True).alias("file"))
    return found.where(F.size("segments") > 0)


def measure(segments, files, kernel, schema: str, read=content):
    """segments(file_id, start_ms, end_ms, ...) and files(file_id, content) -> kernel columns by segment.

    ``kernel(samples, rate) -> dict`` runs on each segment; a recording is decoded once.
    A segment of an absent or too short recording has null measures. ``read`` makes a recording's
    bytes from a row of ``files`` (a dict); where it makes them from little, little is moved.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names = segments.columns
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    full = StructType([*segments.schema.fields, *StructType.fromDDL(schema).fields])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                file, part = batch.column("file")[k].as_py(), batch.column("segments").slice(k, 1).flatten()
                samples, rate = (None, RATE) if file is None else decode_wav(read(file))
                rows = []
                for a, b in zip(part.field("start_ms").to_pylist(), part.field("end_ms").to_pylist()):
                    x = None if samples is None else segment(samples, rate, a, b)
                    rows.append((kernel(x, rate) if x is not None else None) or {})
                made = [pa.array([r.get(f.name) for r in rows], f.type) for f in kinds]
                yield pa.RecordBatch.from_arrays([*(part.field(c) for c in names), *made], names=[*names, *kinds.names])

    return with_segments(segments, files, names).mapInArrow(run, full)
