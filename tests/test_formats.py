"""Formats: planning, pruning, ranges and long texts of the readers; commit and abort of the writer."""

import io
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from seqloom.plans import storage_queries
from seqloom.sources import formats, textgrid

ODD = 'say ""hi"" to\n  them \n"' + "x" * 50


@pytest.fixture
def grids(spark, tmp_path):
    formats.register(spark)
    rows = [(f"v{k}", t, i, float(i), i + 0.5, ODD if i == 1 else "" if i == 2 else f"{t}{i} {k}") for k in range(12) for t in ("words", "phones") for i in range(4)]
    df = spark.createDataFrame(rows, "file_id string, tier string, idx int, xmin double, xmax double, text string")
    texts = textgrid.textgrid_text(df).select(F.concat(F.lit("deep/"), "file_id", F.lit(".TextGrid")).alias("name"), "value")
    texts.write.format("named_files").mode("append").save(str(tmp_path / "g"))
    return df, str(tmp_path / "g")


def files(path):
    return sorted(os.path.join(f, x) for f, _, names in os.walk(path) for x in names)


def test_what_was_written_is_read(spark, grids):
    df, path = grids
    got = spark.read.format("intervals").load(path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    assert sum(x.endswith("_SUCCESS") for x in files(path)) == 1 and not any("_temporary/" in x for x in files(path))
    assert got.where("file_id IN ('v3', 'v4') AND tier = 'phones' AND idx < 3").count() == 6
    assert got.where("file_id = 'nobody'").count() == 0


def test_files_are_pruned_before_tasks_exist(spark, grids):
    reader = formats.IntervalReader(grids[1], 1)
    assert len(reader.partitions()) == 12
    assert list(reader.pushFilters([In(("file_id",), ("v1", "v2", "none")), EqualTo(("tier",), "words"), GreaterThan(("idx",), 1)])) == [GreaterThan(("idx",), 1)]
    assert [os.path.basename(p) for x in reader.partitions() for p, _, _ in x.pieces] == ["v1.TextGrid", "v2.TextGrid"]
    assert {r for b in map(reader.read, reader.partitions()) for x in b for r in x.column("tier").to_pylist()} == {"words"}
    assert len(formats.IntervalReader(grids[1], 1 << 30).partitions()) == 1


def test_wide_and_point_tiers(spark, tmp_path):
    formats.register(spark)
    text = 'File type = "ooTextFile"\n\nxmin = 0\nxmax = 2\nitem []:\n    item [1]:\n        class = "TextTier"\n        name = "points"\n        points [1]:\n            number = 1\n            mark = "p"\n'
    text += '    item [2]:\n        class = "IntervalTier"\n        name = "الكلمات"\n        xmin = 0\n        intervals [1]:\n            xmin = 0 \n            xmax = 1.5 \n            text = "a ""b""" \n'
    for name, code in (("a", "utf-8"), ("b", "utf-8-sig"), ("c", "utf-16")):
        (tmp_path / f"{name}.TextGrid").write_bytes(text.replace("\n", "\r\n").encode(code))
    (tmp_path / "empty.TextGrid").write_bytes(b"")
    (tmp_path / "_left.TextGrid").write_bytes(text.encode())
    got = [tuple(r) for r in spark.read.format("intervals").load(str(tmp_path)).collect()]
    assert sorted(got) == [(n, "الكلمات", 0, 0.0, 1.5, 'a "b"') for n in "abc"]


def recording(samples, channels=1, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes(np.repeat(samples, channels).astype("<i2").tobytes())
    return out.getvalue()


@pytest.mark.parametrize("split", [1, 100, 333, 5000, 1 << 20])
@pytest.mark.parametrize("channels", [1, 2])
def test_ranges_of_a_recording_hold_each_frame_once(tmp_path, split, channels):
    x = np.random.default_rng(1).integers(-32768, 32768, 1234)
    (tmp_path / "r.wav").write_bytes(recording(x, channels))
    (tmp_path / "none.wav").write_bytes(recording(x[:0], channels))
    reader = formats.RecordingReader(str(tmp_path), split, 10)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    want = [x[k : k + 80].astype(np.int64) for k in range(0, len(x), 80)]
    assert [(r["frame"], r["n"], r["sum_squares"], r["peak"]) for r in rows] == [(k, len(p), int((p * p).sum()), int(np.abs(p).max())) for k, p in enumerate(want)]
    reader = formats.RecordingReader(str(tmp_path), split, 10)
    assert not list(reader.pushFilters([GreaterThan(("frame",), 2), LessThanOrEqual(("frame",), 9)]))
    assert [k for p in reader.partitions() for b in reader.read(p) for k in b.column("frame").to_pylist()] == list(range(3, 10))


def test_frames_by_spark(spark, tmp_path):
    formats.register(spark)
    for k in range(3):
        (tmp_path / f"r{k}.wav").write_bytes(recording(np.full(4000, 100 * k)))
    got = spark.read.format("recordings").option("split", 1000).load(str(tmp_path))
    assert got.count() == 150 and {tuple(r) for r in got.where("frame >= 49 AND file_id <> 'r0'").select("file_id", "frame", "peak").collect()} == {("r1", 49, 100), ("r2", 49, 200)}


def test_a_failed_job_leaves_nothing(spark, grids):
    _, path = grids
    before = files(path)
    bad = spark.range(0, 400, 1, 4).select(F.when(F.col("id") == 399, "../up").otherwise(F.col("id").cast("string")).alias("name"), F.lit("x").alias("value"))
    with pytest.raises(Exception, match="not a name"):
        bad.write.format("named_files").mode("overwrite").save(path)
    twice = spark.range(0, 2, 1, 1).select(F.lit("same").alias("name"), F.lit("x").alias("value"))
    with pytest.raises(Exception, match="written twice"):
        twice.write.format("named_files").mode("append").save(path)
    assert files(path) == before
    assert not os.path.exists(os.path.join(path, "_temporary")) or not os.listdir(os.path.join(path, "_temporary"))


def test_append_overwrite_empty_and_binary(spark, tmp_path):
    formats.register(spark)
    path = str(tmp_path / "o")
    rows = spark.createDataFrame([("a", bytearray(b"\x00\xff")), ("b/c", None)], "name string, value binary")
    rows.write.format("named_files").mode("append").save(path)
    rows.limit(0).write.format("named_files").mode("append").save(path)
    named = lambda: {x.split("/part-")[1].split("/", 1)[1]: open(x, "rb").read() for x in files(path) if "/part-" in x}
    assert named() == {"a": b"\x00\xff", "b/c": b""}
    spark.createDataFrame([("d", "é")], "name string, value string").write.format("named_files").mode("overwrite").save(path)
    assert named() == {"d": "é".encode()}
    with pytest.raises(Exception, match="are needed"):
        spark.range(1).write.format("named_files").mode("append").save(path)


def test_partitions_do_not_grow_with_small_pieces(tmp_path, monkeypatch):
    monkeypatch.setattr(formats, "TASKS", 4)
    for k in range(40):
        (tmp_path / f"{k:02d}.wav").write_bytes(b"x" * 1000)
    parts = formats.plan(str(tmp_path), ".wav", None, 100, cut=True)
    pieces = [p for x in parts for p in x.pieces]
    assert len(parts) <= 5 and len(pieces) == 400 and all(b - a == 100 for _, a, b in pieces)
    assert sorted({p for p, _, _ in pieces}) == sorted(str(tmp_path / f"{k:02d}.wav") for k in range(40))


@pytest.mark.parametrize("split", [1, 100, 333, 5000, 1 << 20])
@pytest.mark.parametrize("block", [7, 300, 1 << 16])
def test_packed_recordings_are_read_by_ranges(tmp_path, split, block):
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    x = np.random.default_rng(1).integers(-32768, 32768, 1234)
    for name, samples in (("r.1", x), ("none", x[:0])):
        (tmp_path / "a" / f"{name}.wav").write_bytes(recording(samples, 2))
        (tmp_path / "b" / f"{name}.wav.zst").write_bytes(formats.packed(recording(samples, 2), block))
    rows = lambda reader: [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    plain, packed = (formats.RecordingReader(str(tmp_path / f), split, 10) for f in "ab")
    assert rows(packed) == rows(plain) and {r["file_id"] for r in rows(packed)} == {"r.1"}
    assert split > 100 or len([p for x in packed.partitions() for p in x.pieces]) > 10
    for reader in (plain, packed):
        assert not list(reader.pushFilters([EqualTo(("file_id",), "r.1"), GreaterThan(("frame",), 2), LessThanOrEqual(("frame",), 9)]))
    assert rows(packed) == rows(plain) and len(rows(packed)) == 7


def test_packed_files_are_plain_zstd(tmp_path):
    import pyarrow as pa

    for data in (b"", b"x", os.urandom(1000) + bytes(300_000)):
        path = tmp_path / f"{len(data)}.zst"
        path.write_bytes(formats.packed(data))
        with open(path, "rb") as f:
            file = io.BufferedReader(formats.Unpacked(f))
            assert file.read() == data and file.seek(-len(data) // 2, io.SEEK_END) + len(file.read()) == len(data)
        if data:
            assert pa.input_stream(str(path), compression="zstd").read() == data
    (tmp_path / "x").write_bytes(b"RIFF")
    with open(tmp_path / "x", "rb") as f, pytest.raises(ValueError, match="seekable"):
        formats.Unpacked(f)


def test_recordings_of_events_take_a_tenth_of_their_sound(spark, tmp_path, monkeypatch):
    rows = [(k, k % 3, "error" if k % 5 == 0 else "view", 1.0) for k in range(300)]
    e = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.col("event_id")))
    e.write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(storage_queries, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    frames = storage_queries.recording_frames(spark, str(tmp_path)).count()
    stored = [x for x in files(f"{tmp_path}/recordings") if "/part-" in x]
    assert len(stored) == 15 and frames == sum(12 + k % 3 * 30 if k % 5 == 0 else 2 + k % 4 for k in range(300))
    assert sum(map(os.path.getsize, stored)) < frames * 480 * 2 / 10


def test_endings_do_not_change_what_is_written(spark, tmp_path):
    formats.register(spark)
    rows = spark.createDataFrame([("a.gz", bytearray(b"x")), ("b.wav.zst", bytearray(b"y"))], "name string, value binary")
    rows.write.format("named_files").mode("append").save(str(tmp_path / "o"))
    assert [open(x, "rb").read() for x in files(tmp_path / "o") if "/part-" in x] in ([b"x", b"y"], [b"y", b"x"])
