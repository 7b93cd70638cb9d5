"""Formats for ``spark.read.format(...)`` and ``df.write.format(...)``: files of intervals, recordings, and named files.

``register(spark)`` makes them known:

- ``intervals`` reads TextGrid files (a folder, searched to any depth, or one file): file_id, tier, idx, xmin, xmax, text.
- ``recordings`` reads 16-bit WAV files by frames: file_id, frame, rate, n, sum_squares, peak, of the first channel.
  Option ``frame_ms`` (10) is a frame's length; a shorter rest is a frame of its own. Files ``.wav.zst`` hold the same bytes
  in zstd's seekable format, as ``packed`` makes it.
- ``named_files`` writes a file for each row (name, value: text or binary; null is an empty file).

Readers plan by the sizes of files alone: small files share a partition, and a recording is cut
into byte ranges, of ``split`` bytes (32 MB) both, of packed ones as they are stored, a block belonging to the range in
which it begins; where that makes more than ``TASKS`` partitions, pieces share one, up to 32 MB. Conditions on ``file_id`` prune files before a task
exists; those on ``tier`` and ``frame`` limit what a task decodes. Interval files are read line by
line, recordings a few frames at a time, so a file of any length takes little memory.

Tasks fill folders of their own under ``_temporary``, and the commit renames one folder a task and
then writes ``_SUCCESS``; a failed job, or a second attempt of a task, leaves nothing that a reader
sees. A driver that is lost during the renames leaves some of them done: a fresh folder is whole
once it has ``_SUCCESS``. Readers pass over names that begin with ``_`` or ``.``. The file system must be
able to rename a folder. Names are unique within a job by the caller; a second one in one
task is an error, as is an empty, absolute or climbing (``..``) name.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
import wave
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

SPLIT = 32 << 20
#: Partitions that a reader makes before they get larger than ``split``, up to ``SPLIT``.
TASKS = 256
#: Rows of a batch, and frames decoded at once.
ROWS, FRAMES = 8192, 4096
#: Bytes of a block of a packed file; fixed values of zstd's seekable format: its table's number, the number at its end, and the bit of checksums.
BLOCK, SKIPPED, SEEKABLE, CHECKED = 1 << 16, 0x184D2A5E, 0x8F92EAB1, 0x80


def storage(path: str):
    """File system and path within it of a path or address."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def stem(path: str) -> str:
    """A file's name without folders and ending, also that of a packed file."""
    return re.sub(r"(?i)\.[^.]*(\.zst)?$", "", path.rsplit("/", 1)[-1])


def packed(data: bytes, block: int = BLOCK) -> bytes:
    """The bytes in zstd's seekable format: blocks that are read each by itself, and a table of their lengths; any zstd tool unpacks it."""
    import pyarrow as pa

    blocks = [data[k : k + block] for k in range(0, len(data), block)]
    stored = [pa.compress(b, "zstd", asbytes=True) for b in blocks]
    table = b"".join(struct.pack("<II", len(s), len(b)) for s, b in zip(stored, blocks)) + struct.pack("<IBI", len(blocks), 0, SEEKABLE)
    return b"".join([*stored, struct.pack("<II", SKIPPED, len(table)), table])


class Unpacked(io.RawIOBase):
    """What a packed file holds; one block at a time is in memory."""

    def __init__(self, file):
        self.file, self.place, self.block = file, 0, (-1, b"")
        end = file.seek(0, io.SEEK_END) - 9
        file.seek(max(end, 0))
        n, flags, kind = struct.unpack("<IBI", file.read(9)) if end >= 0 else (0, 0, 0)
        if kind != SEEKABLE:
            raise ValueError("not in zstd's seekable format")
        width = 12 if flags & CHECKED else 8
        file.seek(end - n * width)
        lengths = np.frombuffer(file.read(n * width), "<u4").reshape(n, width // 4)
        #: where each block begins in the file and in what it holds, and where the last one ends
        self.stored, self.starts = (np.concatenate([[0], np.cumsum(lengths[:, k], dtype=np.int64)]) for k in (0, 1))

    def held(self, a: int, b: int) -> tuple[int, int]:
        """First byte and byte after the last of what the blocks hold that begin in these bytes of the file."""
        return tuple(int(self.starts[np.searchsorted(self.stored[:-1], x)]) for x in (a, b))

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.place = offset + (0, self.place, int(self.starts[-1]))[whence]
        return self.place

    def readinto(self, target) -> int:
        import pyarrow as pa

        k = int(np.searchsorted(self.starts, self.place, "right")) - 1
        if k == len(self.starts) - 1:
            return 0
        if k != self.block[0]:
            self.file.seek(int(self.stored[k]))
            stored = self.file.read(int(self.stored[k + 1] - self.stored[k]))
            self.block = k, pa.decompress(stored, int(self.starts[k + 1] - self.starts[k]), "zstd", asbytes=True)
        part = self.block[1][self.place - int(self.starts[k]) :][: len(target)]
        target[: len(part)] = part
        self.place += len(part)
        return len(part)


@dataclass
class Pieces(InputPartition):
    """What one task reads: (path, first byte, byte after the last) of each piece."""

    pieces: list[tuple[str, int, int]]


def plan(path: str, ending: str | tuple[str, ...], names: set[str] | None, split: int, cut: bool) -> list[Pieces]:
    """Pieces of all files with the ending, packed into partitions of ``split`` bytes, more where they would be many; ``cut``: files may be cut into ranges."""
    from pyarrow import fs

    system, root = storage(path)
    if system.get_file_info(root).type == fs.FileType.File:
        files = [system.get_file_info(root)]
    else:
        hidden = re.compile(r"/[_.]")
        files = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File and not hidden.search(f.path[len(root) :])]
    files = [f for f in files if f.path.lower().endswith(ending) and (names is None or stem(f.path) in names)]
    most = max(split, min(SPLIT, sum(f.size for f in files) // TASKS))
    out: list[Pieces] = []
    room = 0
    for f in sorted(files, key=lambda f: f.path):
        for a in range(0, max(f.size, 1), split if cut else max(f.size, 1)):
            b = min(a + split, f.size) if cut else f.size
            if not out or b - a > room:
                out.append(Pieces([]))
                room = most
            out[-1].pieces.append((f.path, a, b))
            room -= b - a
    return out


def chosen(filters: Iterable[Filter], column: str) -> tuple[set | None, list[Filter]]:
    """Values of a column that equality conditions leave (None: any), and the other conditions."""
    values, rest = None, []
    for f in filters:
        if isinstance(f, (EqualTo, In)) and f.attribute == (column,):
            one = {f.value} if isinstance(f, EqualTo) else set(f.value)
            values = one if values is None else values & one
        else:
            rest.append(f)
    return values, rest


def quoted(value: str) -> str | None:
    """The text of a complete quoted value, a doubled quote standing for one; None while it goes on."""
    body = value[1:].rstrip()
    return body[:-1].replace('""', '"') if body.replace('""', "").endswith('"') else None


def read_intervals(lines: Iterable[str], tiers: set[str] | None = None) -> Iterator[tuple]:
    """(tier, idx, xmin, xmax, text) of the lines of a TextGrid file in its long form, of the wanted tiers."""
    tier, idx, low, high = None, -1, None, None
    key, value = "", None
    for line in lines:
        if value is not None:
            value += line
        else:
            key, _, rest = line.lstrip().partition(" = ")
            if key.startswith("item ["):
                tier, idx = None, -1
            elif key.startswith("intervals ["):
                idx += 1
            elif key == "xmin":
                low = float(rest)
            elif key == "xmax":
                high = float(rest)
            elif rest.startswith('"'):
                value = rest
        if value is not None and (text := quoted(value)) is not None:
            value = None
            if key == "name":
                tier = text
            elif key == "text" and (tiers is None or tier in tiers):
                yield tier, idx, low, high, text


class IntervalReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split, self.names, self.tiers = path, split, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.names, rest = chosen(filters, "file_id")
        self.tiers, rest = chosen(rest, "tier")
        return rest

    def partitions(self) -> list[Pieces]:
        return plan(self.path, ".textgrid", self.names, self.split, cut=False)

    def read(self, partition: Pieces):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string()]
        names = ["file_id", "tier", "idx", "xmin", "xmax", "text"]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        system, _ = storage(self.path)
        rows: list[tuple] = []
        for path, _, _ in partition.pieces if partition else ():  # Spark gives None where the plan is empty
            with system.open_input_file(path) as file:
                wide = file.read(2) in (b"\xff\xfe", b"\xfe\xff")
                file.seek(0)
                for row in read_intervals(io.TextIOWrapper(file, "utf-16" if wide else "utf-8-sig", newline="\n"), self.tiers):
                    rows.append((stem(path), *row))
                    if len(rows) == ROWS:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)


class Intervals(DataSource):
    @classmethod
    def name(cls) -> str:
        return "intervals"

    def schema(self) -> str:
        return "file_id string, tier string, idx int, xmin double, xmax double, text string"

    def reader(self, schema) -> IntervalReader:
        return IntervalReader(self.options["path"], int(self.options.get("split", SPLIT)))


class RecordingReader(DataSourceReader):
    def __init__(self, path: str, split: int, frame_ms: int):
        self.path, self.split, self.frame_ms = path, split, frame_ms
        self.names, self.first, self.last = None, 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        self.names, rest = chosen(filters, "file_id")
        for f in rest:
            if getattr(f, "attribute", None) == ("frame",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    end = f.value + (not isinstance(f, LessThan))
                    self.last = end if self.last is None else min(self.last, end)
            else:
                yield f

    def partitions(self) -> list[Pieces]:
        return plan(self.path, (".wav", ".wav.zst"), self.names, self.split, cut=True)

    def read(self, partition: Pieces):
        import pyarrow as pa

        names = ["file_id", "frame", "rate", "n", "sum_squares", "peak"]
        system, _ = storage(self.path)
        for path, a, b in partition.pieces if partition else ():
            with system.open_input_file(path) as file:
                if path.lower().endswith(".zst"):
                    blocks = Unpacked(file)
                    a, b = blocks.held(a, b)
                    w = wave.open(io.BufferedReader(blocks, BLOCK))
                else:
                    w = wave.open(file)
                if w.getsampwidth() != 2:
                    raise ValueError(f"{path}: only 16-bit audio is read")
                size = max(1, w.getframerate() * self.frame_ms // 1000)
                step = size * 2 * w.getnchannels()
                # a frame belongs to the range in which it begins, counted from the first sample
                first, end = max(-(-a // step), self.first), min(-(-b // step), -(-w.getnframes() // size))
                end = end if self.last is None else min(end, self.last)
                for k in range(first, end, FRAMES):
                    w.setpos(k * size)
                    x = np.frombuffer(w.readframes(min(FRAMES, end - k) * size), "<i2")[:: w.getnchannels()].astype(np.int64)
                    at = np.arange(0, len(x), size)
                    n = np.diff(np.append(at, len(x)))
                    columns = [
                        pa.array([stem(path)] * len(at), pa.string()), pa.array(np.arange(k, k + len(at)), pa.int64()), pa.array(np.full(len(at), w.getframerate()), pa.int32()),
                        pa.array(n, pa.int32()), pa.array(np.add.reduceat(x * x, at), pa.int64()), pa.array(np.maximum.reduceat(np.abs(x), at), pa.int32()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=names)


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return "file_id string, frame bigint, rate int, n int, sum_squares bigint, peak int"

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(self.options["path"], int(self.options.get("split", SPLIT)), int(self.options.get("frame_ms", 10)))


@dataclass
class Filled(WriterCommitMessage):
    """The folder that a task filled; None if it had no rows."""

    folder: str | None


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _temporary(self, root: str) -> str:
        return f"{root}/_temporary/{self.job}"

    def write(self, batches) -> Filled:
        from pyarrow import fs

        system, root = storage(self.path)
        folder = f"{self._temporary(root)}/{uuid.uuid4().hex}"
        any_row, known = False, set()
        for batch in batches:
            for name, value in zip(batch.column("name").to_pylist(), batch.column("value").to_pylist()):
                if not name or name.startswith("/") or name.endswith("/") or ".." in name.split("/"):
                    raise ValueError(f"not a name of a file: {name!r}")
                target = f"{folder}/{name}"
                if system.get_file_info(target).type != fs.FileType.NotFound:
                    raise ValueError(f"written twice: {name!r}")
                if (parent := target.rsplit("/", 1)[0]) not in known:
                    system.create_dir(parent, recursive=True)
                    known.add(parent)
                with system.open_output_stream(target, compression=None) as out:  # not by the name's ending
                    out.write(value.encode() if isinstance(value, str) else value or b"")
                any_row = True
        return Filled(folder if any_row else None)

    def commit(self, messages: list[Filled | None]) -> None:
        from pyarrow import fs

        system, root = storage(self.path)
        system.create_dir(root, recursive=True)
        old = [f for f in system.get_file_info(fs.FileSelector(root)) if not f.base_name.startswith("_")]
        folders = [m.folder for m in messages if m is not None and m.folder]
        for k, folder in enumerate(folders):
            system.move(folder, f"{root}/part-{k:05d}-{self.job}")
        for f in old if self.overwrite else []:
            system.delete_file(f.path) if f.is_file else system.delete_dir(f.path)
        with system.open_output_stream(f"{root}/_SUCCESS"):
            pass
        self._clear(system, root)

    def abort(self, messages: list[Filled | None]) -> None:
        self._clear(*storage(self.path))

    def _clear(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(self._temporary(root)).type == fs.FileType.Directory:
            system.delete_dir(self._temporary(root))


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
        if kinds.get("name") != "string" or kinds.get("value") not in ("string", "binary"):
            raise ValueError("columns name (string) and value (string or binary) are needed")
        return FileWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, and let Spark hand conditions to readers written in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Intervals, Recordings, NamedFiles):
        spark.dataSource.register(source)
