"""Small helpers that the corpus operators share."""

from __future__ import annotations

import gc
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

#: Rows and bytes in an Arrow batch at most. Texts may hold 100 kB and more, so a batch
#: of Spark's default 10,000 rows could fill a Python worker.
BATCH_ROWS = 2000
BATCH_BYTES = "16m"

#: ASCII A-Z to a-z, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of this session small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a folder under the warehouse is set as the checkpoint
    folder on one machine; a cluster must name one, as its machines share no other.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, settle: float = 0.0) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    Spark removes the shuffle files of a finished job when nothing refers to its plan any more,
    which it learns from garbage collection alone; so the driver's references go at once and
    the files do not pile up from step to step. The events of the job refer to its plan until
    Spark's listeners have seen them: after a large shuffle, ``settle`` seconds are waited and
    the rest is collected then, otherwise at the next cut.
    """
    session = df.sparkSession
    shared_dir(session)
    out = df.checkpoint(eager=True)
    del df
    for pause in (0.0, settle) if settle else (0.0,):
        time.sleep(pause)
        gc.collect()
        session.sparkContext._jvm.System.gc()
    return out


#: Key tables of at most this many rows are broadcast (16 MB of keys), larger ones are shuffled.
BROADCAST_KEYS = 1_000_000


def with_keys(df: DataFrame, on: str, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose ``on`` is (``left_semi``) or is not (``left_anti``) in the one column of ``keys``.

    The keys are counted: where they are few, the wide rows of ``df`` need no shuffle.
    """
    keys = keys.toDF("_key").distinct()
    if keys.count() <= BROADCAST_KEYS:
        keys = broadcast(keys)
    return df.join(keys, df[on] == keys["_key"], how)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table written between two jobs."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def give_back() -> None:
    """Return freed memory of this Python worker to the system.

    Spark keeps workers for later tasks; what they have freed would stay with them and
    count against their executor.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run):
    """An iterator function for mapInArrow or mapInPandas that gives memory back at its end."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def words(data: bytes) -> list[bytes]:
    """Maximal runs without ASCII white space, A-Z in lower case."""
    return data.translate(LOWER).split()


def pack(a: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    import pyarrow as pa

    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
    return len(planes).to_bytes(8, "little") + (pa.Codec("zstd", 1).compress(planes, asbytes=True) if planes else b"")


def unpack(data: bytes, kind) -> np.ndarray:
    import pyarrow as pa

    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[8:], n, asbytes=True), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()
