"""Files written by the transactional sink and read by the library's formats, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import formats, textgrid
from .format_queries import _TURNS, _tiers
from .recording_queries import FRAME, SQL_PIECES, _files
from .tables import scratch


def _written(spark, d, name: str, rows) -> str:
    """A folder of the shared directory with a file for each row."""
    formats.register(spark)
    path = scratch(spark, name)
    rows.write.format("named_files").mode("append").save(path)
    return path


def textgrid_files(spark, d):
    """All conversations as TextGrid files; the spoken words among their tiers, by a pruned read."""
    texts = textgrid.textgrid_text(_tiers(spark, d))
    path = _written(spark, d, "textgrids", texts.select(F.concat("file_id", F.lit(".TextGrid")).alias("name"), "value"))
    words = spark.read.format("intervals").option("split", 1 << 20).load(path).where("tier = 'words' AND text <> ''")
    return words.select("file_id", F.col("idx").cast("bigint").alias("idx"), "xmin", "xmax", F.md5("text").alias("digest"))


def recording_frames(spark, d):
    """Recordings made of events as packed WAV files, read by byte ranges: which of ten levels each frame has; null: none."""
    files = _files(spark, d, formats.packed).select(F.concat("file_id", F.lit(".wav.zst")).alias("name"), F.col("content").alias("value"))
    path = _written(spark, d, "recordings", files)
    f = spark.read.format("recordings").option("frame_ms", FRAME).option("split", 1 << 16).load(path)
    level = F.sqrt(F.col("sum_squares") / F.col("n") * 2) / 32767
    return f.select("file_id", "frame", F.when(F.col("peak") > 0, F.round((level - 0.2) / 0.07)).cast("bigint").alias("level"))


QUERIES = {f.__name__: f for f in (textgrid_files, recording_frames)}

ORACLES = {
    "textgrid_files": f"SELECT file_id, turn AS idx, CAST(turn AS DOUBLE) AS xmin, turn + 1.0::DOUBLE AS xmax, md5(text) AS digest FROM ({_TURNS}) WHERE text <> ''",
    "recording_frames": f"SELECT file_id, first + k AS frame, CASE WHEN NOT quiet THEN event_id % 10 END AS level FROM ({SQL_PIECES}), unnest(range(0, frames)) AS t(k)",
}
