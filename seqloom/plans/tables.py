"""Driver tables as sequences, and the SQL pieces that match them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import context

#: Sequences of events: one per user, in order of time.
KEY, ORDER = ["user_id"], ["ts", "event_id"]
W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the directory that driver and executors share: that of checkpoints, or the warehouse where none is named."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def micros(column: str = "ts") -> Column:
    """Microseconds since the start of 2024, for a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


SQL_MICROS = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00'))"


def positions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Events with their 0-based place in the user's sequence."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value", *columns)
    return context.with_position(e, KEY, ORDER)


SQL_POS = f"SELECT user_id, ts, event_id, event_type, value, row_number() {W} - 1 AS pos FROM events"
