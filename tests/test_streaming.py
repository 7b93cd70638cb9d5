"""Streaming forms against their batch meaning."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from seqloom.operators.rules import Rule
from seqloom.streaming import sessions

SCHEMA = "user_id int, ts timestamp, event_type string"
ROWS = [
    (1, "2024-01-01T00:00:00", "view"), (1, "2024-01-01T00:05:00", "buy"), (1, "2024-01-01T02:00:00", "view"), (2, "2024-01-01T00:01:00", "view"),
    (1, "2024-01-02T00:00:00", "view"), (2, "2024-01-02T12:00:00", "buy"),
]


def stream(spark, folder):
    rows = spark.createDataFrame(ROWS, "user_id int, ts string, event_type string").selectExpr("user_id", "CAST(ts AS timestamp) AS ts", "event_type")
    rows.coalesce(1).write.json(str(folder))
    return spark.readStream.schema(SCHEMA).json(str(folder))


def drain(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_sessions(spark, tmp_path):
    got = drain(sessions.sessions(stream(spark, tmp_path / "a"), "user_id", "ts"), "s1")
    found = {(r.user_id, r.n) for r in got.collect()}
    assert (1, 2) in found and (2, 1) in found


def test_windowed_counts(spark, tmp_path):
    got = drain(sessions.windowed_counts(stream(spark, tmp_path / "b"), "ts", "event_type", "1 day"), "s2", "complete")
    assert sum(r.n for r in got.collect()) == len(ROWS)


def test_rule_scan_carries_state(spark, tmp_path):
    rules = [Rule("view_then_buy", ("view",), priority=5, next=("buy",)), Rule("buy", ("buy",), prev=("view",))]
    got = drain(sessions.stateful_rule_scan(stream(spark, tmp_path / "c"), "user_id", "ts", "event_type", rules), "s3")
    assert sorted((r.user_id, r.event_type, r.rule) for r in got.collect()) == [(1, "buy", "buy"), (1, "view", "view_then_buy"), (2, "view", "view_then_buy")]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


TIMED = [Rule("last_view", ("view",), not_prev=("view",)), Rule("two", ("view", "click"), priority=5, next=("click", "view")), Rule("any", ("error", "purchase"))]


@pytest.mark.parametrize("wait", [timedelta(hours=30), timedelta(days=300)])
def test_timed_scan_of_all_events_in_any_order(spark, rocks, tmp_path, wait):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    folder = str(tmp_path / "in")
    # three files, each holding events of all times; then one of two years later, which lets time pass
    for k in range(3):
        events.where(F.abs(F.xxhash64("event_id")) % 3 == k).coalesce(1).write.mode("append").parquet(folder)
    events.limit(1).select(F.lit(-1).cast(events.schema["user_id"].dataType).alias("user_id"), (F.col("ts") + F.expr("INTERVAL 900 DAYS")).alias("ts"), "event_id", "event_type").write.mode("append").parquet(folder)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = drain(sessions.timed_rule_scan(source, "user_id", "ts", "event_id", "event_type", TIMED, wait, "400 days"), f"timed{wait.days}")

    want, by_user = [], {}
    for r in events.collect():
        by_user.setdefault(r.user_id, []).append((r.ts, r.event_id, r.event_type))
    for user, rows in by_user.items():
        rows.sort()
        for k, (t, _, x) in enumerate(rows):
            prev = rows[k - 1][2] if k and t - rows[k - 1][0] <= wait else None
            nxt = rows[k + 1][2] if k + 1 < len(rows) and rows[k + 1][0] - t <= wait else None
            want += [(user, str(t), x, r.name) for r in TIMED if sessions.hit(r, prev, x, nxt)]
    assert sorted((r.user_id, str(r.ts), r.event_type, r.rule) for r in got.collect() if r.user_id >= 0) == sorted(want)
    assert len(want) > 300
