"""The JSON envelopes hold every event once."""

import datetime
import json

from seqloom.plans import text_queries


def test_json_envelope_of_all_events(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(u, start + datetime.timedelta(hours=5 * k), 100 * u + k, ("view", "error")[k % 3 == 0], 1.0) for u, n in ((1, 3), (2, 12)) for k in range(n)]
    spark.createDataFrame(rows, "user_id bigint, ts timestamp_ntz, event_id bigint, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r.user_id, r.day): json.loads(r.json) for r in text_queries.json_envelope(spark, str(tmp_path)).collect()}
    want = {}
    for u, t, k, x, _ in rows:
        want.setdefault((u, t.date()), []).append({"pos": k - 100 * u, "event_type": x} | ({"bad": True} if x == "error" else {}))
    assert got == {k: {"user_id": k[0], "day": str(k[1]), "events": v} for k, v in want.items()}
