"""Event streams: sessions by gap, windowed counts, and the rule scan with state.

An extension beyond batch use: the same rules and gaps over ``readStream`` input.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.rules import Rule, by_priority


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end, n: stretches without a pause longer than ``gap``; rows later than ``late`` are dropped."""
    s = F.session_window(F.col(ts), gap)
    return (
        events.withWatermark(ts, late).groupBy(key, s.alias("s")).agg(F.count("*").alias("n"))
        .select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
    )


def windowed_counts(events: DataFrame, ts: str, kind: str, length: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, kind, n in tumbling or sliding windows."""
    w = F.window(F.col(ts), length, slide) if slide else F.window(F.col(ts), length)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def hit(rule: Rule, prev: str | None, now: str, nxt: str | None) -> bool:
    """Whether a rule applies to a symbol between two others; a condition on a neighbour that is not there fails."""
    return (
        now in rule.target and (not rule.prev or prev in rule.prev) and (not rule.next or nxt in rule.next)
        and (not rule.not_prev or (prev is not None and prev not in rule.not_prev))
        and (not rule.not_next or (nxt is not None and nxt not in rule.not_next))
    )


def stateful_rule_scan(events: DataFrame, key: str, ts: str, symbol: str, rules: Sequence[Rule]) -> DataFrame:
    """key, ts, symbol, rule: rules with sets for the symbol before and after, as events arrive.

    State of a key: its last two symbols and the time of the last. A rule that looks ahead
    is decided when the next event of the key arrives. Events of a key must arrive in order
    of ``ts`` across batches; within a batch they are sorted.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    ordered = by_priority(rules)
    kind = dict(events.dtypes)[key]
    schema = f"{key} {kind}, {ts} timestamp, {symbol} string, rule string"

    def run(group, frames, state):
        prev, now, at = state.get if state.exists else (None, None, None)
        rows = []
        batch = pd.concat(list(frames)).sort_values(ts)
        for t, nxt in zip(batch[ts], batch[symbol]):
            if now is not None:
                rows += [(group[0], pd.Timestamp(at), now, r.name) for r in ordered if hit(r, prev, now, nxt)]
            prev, now, at = now, nxt, t.isoformat()
        state.update((prev, now, at))
        yield pd.DataFrame(rows, columns=[key, ts, symbol, "rule"])

    return events.groupBy(key).applyInPandasWithState(
        run, schema, "prev string, now string, at string", "append", GroupStateTimeout.NoTimeout
    )


class _TimedScan(StatefulProcessor):
    """State of a key: the events that the watermark has not passed, and the last two that it has."""

    def __init__(self, columns: Sequence[str], rules: Sequence[Rule], wait_us: int):
        self.columns, self.rules, self.wait_us = columns, rules, wait_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, tie bigint, symbol string")
        self.last = handle.getValueState("last", "prev string, at bigint, symbol string")

    def _timer(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def _decided(self, key, found):
        import pandas as pd

        rows = [(key[0], pd.Timestamp(at, unit="us"), now, r.name) for prev, at, now, nxt in found for r in self.rules if hit(r, prev, now, nxt)]
        return pd.DataFrame(rows, columns=[self.columns[0], self.columns[1], self.columns[3], "rule"])

    def handleInputRows(self, key, rows, timerValues):
        _, ts, tie, symbol = self.columns
        latest = None
        for pdf in rows:
            at = pdf[ts].astype("datetime64[us]").astype("int64")
            self.waiting.appendList(list(zip(at.tolist(), pdf[tie].tolist(), pdf[symbol].tolist())))
            latest = int(at.max()) if latest is None else max(latest, int(at.max()))
        if latest is not None:
            self._timer(latest)
        yield self._decided(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000  # beyond this timer, if time jumped
        held = sorted(tuple(x) for x in self.waiting.get())
        now = [x for x in held if x[0] <= passed]
        prev, at, symbol = self.last.get() if self.last.exists() else (None, None, None)
        found = []
        for next_at, _, nxt in now:
            if at is not None and next_at - at > self.wait_us:  # a pause ends the sequence
                found.append((prev, at, symbol, None))
                prev, symbol = None, None
            elif at is not None:
                found.append((prev, at, symbol, nxt))
            prev, at, symbol = symbol, next_at, nxt
        later = held[len(now) :]
        self.waiting.put(later) if later else self.waiting.clear()
        if at is not None and not later and passed > at + self.wait_us:
            found.append((prev, at, symbol, None))
            self.last.clear()
        elif at is not None:
            self.last.update((prev, at, symbol))
            self._timer(at + self.wait_us + 1000)
        yield self._decided(key, found)


def timed_rule_scan(
    events: DataFrame, key: str, ts: str, tie: str, symbol: str, rules: Sequence[Rule], wait: timedelta = timedelta(days=1), late: str = "1 hour"
) -> DataFrame:
    """key, ts, symbol, rule: the rule scan in order of (ts, tie), whatever order events arrive in.

    An event is held until the watermark, ``late`` behind the newest event, has passed it, and is then
    decided with both its neighbours. A pause of more than ``wait`` ends a key's sequence: a timer decides its last
    event and frees the key's state, so the state grows with the keys of the last ``wait`` alone. Events
    later than the watermark are dropped, as are those without a key, time or symbol. Times are UTC.
    Needs ``spark.sql.streaming.stateStore.providerClass`` to be that of RocksDB.
    """
    columns = [key, ts, tie, symbol]
    kind = dict(events.dtypes)[key]
    rows = events.select(key, ts, F.col(tie).cast("bigint").alias(tie), symbol).where(" AND ".join(f"{c} IS NOT NULL" for c in columns))
    scan = _TimedScan(columns, by_priority(rules), wait // timedelta(microseconds=1))
    schema = f"{key} {kind}, {ts} timestamp, {symbol} string, rule string"
    return rows.withWatermark(ts, late).groupBy(key).transformWithStateInPandas(scan, schema, "append", "EventTime")
