"""Keyed state that outlives micro-batches: attempts in order of event time, results in order of index, entries that expire.

These need the RocksDB state store: set spark.sql.streaming.stateStore.providerClass (see ROCKSDB) before the query starts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def millis(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64") // 1000


class InEventOrder(StatefulProcessor):
    """Holds rows back until the watermark has passed them, then counts them in order of (ts, seq).

    A timer stands for each waiting time; a row that comes after its time was handled is late, and Spark drops it."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, failed boolean")
        self.past = handle.getValueState("past", "seen long, fails long, good boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in rows:
            if len(part):
                at = millis(part["ts"])
                failed = part["failed"].map(lambda f: False if f is None or f != f else bool(f))
                self.waiting.appendList(list(zip(at.tolist(), part["seq"].tolist(), failed.tolist(), strict=True)))
                for t in sorted(set(at.tolist())):
                    self.handle.registerTimer(t + 1)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [r for r in rows if r[0] < passed], [r for r in rows if r[0] >= passed]
        if ready:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            seen, fails, good = tuple(self.past.get()) if self.past.exists() else (0, 0, False)
            out = []
            for _, seq, failed in ready:
                out.append((seq, seen, fails, good, failed))
                seen, fails, good = seen + 1, fails + failed, good or not failed
            self.past.update((seen, fails, good))
            yield pd.DataFrame({self.key: [key[0]] * len(out), **{c: [r[i] for r in out] for i, c in enumerate(("seq", "seen", "fails", "good", "failed"))}})

    def close(self) -> None:
        pass


def history_before(df: DataFrame, key: str, ts: str, seq: str, failed: str, late: str) -> DataFrame:
    """key, seq, failed and, of the rows of the key before this one in order of (ts, seq): seen (rows), fails, good (any success).

    A row comes out once the watermark (`late` behind the newest row) has passed it, so the order is that of the events, not of arrival."""
    rows = df.selectExpr(key, f"{ts} AS ts", f"cast({seq} AS long) AS seq", f"cast({failed} AS boolean) AS failed").withWatermark("ts", late)
    kind = f"{key} {df.schema[key].dataType.simpleString()}, seq long, seen long, fails long, good boolean, failed boolean"
    return rows.groupBy(key).transformWithStateInPandas(InEventOrder(key), kind, "Append", "EventTime")


def holds_in_order(df: DataFrame, key: str, ts: str, seq: str, late: str, lock_at: int = 10) -> DataFrame:
    """n-th sighting of each key in order of event time, and whether it is locked from there on: what windows.running_hold gives for all rows at once."""
    rows = history_before(df, key, ts, seq, "false", late)
    return rows.selectExpr(key, "seq", "seen + 1 AS seen", f"seen + 1 >= {int(lock_at)} AS locked")


def strikes_in_order(df: DataFrame, key: str, ts: str, seq: str, failed: str, late: str, limit: int = 3) -> DataFrame:
    """State of each attempt in order of event time: what windows.three_strike gives for all rows at once."""
    rows = history_before(df, key, ts, seq, failed, late)
    n = int(limit)
    state = f"CASE WHEN good THEN 'shared' WHEN fails + cast(failed AS int) >= {n} AND (failed OR fails >= {n}) THEN 'forced' WHEN failed THEN 'failed' ELSE 'success' END"
    return rows.selectExpr(key, "seq", "fails", f"{state} AS state")


class InIndexOrder(StatefulProcessor):
    """Emits the rows of a key by ascending index, each once, as soon as all before it are out; a gap is given up when the watermark has passed the
    first row behind it by `wait`."""

    def __init__(self, key: str, wait_ms: int):
        self.key, self.wait = key, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "idx long")
        self.held = handle.getMapState("held", "idx long", "at long, payload string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        due = self.due()
        for part in rows:
            for idx, at, payload in zip(part["idx"].tolist(), millis(part["ts"]).tolist(), part["payload"].tolist(), strict=True):
                # What is out already, or waits already, is a repeat.
                if idx >= due and not self.held.containsKey((idx,)):
                    self.held.updateValue((idx,), (at, payload))
                    self.handle.registerTimer(at + self.wait + 1)
        yield from self.run(key, due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() - self.wait
        old = [k[0] for k, v in self.held.iterator() if v[0] < passed]
        if old:
            yield from self.run(key, self.due(), max(old))

    def due(self) -> int:
        return self.next.get()[0] if self.next.exists() else 0

    def run(self, key: Any, due: int, until: int = -1) -> Iterator[pd.DataFrame]:
        """Rows from `due` on without a gap; up to `until` gaps are passed over."""
        out = []
        waiting = sorted(k[0] for k in self.held.keys()) if self.held.exists() else []
        for idx in waiting:
            if idx != due and idx > until:
                break
            out.append((idx, self.held.getValue((idx,))[1]))
            self.held.removeKey((idx,))
            due = idx + 1
        if out:
            self.next.update((due,))
            yield pd.DataFrame({self.key: [key[0]] * len(out), "idx": [i for i, _ in out], "payload": [p for _, p in out]})

    def close(self) -> None:
        pass


def in_index_order(df: DataFrame, key: str, index: str, ts: str, payload: str, late: str, wait_ms: int) -> DataFrame:
    """key, idx, payload of the results of each job, in order of their index (from 0) and once each, whatever order they finish in.

    `payload` is a string (to_json of a struct for more columns). Results wait in the state only while an earlier one is missing."""
    rows = df.selectExpr(key, f"cast({index} AS long) AS idx", f"{ts} AS ts", f"cast({payload} AS string) AS payload").withWatermark("ts", late)
    kind = f"{key} {df.schema[key].dataType.simpleString()}, idx long, payload string"
    return rows.groupBy(key).transformWithStateInPandas(InIndexOrder(key, wait_ms), kind, "Append", "EventTime")


class Expiring(StatefulProcessor):
    """Counts the rows of a key; the count is forgotten when nothing came for `ttl_ms` of processing time."""

    def __init__(self, key: str, ttl_ms: int):
        self.key, self.ttl = key, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long", self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n = (self.count.get()[0] if self.count.exists() else 0) + sum(len(part) for part in rows)
        self.count.update((n,))
        yield pd.DataFrame({self.key: [key[0]], "n": [n]})

    def close(self) -> None:
        pass


def counts_with_expiry(df: DataFrame, key: str, ttl_ms: int) -> DataFrame:
    """key and n, its rows since it last expired (update mode). A key that stays away for `ttl_ms` leaves the state by itself.

    Run it with a trigger of processing time: an availableNow query doesn't end, as time goes on without rows."""
    kind = f"{key} {df.schema[key].dataType.simpleString()}, n long"
    return df.select(key).groupBy(key).transformWithStateInPandas(Expiring(key, ttl_ms), kind, "Update", "ProcessingTime")


class Claims(StatefulProcessor):
    """Rows of one message that wait for a result, and the reasons of the results it had."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "log long")
        self.reasons = handle.getMapState("reasons", "reason string", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        waiting = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        changed: dict[int, tuple] = {}
        events = sorted((s, r) for part in rows for s, r in zip(part["seq"].tolist(), part["reason"].tolist(), strict=True))
        for seq, reason in events:
            if reason is None or reason != reason:
                waiting.append(seq)
                changed[seq] = (None, None)
            else:
                again = self.reasons.containsKey((reason,))
                if waiting:
                    changed[waiting.pop(0)] = (seq, reason)
                elif not again:
                    changed[seq] = (seq, reason)
                if not again:
                    self.reasons.updateValue((reason,), (1,))
        if waiting:
            self.waiting.put([(w,) for w in waiting])
        else:
            self.waiting.clear()
        if changed:
            out = [(key[0], log, *v) for log, v in changed.items()]
            yield pd.DataFrame({self.key: [r[0] for r in out], "log": [r[1] for r in out], "result": pd.array([r[2] for r in out], "Int64"), "reason": [r[3] for r in out]})

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame, key: str = "message") -> DataFrame:
    """message, log, result, reason of every log row that a micro-batch makes or fills (update mode); events of a message count in order of `seq` inside a batch and
    of arrival over batches. The last row of each log is what operators.progress.merge_progress gives for all events at once."""
    rows = events.selectExpr(f"coalesce({key}, '') AS {key}", "cast(seq AS long) AS seq", "reason")
    return rows.groupBy(key).transformWithStateInPandas(Claims(key), f"{key} string, log long, result long, reason string", "Update", "None")
