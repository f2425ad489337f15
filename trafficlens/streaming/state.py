"""Stateful stream operators: connection tracking and beacon history.

Both use Spark's arbitrary state with event-time timers, and so need the RocksDB state
store: ``spark.sql.streaming.stateStore.providerClass`` set to ``ROCKSDB``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trafficlens.operators.beacons import HISTORY
from trafficlens.operators.connections import KEY, roles
from trafficlens.operators.tracking import FIELDS, RECORD, STATE, over_us, record, step

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TTL_MS = 1_800_000
_RECORD_NAMES = [f.split()[0] for f in RECORD.split(", ")]


class ConnectionTracker(StatefulProcessor):
    """The open record of each directed key, by the rules of ``operators.connections``; idle ones end by an event-time timer.

    With ``flush_us``, multiples of it are window boundaries, at which unanswered records of some age and
    idle ones end early, so that a scan without answers is counted in its window.
    """

    def __init__(self, flush_us: int | None = None) -> None:
        self.flush_us = flush_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)

    def _set_timer(self, at_us: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at_us is not None:
            self.handle.registerTimer(-(-at_us // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        c, out = dict(zip(FIELDS, self.open.get(), strict=True)) if self.open.exists() else None, []
        every = pd.concat(list(rows)).sort_values(["timestamp_us", "seq", "own"], ascending=[True, True, False])
        for p in every.itertuples(index=False):
            c = step(key, c, (int(p.timestamp_us), p.seq, p.own, False, p.syn, p.rst, p.fin, p.reply), self.flush_us, out)
        self.open.clear() if c is None else self.open.update(tuple(c[n] for n in FIELDS))
        self._set_timer(None if c is None else over_us(c, self.flush_us))
        if out:
            yield pd.DataFrame([r[:-1] for r in out], columns=_RECORD_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            c = dict(zip(FIELDS, self.open.get(), strict=True))
            self.open.clear()
            self._set_timer(None)
            yield pd.DataFrame([record(key, c)], columns=_RECORD_NAMES)

    def close(self) -> None:
        pass


def connection_records(packets: DataFrame, lateness_ms: int = 0, flush_us: int | None = None) -> DataFrame:
    """A stream of TCP connection records from a stream of packets."""
    timed = roles(packets).withColumn("event_time", F.timestamp_micros("timestamp_us")).withWatermark("event_time", f"{lateness_ms} milliseconds")
    return timed.groupBy(*KEY).transformWithStateInPandas(ConnectionTracker(flush_us), outputStructType=RECORD, outputMode="append", timeMode="EventTime")


_ROW = "ts_us long, dst_ip string, dst_port string, conn_state string, duration double, orig_pkts double, resp_pkts double, history string"
_COLUMNS = [f.split()[0] for f in _ROW.split(", ")]


class BoundedWindows(StatefulProcessor):
    """Sliding windows of one source with at most ``most_rows`` rows in state.

    A row beyond the bound is refused, and every window that it belonged to is marked as truncated. Windows are given
    once, in order, when the watermark passes their end; rows that no open window needs are dropped. A row
    all of whose windows have been given is late and ignored.
    """

    def __init__(self, window_us: int, stride_us: int, most_rows: int) -> None:
        self.window_us, self.stride_us, self.most_rows = window_us, stride_us, most_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", _ROW)
        # the first window not given yet, and the first and last time of a refused row
        self.about = handle.getValueState("about", "cursor long, refused_from long, refused_to long")

    def _first(self, ts: int) -> int:
        """Start of the first window that holds a time."""
        return (ts - self.window_us) // self.stride_us * self.stride_us + self.stride_us

    def _given(self, key, rows: list[tuple], about: list[int | None], mark_us: int) -> tuple[list[tuple], pd.DataFrame | None]:
        """The rows that stay, and those of all windows that end by the watermark."""
        out = []
        if rows:
            start = max(self._first(min(r[0] for r in rows)), about[0] or -(1 << 62))
            while start + self.window_us <= mark_us and rows:
                inside = [r for r in rows if start <= r[0] < start + self.window_us]
                cut = about[1] is not None and about[1] < start + self.window_us and about[2] >= start
                out += [(key[0], start, cut, *r) for r in inside]
                start += self.stride_us
                rows = [r for r in rows if r[0] >= start]
        # the first window that the watermark hasn't passed
        about[0] = max(about[0] or -(1 << 62), (mark_us - self.window_us) // self.stride_us * self.stride_us + self.stride_us)
        if about[2] is not None and about[2] < about[0]:
            about[1] = about[2] = None
        return rows, pd.DataFrame(out, columns=["src_ip", "start_us", "truncated", *_COLUMNS]) if out else None

    def _keep(self, rows: list[tuple], about: list[int | None]) -> None:
        self.rows.put(rows) if rows else self.rows.clear()
        self.about.update(tuple(about))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rows:
            due = max(self._first(min(r[0] for r in rows)), about[0]) + self.window_us
            self.handle.registerTimer(-(-due // 1000))

    def _step(self, key, new: list[tuple], timerValues) -> Iterator[pd.DataFrame]:
        rows = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        about = list(self.about.get()) if self.about.exists() else [None, None, None]
        for r in new:
            if about[0] is not None and r[0] // self.stride_us * self.stride_us < about[0]:
                continue
            if len(rows) < self.most_rows:
                rows.append(r)
            else:
                about[1:] = [min(r[0], r[0] if about[1] is None else about[1]), max(r[0], r[0] if about[2] is None else about[2])]
        rows, given = self._given(key, rows, about, timerValues.getCurrentWatermarkInMs() * 1000)
        self._keep(rows, about)
        if given is not None:
            yield given

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("ts_us", kind="stable")
        yield from self._step(key, list(new[_COLUMNS].itertuples(index=False, name=None)), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step(key, [], timerValues)

    def close(self) -> None:
        pass


def bounded_scan_windows(connections: DataFrame, window_s: float = 30, stride_s: float = 10, lateness_s: float = 60, most_rows: int = 250_000) -> DataFrame:
    """Rows of closed windows (src_ip, start_us, truncated, and the connection's columns) with bounded state for each source."""
    timed = connections.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", f"{int(lateness_s * 1000)} milliseconds")
    operator = BoundedWindows(int(window_s * 1_000_000), int(stride_s * 1_000_000), most_rows)
    return timed.groupBy("src_ip").transformWithStateInPandas(operator, outputStructType=f"src_ip string, start_us long, truncated boolean, {_ROW}", outputMode="append", timeMode="EventTime")


class BeaconHistory(StatefulProcessor):
    """Each endpoint's last connection times; an endpoint without events for TTL_MS of event time is forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "ts_us long, bytes long")
        self.total = handle.getValueState("total", "bytes long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        kept = [tuple(x) for x in self.times.get()] if self.times.exists() else []
        kept = sorted(kept + [(int(t), int(b)) for t, b in zip(new["timestamp_us"], new["bytes"], strict=True)])[-HISTORY:]
        total = (self.total.get()[0] if self.total.exists() else 0) + int(new["bytes"].sum())
        self.times.put(kept)
        self.total.update((total,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(kept[-1][0] // 1000 + TTL_MS)
        yield pd.DataFrame({"src_ip": [key[0]], "dst_ip": [key[1]], "dst_port": [key[2]], "times": [[t for t, _ in kept]], "total_bytes": [total]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        self.total.clear()
        yield from ()

    def close(self) -> None:
        pass


def beacon_histories(starts: DataFrame, lateness_ms: int = 0) -> DataFrame:
    """After each micro-batch, the history of every endpoint with new connection starts."""
    timed = starts.withColumn("event_time", F.timestamp_micros("timestamp_us")).withWatermark("event_time", f"{lateness_ms} milliseconds")
    return timed.groupBy("src_ip", "dst_ip", "dst_port").transformWithStateInPandas(
        BeaconHistory(), outputStructType="src_ip string, dst_ip string, dst_port int, times array<long>, total_bytes long", outputMode="append", timeMode="EventTime"
    )


def history_events(histories: DataFrame) -> DataFrame:
    """Histories as the events that ``beacons.beacon_scores`` takes; the total is on the first event of a history."""
    rows = histories.select("src_ip", "dst_ip", "dst_port", "total_bytes", F.posexplode("times").alias("seq", "ts_us"))
    return rows.select("src_ip", "dst_ip", "dst_port", (F.col("ts_us") / 1e6).alias("ts"), "seq", F.when(F.col("seq") == 0, F.col("total_bytes")).otherwise(0).alias("bytes"))
