"""Stateful operators of the live stream: records in order of time, scan windows from panes, and beacon histories.

They are chained under one watermark. ``records`` holds packets back until the watermark passes them and then steps through them
in order, so it gives the same records however packets are dealt to micro-batches. ``scan_windows`` keeps no rows: a
source's records are summed by pane (one stride) and pair of host and port; a closed window is its panes merged. Besides
the pairs a pane holds its records' times (8 bytes or so each), as the gaps between them can change with a late one.

``scan_windows`` is a two-level store: sources are hashed to ``GROUPS`` groups, and each group's state maps its sources to their
panes. Limits on all sources and all records are shared evenly by the groups, so they hold over the whole stream without any task that
sees all of it. A source beyond its group's share makes the one that was seen longest ago go: its open windows are given at
once and marked. Records beyond a source's or the group's share are refused, and the windows that miss them are marked.

Cases: rows without a source are never dealt; a record all of whose windows have closed is late and counted; ties in time keep an order by
their other columns; a stream without rows gives nothing; windows of fewer than ``min_flows`` records are counted, not given.
"""

from __future__ import annotations

import json
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trafficlens.operators.beacons import ENDPOINT, HISTORY, LEAST_GAP, MOST_GAP, TTL_US
from trafficlens.operators.connections import KEY
from trafficlens.operators.portscan import FAILED_STATES, PAIR_SUMS
from trafficlens.operators.tracking import FIELDS, KNOWN_RECORD, STATE, STEP, events, over_us, record, step

GROUPS = 32
_PACKET = "timestamp_us long, seq long, own boolean, udp boolean, syn boolean, rst boolean, fin boolean, reply boolean"
_KNOWN = [f.split()[0] for f in KNOWN_RECORD.split(", ")]


def _set_timer(handle: StatefulProcessorHandle, at_us: int | None) -> None:
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    if at_us is not None:
        handle.registerTimer(-(-at_us // 1000))


class OrderedTracker(StatefulProcessor):
    """Records of one directed key from its packets in order of time."""

    def __init__(self, flush_us: int | None) -> None:
        self.flush_us = flush_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", STATE)
        self.waiting = handle.getListState("waiting", _PACKET)

    def _advance(self, key: tuple, new: list[tuple], mark_ms: int) -> Iterator[pd.DataFrame]:
        c = dict(zip(FIELDS, self.open.get(), strict=True)) if self.open.exists() else None
        waiting = sorted([*(tuple(r) for r in self.waiting.get()), *new], key=lambda p: (p[0], p[1], not p[2]))
        mark, out = mark_ms * 1000, []
        ready = [p for p in waiting if p[0] <= mark]
        waiting = waiting[len(ready) :]
        for p in ready:
            c = step(key, c, p, self.flush_us, out)
        if c is not None and over_us(c, self.flush_us) <= mark:
            out.append((*record(key, c), over_us(c, self.flush_us)))
            c = None
        self.open.clear() if c is None else self.open.update(tuple(c[n] for n in FIELDS))
        self.waiting.put(waiting) if waiting else self.waiting.clear()
        due = ([waiting[0][0]] if waiting else []) + ([over_us(c, self.flush_us)] if c is not None else [])
        _set_timer(self.handle, min(due) if due else None)
        if out:
            made = pd.DataFrame(out, columns=_KNOWN)
            # behind the watermark no row may go on; what a record is known at stays in its own column
            made["event_time"] = pd.to_datetime(made["known_us"].clip(lower=mark + 1000), unit="us", utc=True)
            yield made

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [r for part in rows for r in part[list(STEP)].itertuples(index=False, name=None)]
        yield from self._advance(key, [(int(r[0]), int(r[1]), *map(bool, r[2:])) for r in new], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def records(packets: DataFrame, flush_us: int | None) -> DataFrame:
    """A stream of records (with known_us and event_time) from packets with an ``event_time`` under a watermark."""
    dealt = events(packets)
    return dealt.groupBy(*KEY).transformWithStateInPandas(
        OrderedTracker(flush_us), outputStructType=KNOWN_RECORD + ", event_time timestamp", outputMode="append", timeMode="EventTime", eventTimeColumnName="event_time"
    )


class Limits(NamedTuple):
    """Bounds of the window store; None: none."""

    sources: int | None = None
    rows: int | None = None
    rows_of_source: int | None = None

    def shared(self, groups: int) -> Limits:
        """One group's part, so that all together keep to the bounds."""
        if min(x for x in (self.sources, self.rows, groups) if x is not None) < groups:
            raise ValueError("a limit is below the number of groups")
        return Limits(*(None if x is None else x // groups for x in (self.sources, self.rows)), self.rows_of_source)


#: The limits of the scan component
SCAN_LIMITS = Limits(4_096, 1_000_000, 250_000)

_SUMS = PAIR_SUMS[:9]
_TYPES = {"orig": "double", "resp": "double", "dur": "double"}
WINDOWS = (
    "kind string, src_ip string, start_us long, truncated boolean, evicted boolean, dst_ip string, dst_port string, c long, "
    + ", ".join(f"{n} {_TYPES.get(n, 'long')}" for n in PAIR_SUMS)
    + ", min_us long, max_us long, n long"
)
_NAMES = [f.split()[0] for f in WINDOWS.split(", ")]
#: What is counted; rows of the kind ``health`` have the count's name in src_ip and its growth in n, of the kind ``late`` the source
COUNTS = ("admitted", "late", "partly_late", "refused_source", "refused_global", "emitted", "abstained", "truncated", "sources_seen", "sources_evicted")


def _values(r) -> tuple:
    state, answered = r.conn_state, r.resp_pkts
    return (int(state in FAILED_STATES), int(state == "S0"), int(state == "REJ"), int(state == "RSTO"), int(answered == 0), int(r.history == "S"), r.orig_pkts, answered, r.duration)


class ScanPanes(StatefulProcessor):
    """The panes of one group of sources."""

    def __init__(self, window_us: int, stride_us: int, wait_us: int, min_flows: int, limits: Limits) -> None:
        self.window_us, self.stride_us, self.wait_us, self.min_flows, self.limits = window_us, stride_us, wait_us, min_flows, limits
        if window_us % stride_us:
            raise ValueError("a window is a multiple of its stride")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # seen: when it was last heard of; cursor: the first window not given; refused: first and last time of refused records
        self.sources = handle.getMapState("sources", "src_ip string", "seen long, cursor long, refused_from long, refused_to long, panes string")
        self.panes = handle.getMapState("panes", "src_ip string, pane long", "pairs string, times string")

    def _load(self) -> None:
        self.about: dict[str, dict] = {}
        for (src,), (seen, cursor, first, last, panes) in self.sources.iterator():
            self.about[src] = {"seen": seen, "cursor": cursor, "refused": None if first is None else (first, last), "panes": {int(k): n for k, n in json.loads(panes).items()}}
        self.held: dict[tuple[str, int], tuple[dict, list]] = {}
        self.changed: set[str] = set()
        self.out: list[tuple] = []
        self.counts: Counter = Counter()
        self.late: Counter = Counter()
        self.rows = sum(sum(a["panes"].values()) for a in self.about.values())

    def _pane(self, src: str, pane: int) -> tuple[dict, list]:
        if (src, pane) not in self.held:
            pairs, times = self.panes.getValue((src, pane)) if self.panes.containsKey((src, pane)) else ("[]", "[]")
            self.held[src, pane] = ({(p[0], p[1]): p[2:] for p in json.loads(pairs)}, json.loads(times))
        return self.held[src, pane]

    def _save(self) -> None:
        for src in self.changed:
            a = self.about.get(src)
            if a is None:
                if self.sources.containsKey((src,)):
                    self.sources.removeKey((src,))
            else:
                self.sources.updateValue((src,), (a["seen"], a["cursor"], *(a["refused"] or (None, None)), json.dumps(a["panes"])))
        for (src, pane), (pairs, times) in self.held.items():
            if src in self.about and pane in self.about[src]["panes"]:
                if (src, pane) in self.grown:
                    self.panes.updateValue((src, pane), (json.dumps([[*k, *v] for k, v in pairs.items()]), json.dumps(times)))
            elif self.panes.containsKey((src, pane)):
                self.panes.removeKey((src, pane))

    def _first(self, ts: int) -> int:
        """Start of the first window that holds a time."""
        return ts // self.stride_us * self.stride_us - self.window_us + self.stride_us

    def _give(self, src: str, start: int, evicted: bool) -> None:
        a = self.about[src]
        mine = [self._pane(src, p) for p in sorted(a["panes"]) if start <= p < start + self.window_us]
        times = [t for _, ts in mine for t in ts]
        if not times:
            return
        if len(times) < self.min_flows:
            self.counts["abstained"] += 1
            return
        cut = a["refused"] is not None and a["refused"][0] < start + self.window_us and a["refused"][1] >= start
        self.counts["emitted"] += 1
        self.counts["truncated"] += cut
        pairs: dict[tuple, list] = {}
        for some, _ in mine:
            for k, v in some.items():
                pairs[k] = [x + y for x, y in zip(pairs[k], v, strict=True)] if k in pairs else v
        gaps = [y - x for x, y in zip(times, times[1:], strict=False)]
        total = (len(gaps), sum(gaps), sum(g * g for g in gaps))
        for (host, port), v in pairs.items():
            self.out.append(("pair", src, start, cut, evicted, host, port, *v, *total, times[0], times[-1], None))
            total = (0, 0, 0)

    def _close(self, src: str, mark: int | None) -> None:
        """Give the source's windows that end ``wait_us`` before the mark (None: all), and forget panes that no other needs."""
        a = self.about[src]
        while a["panes"]:
            start = max(self._first(min(a["panes"])), a["cursor"] if a["cursor"] is not None else -(1 << 62))
            if mark is not None and start + self.window_us + self.wait_us > mark:
                break
            self._give(src, start, mark is None)
            a["cursor"] = start + self.stride_us
            self.changed.add(src)
            for pane in [p for p in a["panes"] if p < a["cursor"]]:
                self._pane(src, pane)
                self.rows -= a["panes"].pop(pane)
        if not a["panes"]:
            a["refused"] = None

    def _evict(self) -> None:
        src = min(self.about, key=lambda s: (self.about[s]["seen"], s))
        self._close(src, None)
        del self.about[src]
        self.changed.add(src)
        self.counts["sources_evicted"] += 1

    def _admit(self, r) -> None:
        src, ts, known = r.src_ip, int(r.ts_us), int(r.known_us)
        if src in self.about:
            self._close(src, known)
        else:
            if self.limits.sources is not None and len(self.about) >= self.limits.sources:
                self._evict()
            # windows that close before the first record is known can't hold it
            self.about[src] = {"seen": known, "cursor": None, "refused": None, "panes": {}}
            self.counts["sources_seen"] += 1
        a = self.about[src]
        self.changed.add(src)
        a["seen"] = known
        past = -(-(known - self.wait_us - self.window_us) // self.stride_us) * self.stride_us
        a["cursor"] = max(past, a["cursor"]) if a["cursor"] is not None else past
        pane = ts // self.stride_us * self.stride_us
        if pane < a["cursor"]:
            self.counts["late"] += 1
            self.late[src] += 1
            return
        self.counts["partly_late"] += self._first(ts) < a["cursor"]
        full = self.limits.rows_of_source is not None and sum(a["panes"].values()) >= self.limits.rows_of_source
        if full or (self.limits.rows is not None and self.rows >= self.limits.rows):
            self.counts["refused_source" if full else "refused_global"] += 1
            first, last = a["refused"] or (ts, ts)
            a["refused"] = (min(first, ts), max(last, ts))
            return
        pairs, times = self._pane(src, pane)
        values = [1, *_values(r)]
        old = pairs.get((r.dst_ip, r.dst_port))
        pairs[r.dst_ip, r.dst_port] = values if old is None else [x + y for x, y in zip(old, values, strict=True)]
        insort(times, ts)
        a["panes"][pane] = a["panes"].get(pane, 0) + 1
        self.grown.add((src, pane))
        self.rows += 1
        self.counts["admitted"] += 1

    def _step(self, new: pd.DataFrame | None, mark_ms: int) -> Iterator[pd.DataFrame]:
        self.grown: set[tuple[str, int]] = set()
        self._load()
        if new is not None:
            for r in new[new["src_ip"].notna()].sort_values(["known_us", "ts_us", "src_ip", "dst_ip", "dst_port"]).itertuples(index=False):
                self._admit(r)
        mark = mark_ms * 1000
        for src in list(self.about):
            self._close(src, mark)
            a = self.about[src]
            # an empty source that has been quiet so long that nothing known later can be late for it is forgotten
            if not a["panes"] and a["seen"] + self.window_us + self.wait_us <= mark:
                del self.about[src]
                self.changed.add(src)
        self._save()
        due = [
            (max(self._first(min(a["panes"])), a["cursor"]) + self.window_us if a["panes"] else a["seen"] + self.window_us) + self.wait_us
            for a in self.about.values()
        ]
        _set_timer(self.handle, min(due) if due else None)
        blank = [None] * (len(_NAMES) - 3)
        counted = [("health", k, None, *blank[:-1], n) for k, n in sorted(self.counts.items()) if n] + [("late", k, None, *blank[:-1], n) for k, n in sorted(self.late.items())]
        if self.out or counted:
            made = pd.DataFrame(self.out + counted, columns=_NAMES)
            yield made.astype({c: "object" for c in made.columns if made[c].isna().any()}).where(made.notna(), None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._step(pd.concat(list(rows)), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step(None, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def scan_windows(known: DataFrame, window_s: float, stride_s: float, wait_us: int, min_flows: int = 5, limits: Limits = Limits(), groups: int = GROUPS) -> DataFrame:
    """Closed scan windows by pair (WINDOWS), and counts, from a stream of records with known_us and event_time.

    A window is closed ``wait_us`` after its end, in terms of when records are known, so a record's windows don't depend on micro-batches.
    """
    operator = ScanPanes(int(window_s * 1_000_000), int(stride_s * 1_000_000), wait_us, min_flows, limits.shared(groups))
    grouped = known.withColumn("group", F.pmod(F.xxhash64("src_ip"), F.lit(groups))).groupBy("group")
    return grouped.transformWithStateInPandas(operator, outputStructType=WINDOWS, outputMode="append", timeMode="EventTime")


_HISTORY = "src_ip string, dst_ip string, dst_port int, window_us long, beacon_count long, first_us long, last_us long, n_gaps long, gap_sum long, gap_squares string, total_bytes long"


class BeaconWindows(StatefulProcessor):
    """An endpoint's history at the end of each window in which it has starts; see ``beacons.histories``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "timestamp_us long")
        self.total = handle.getValueState("total", "bytes long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["timestamp_us", "seq"])
        times = [int(t[0]) for t in self.times.get()]
        total = self.total.get()[0] if self.total.exists() else 0
        out = []
        for window, part in new.groupby("window_us", sort=True):
            for t, size in zip(part["timestamp_us"].tolist(), part["bytes"].tolist(), strict=True):
                if times and t - times[-1] > TTL_US:
                    times, total = [], 0
                times = [*times, t][-HISTORY:]
                total += size
            gaps = [y - x for x, y in zip(times, times[1:], strict=False)]
            gaps = [g for g in gaps if LEAST_GAP * 1e6 <= g <= MOST_GAP * 1e6]
            out.append((*key, int(window), len(times), times[0], times[-1], len(gaps), sum(gaps), str(sum(g * g for g in gaps)), total))
        self.times.put([(t,) for t in times])
        self.total.update((total,))
        _set_timer(self.handle, times[-1] + TTL_US + 1)
        yield pd.DataFrame(out, columns=[f.split()[0] for f in _HISTORY.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        self.total.clear()
        yield from ()

    def close(self) -> None:
        pass


def beacon_histories(starts: DataFrame, lateness_us: int) -> DataFrame:
    """A stream of histories from a stream of starts that come window by window."""
    timed = starts.withColumn("event_time", F.timestamp_micros("timestamp_us")).withWatermark("event_time", f"{lateness_us} microseconds")
    grouped = timed.groupBy(*ENDPOINT)
    return grouped.transformWithStateInPandas(BeaconWindows(), outputStructType=_HISTORY, outputMode="append", timeMode="EventTime")
