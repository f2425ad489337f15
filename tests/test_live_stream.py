"""The live plan as a stream, its operators, and the sink that writes a micro-batch once."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from functools import reduce
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tests.conftest import SF_DIR, rows
from tests.test_detectors import packets_of, random_packets
from trafficlens import views
from trafficlens.operators import connections, portscan, tracking, training
from trafficlens.plans import live
from trafficlens.sources import sinks, synthetic
from trafficlens.streaming import panes, windows


def arriving(spark, tmp_path, df, ts, parts, most_us, ticks=2):
    """A file stream in which each row comes up to ``most_us`` after its time, and then ticks."""
    df = df.withColumn("arrival", F.col(ts) + (F.rand(5) * most_us).cast("long")).persist()
    low, high = df.agg(F.min("arrival"), F.max("arrival")).first()
    for k in range(parts):
        mine = df.where((F.col("arrival") - low) * parts >= (high + 1 - low) * k).where((F.col("arrival") - low) * parts < (high + 1 - low) * (k + 1)).drop("arrival")
        mine.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = df.drop("arrival").schema
    for k in range(ticks):
        windows.tick_row(spark, schema, high + 10**9 * (k + 1), ts=ts).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_stream_gives_the_alerts_of_the_batch_once(spark, tmp_path):
    parts = [synthetic.flood(spark, 2500), synthetic.scan(spark, 60, answered=False), synthetic.upload(spark), synthetic.beacon(spark, 12), synthetic.sessions(spark)]
    packets = reduce(DataFrame.unionByName, parts).withColumn("timestamp_us", F.col("timestamp_us") + 23_000_000)
    models = live.Models(scan=training.scan_detector(spark, 10, 2, trees=5, depth=3, folds=2))
    folder = str(tmp_path / "out")
    first, second = live.stream(arriving(spark, tmp_path, packets, "timestamp_us", 4, 4_900_000), folder, models, once=True)
    first.awaitTermination()
    second().awaitTermination()
    got, want = live.streamed_alerts(spark, folder).toPandas(), live.alerts(packets, scan_model=models.scan).toPandas()
    assert rows(got) == rows(want) and set(want["threat_class"]) == {"DDoS", "PortScan", "DataExfiltration", "C2_BEACONING", "EncryptedMalware"}
    assert got["alert_id"].is_unique and (want["threat_class"] == "C2_BEACONING").sum() > 1
    counted = {r["name"]: r["n"] for r in live.stream_health(spark, folder).collect()}
    assert counted["emitted"] and counted["sources_seen"] and not {"refused_source", "refused_global", "truncated", "sources_evicted"} & set(counted)


@pytest.mark.parametrize("flush_us", [None, 10_000_000])
def test_records_do_not_depend_on_chunks(spark, flush_us):
    made = packets_of(spark, *random_packets(9, 500))
    whole = rows(tracking.flushed_records(made, flush_us, 10**15).toPandas())
    assert all(rows(tracking.flushed_records(made, flush_us, us).toPandas()) == whole for us in (20_000_000, 3_000_000))
    if flush_us is None:
        names = connections.records(made).columns
        assert rows(tracking.flushed_records(made, None).select(names).toPandas()) == rows(connections.records(made).toPandas())


def test_records_of_a_stream_in_any_order(spark, tmp_path):
    made = packets_of(spark, *random_packets(4, 200)).withColumn("timestamp_us", F.col("timestamp_us") + 1_000_000)
    stream = arriving(spark, tmp_path, made, "timestamp_us", 3, 20_000_000).withColumn("event_time", F.timestamp_micros("timestamp_us")).withWatermark("event_time", "20 seconds")
    got = []
    windows.each_batch(panes.records(stream, 10_000_000), lambda b, _: got.extend(b.drop("event_time").collect()), str(tmp_path / "check"), once=True).awaitTermination()
    assert rows(spark.createDataFrame(got, tracking.KNOWN_RECORD).toPandas()) == rows(tracking.flushed_records(made, 10_000_000).toPandas())


def test_pane_windows_equal_the_batch_without_rows_in_state(spark, tmp_path):
    made = views.connections(spark, SF_DIR).drop("seq").withColumn("known_us", F.col("ts_us"))
    stream = arriving(spark, tmp_path, made, "ts_us", 3, 0).withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", "0 seconds")
    got = []
    q = windows.each_batch(panes.scan_windows(stream, 30, 10, 0), lambda b, _: got.extend(b.where("kind = 'pair'").collect()), str(tmp_path / "check"), once=True)
    q.awaitTermination()
    streamed = {(r["src_ip"], r["start_us"]): r for r in portscan.features_of_pairs(spark.createDataFrame(got, panes.WINDOWS), 30).collect()}
    batch = {(r["src_ip"], r["start_us"]): r for r in portscan.window_features(made).collect()}
    assert batch and streamed.keys() == batch.keys() and all(streamed[k][c] == batch[k][c] for k in batch for c in portscan.FEATURES)
    # state: sources and their panes (and a few timers for each group), not rows
    sizes = [op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]]
    per_source = made.agg(F.max("ts_us") - F.min("ts_us"), F.count_distinct("src_ip")).first()
    assert max(sizes) <= per_source[1] * (2 + per_source[0] // 10_000_000) + 4 * panes.GROUPS
    assert sizes[-1] == 0


class Memory:
    """The part of a state handle that ScanPanes uses, in a dictionary."""

    def __init__(self):
        self.maps, self.timers = defaultdict(dict), []

    def getMapState(self, name, key, value):
        held = self.maps[name]
        return SimpleNamespace(
            iterator=lambda: list(held.items()), getValue=held.get, containsKey=held.__contains__, updateValue=held.__setitem__, removeKey=held.__delitem__,
        )

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


def stepped(operator, batches):
    """All rows that the operator gives for micro-batches of (rows, watermark in ms), and the state after each."""
    memory, out, sizes = Memory(), [], []
    operator.init(memory)
    for made, mark in batches:
        time = SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark)
        frames = operator.handleInputRows((0,), iter([made]), time) if len(made) else operator.handleExpiredTimer((0,), time, None)
        out += [r for f in frames for r in f.to_dict("records")]
        sizes.append((len(memory.maps["sources"]), memory.maps["sources"].values(), len(memory.maps["panes"]), len(memory.timers)))
        sizes[-1] = (*sizes[-1][:1], sum(sum(panes.json.loads(v[4]).values()) for v in memory.maps["sources"].values()), *sizes[-1][2:])
    return out, sizes


def busy_records(sources, n, seed=3):
    rng = random.Random(seed)
    made = [(1_000_000 * (i * 200 // n) + rng.randint(0, 999_999), f"10.0.{k // 256}.{k % 256}") for i in range(n) for k in [min(rng.randint(0, sources - 1), rng.randint(0, sources - 1))]]
    made = [(ts, src, f"h{rng.randint(0, 3)}", str(rng.randint(1, 9)), "S0", 0.0, 1.0, 0.0, "S", ts) for ts, src in sorted(made)]
    return pd.DataFrame(made, columns=[f.split()[0] for f in tracking.KNOWN_RECORD.split(", ")])


def micro_batches(made, parts):
    ends = [int(made["ts_us"].iloc[min(len(made) - 1, (k + 1) * len(made) // parts)]) for k in range(parts)]
    begin = -1
    for end in ends:
        yield made[(made["ts_us"] > begin) & (made["ts_us"] <= end)], end // 1000
        begin = end
    yield made[:0], 10**9


def counts(out):
    total = Counter()
    for r in out:
        if r["kind"] == "health":
            total[r["src_ip"]] += int(r["n"])
    return total


def test_limits_hold_and_evicted_windows_are_given_and_marked():
    made = busy_records(80, 6000)
    limits = panes.Limits(sources=64, rows=150, rows_of_source=10)
    out, sizes = stepped(panes.ScanPanes(10_000_000, 2_000_000, 3_000_000, 2, limits), micro_batches(made, 40))
    assert max(s[0] for s in sizes) == 64 and max(s[1] for s in sizes) <= 150 and sizes[-1] == (0, 0, 0, 0) and all(s[3] <= 1 for s in sizes)
    seen = counts(out)
    assert seen["sources_evicted"] > 0 and seen["admitted"] + seen["refused_source"] + seen["refused_global"] + seen["late"] == len(made)
    given = {(r["src_ip"], r["start_us"]) for r in out if r["kind"] == "pair"}
    assert {r["src_ip"] for r in out if r["kind"] == "pair" and r["evicted"]}
    # every window that lost a record says so
    whole = Counter((src, s) for src, ts in zip(made["src_ip"], made["ts_us"], strict=True) for s in range(ts // 2_000_000 * 2_000_000 - 8_000_000, ts + 1, 2_000_000))
    size = Counter()
    for r in out:
        if r["kind"] == "pair":
            size[r["src_ip"], r["start_us"]] += r["c"]
    told = {(r["src_ip"], r["start_us"]) for r in out if r["kind"] == "pair" and (r["truncated"] or r["evicted"])}
    short = {k for k in given if size[k] < whole[k]}
    again = {r["src_ip"] for r in out if r["kind"] == "pair" and r["evicted"]}
    assert all(k in told or k[0] in again for k in short) and seen["truncated"] > 0


def test_full_limits_of_the_component_hold():
    """4,096 sources and 1,000,000 records, as one group's share of them."""
    share = panes.SCAN_LIMITS.shared(panes.GROUPS)
    assert (share.sources * panes.GROUPS, share.rows * panes.GROUPS, share.rows_of_source) == (4096, 1_000_000, 250_000)
    out, sizes = stepped(panes.ScanPanes(30_000_000, 10_000_000, 0, 5, share), micro_batches(busy_records(1000, 40_000), 8))
    assert max(s[0] for s in sizes) <= share.sources and max(s[1] for s in sizes) <= share.rows and counts(out)["sources_evicted"] > 500
    with pytest.raises(ValueError, match="limit"):
        panes.Limits(sources=3).shared(panes.GROUPS)


def test_panes_of_one_group_equal_plain_windows_however_they_come():
    made = busy_records(12, 900)
    made["known_us"] += [random.Random(i).choice([0, 0, 1_500_000, 9_000_000, 30_000_000]) for i in range(len(made))]
    want = defaultdict(list)
    for r in made.itertuples():
        for s in range(r.ts_us // 2_000_000 * 2_000_000 - 8_000_000, r.ts_us + 1, 2_000_000):
            if r.known_us <= s + 13_000_000:
                want[r.src_ip, s].append((r.ts_us, r.dst_ip, r.dst_port))
    plain = {k: (len(v), len({x[1:] for x in v}), max(v)[0] - min(v)[0]) for k, v in want.items() if len(v) >= 3}
    by_known = made.sort_values("known_us")
    for parts in (1, 7, 30):
        ends = [int(by_known["known_us"].iloc[min(len(made) - 1, (k + 1) * len(made) // parts)]) for k in range(parts)]
        batches = [(by_known[(by_known["known_us"] > low) & (by_known["known_us"] <= high)], high // 1000) for low, high in zip([-1, *ends], ends, strict=False)]
        # known by the watermark in whole ms
        out, _ = stepped(panes.ScanPanes(10_000_000, 2_000_000, 3_000_000, 3, panes.Limits()), [*batches, (made[:0], 10**9)])
        got = defaultdict(lambda: [0, 0, 0])
        for r in out:
            if r["kind"] == "pair":
                g = got[r["src_ip"], r["start_us"]]
                got[r["src_ip"], r["start_us"]] = [g[0] + r["c"], g[1] + 1, max(g[2], r["max_us"] - r["min_us"])]
        assert {k: tuple(v) for k, v in got.items()} == plain
        seen = counts(out)
        assert seen["late"] == sum((r.ts_us // 2_000_000 * 2_000_000) + 13_000_000 < r.known_us for r in made.itertuples())
        assert sum(r["n"] for r in out if r["kind"] == "late") == seen["late"] > 0


def test_a_batch_is_written_once(spark, tmp_path):
    folder, df = str(tmp_path / "table"), spark.range(5)
    assert sinks.write_once(df, folder, 0) and not sinks.write_once(spark.range(9), folder, 0)
    df.write.parquet(f"{folder}/_batch-1")  # cut off before its rename
    assert spark.read.parquet(folder).count() == 5
    assert sinks.write_once(df, folder, 1) and spark.read.parquet(folder).count() == 10
    assert sinks.written(spark, folder, 1, df.schema).count() == 5 and sinks.written(spark, folder, 7, df.schema).count() == 0
    sinks.forget(spark, folder, 0)
    assert spark.read.parquet(folder).count() == 5
