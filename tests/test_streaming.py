"""Streams give what batches give."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from tests.conftest import SF_DIR, rows
from tests.test_detectors import packets_of, random_packets
from trafficlens import views
from trafficlens.operators import beacons, connections, flows, portscan, training, units
from trafficlens.plans import live
from trafficlens.sources import synthetic
from trafficlens.streaming import state, windows


def streamed(spark, tmp_path, df, order, parts=3):
    """A file stream of ``df`` in time order, one file a micro-batch."""
    src = str(tmp_path / "in")
    bounds = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.0)
    low = None
    for high in [*bounds, None]:
        part = df if low is None else df.where(F.col(order) > low)
        part = part if high is None else part.where(F.col(order) <= high)
        part.coalesce(1).write.mode("append").parquet(src)
        low = high
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)


def collected(stream, tmp_path, make):
    got = []
    q = windows.each_batch(stream, lambda batch, _: got.extend(make(batch).collect()), str(tmp_path / "check"), once=True)
    q.awaitTermination()
    return got, q


def test_scan_windows_equal_batch_up_to_the_watermark(spark, tmp_path):
    rows_ = views.connections(spark, SF_DIR).drop("seq")
    stream = streamed(spark, tmp_path, rows_, "ts_us")
    got, q = collected(windows.closed_scan_windows(stream, lateness_s=0), tmp_path, windows.scan_features)
    batch = {(r["src_ip"], r["start_us"]): r for r in portscan.window_features(rows_).collect()}
    assert got and all(all(r[c] == batch[r["src_ip"], r["start_us"]][c] for c in portscan.FEATURES) for r in got)
    last = rows_.agg(F.max("ts_us")).first()[0]
    assert {k for k in batch if k[1] + 30_000_000 <= last} == {(r["src_ip"], r["start_us"]) for r in got}
    assert windows.late_rows(q) == 0 and not any(r["truncated"] for r in got)


def test_units_equal_batch_up_to_the_watermark(spark, tmp_path):
    prepared = units.prepared(views.c2_flows(spark, SF_DIR)).drop("seq")
    origin = units.origin_us(prepared)
    stream = streamed(spark, tmp_path, prepared, "ts_us")
    got, _ = collected(windows.closed_unit_windows(stream, 300, 60, origin_us=origin), tmp_path, lambda b: windows.unit_features(b, 300))
    batch = {tuple(r[c] for c in units.UNIT): r for r in units.unit_features(prepared, 300, 60, origin).collect()}
    assert got and all(all(r[c] == batch[tuple(r[k] for k in units.UNIT)][c] for c in units.EXTENDED) for r in got)


def test_flows_equal_batch_up_to_the_watermark(spark, tmp_path):
    made = views.packets(spark, SF_DIR)
    stream = streamed(spark, tmp_path, made, "timestamp_us")
    got, _ = collected(windows.closed_flow_windows(stream, lateness_s=0), tmp_path, windows.flows)
    batch = {(r["window_us"], r["flow_key"]): r for r in flows.assembled(made).collect()}
    assert got and all(r.asDict() == batch[r["window_us"], r["flow_key"]].asDict() for r in got)


def test_tick_closes_the_tail(spark, tmp_path):
    """After a row far ahead, a stream has given every window of the batch."""
    rows_ = views.connections(spark, SF_DIR).drop("seq")
    end = rows_.agg(F.max("ts_us")).first()[0]
    made = rows_.unionByName(windows.tick_row(spark, rows_.schema, end + 10**10))
    got, _ = collected(windows.closed_scan_windows(streamed(spark, tmp_path, made, "ts_us"), lateness_s=60), tmp_path, windows.scan_features)
    assert {(r["src_ip"], r["start_us"]) for r in got} == {(r["src_ip"], r["start_us"]) for r in portscan.window_features(rows_).collect()}


def test_scan_stream_alerts_like_the_batch(spark, tmp_path):
    model = training.scan_detector(spark, 10, 2, trees=5, depth=3, folds=2)
    made = synthetic.labelled_connections(spark, 20, 10, first=70_000)
    stream = streamed(spark, tmp_path, made.drop("label").unionByName(windows.tick_row(spark, made.drop("label").schema, 10**10)), "ts_us")
    got = []
    live.scan_stream(stream, model, lambda batch, _: got.extend(batch.collect()), str(tmp_path / "check"), once=True).awaitTermination()
    batch = portscan.scan_decisions(model.score(portscan.scan_candidates(portscan.window_features(made.drop("label"), 10, 2))))
    key = lambda r: (r["src_ip"], r["confidence"])
    assert got and sorted(map(key, got)) == sorted(map(key, portscan.component_alerts(batch, "x").collect()))


def _bounded(spark, tmp_path, rows_, most):
    end = rows_.agg(F.max("ts_us")).first()[0]
    made = rows_.unionByName(windows.tick_row(spark, rows_.schema, end + 10**10))
    got, _ = collected(state.bounded_scan_windows(streamed(spark, tmp_path, made, "ts_us"), lateness_s=0, most_rows=most), tmp_path, lambda b: b)
    return [r for r in got if r["src_ip"] is not None]


def test_bounded_windows_equal_batch(spark, tmp_path):
    rows_ = views.connections(spark, SF_DIR).drop("seq")
    got = spark.createDataFrame(_bounded(spark, tmp_path, rows_, 10_000))
    assert got.where("truncated").count() == 0
    features = {(r["src_ip"], r["start_us"]): r for r in portscan.features(got.drop("truncated"), 30).collect()}
    batch = {(r["src_ip"], r["start_us"]): r for r in portscan.window_features(rows_).collect()}
    assert features.keys() == batch.keys() and all(features[k][c] == batch[k][c] for k in batch for c in portscan.FEATURES)


def test_bounded_windows_refuse_rows_and_say_so(spark, tmp_path):
    rows_ = views.connections(spark, SF_DIR).drop("seq")
    got = _bounded(spark, tmp_path, rows_, 8)
    sizes = Counter((r["src_ip"], r["start_us"]) for r in got)
    whole = Counter((r["src_ip"], r["start_us"]) for r in portscan.dealt(rows_, 30, 10).select("src_ip", "start_us").collect())
    cut = {(r["src_ip"], r["start_us"]) for r in got if r["truncated"]}
    assert cut and max(sizes.values()) <= 8 and all(k in cut for k, n in sizes.items() if n < whole[k])


def plain_lateness(rows_, window, stride, allowance):
    newest, out = None, []
    for src, ts in rows_:
        mark = None if newest is None else newest - allowance
        starts = [s for s in range(ts // stride * stride - window, ts + 1, stride) if s % stride == 0 and s <= ts < s + window]
        closed = [mark is not None and s + window <= mark for s in starts]
        out.append((src, all(closed), any(closed) and not all(closed), 0 if newest is None else max(0, newest - ts)))
        newest = ts if newest is None else max(newest, ts)
    return out


def test_lateness_equals_plain(spark):
    rng = random.Random(2)
    rows_ = [(f"s{rng.randint(0, 9)}", 1_000_000 * (i // 3) - rng.choice([0, 0, 0, 5, 40, 90, 200]) * 1_000_000 + 10**9) for i in range(900)]
    df = spark.createDataFrame([(s, t, i) for i, (s, t) in enumerate(rows_)], "src_ip string, ts_us long, seq long")
    want = plain_lateness(rows_, 30_000_000, 10_000_000, 60_000_000)
    r = windows.lateness(df, 30, 10, 60).first()
    assert (r["rows"], r["late"], r["partly_late"], r["sources"]) == (900, sum(w[1] for w in want), sum(w[2] for w in want), 10) and r["late"] and r["partly_late"]
    assert r["worst_behind_s"] == max(w[3] for w in want) / 1e6
    top = Counter(w[0] for w in want if w[1])
    assert [tuple(x) for x in windows.late_sources(df, 30, 10, 60).collect()] == sorted(top.items(), key=lambda x: (-x[1], x[0]))[:5]
    health = windows.window_health(df, 30, 10, min_flows=3, most_rows=6).first()
    sizes = Counter((s, k) for s, t in rows_ for k in range(t // 10**7 - 2, t // 10**7 + 1))
    assert tuple(health) == (sum(n >= 3 for n in sizes.values()), sum(n < 3 for n in sizes.values()), sum(n > 6 for n in sizes.values()))


def test_cut_windows_say_so(spark, tmp_path):
    stream = streamed(spark, tmp_path, views.connections(spark, SF_DIR).drop("seq"), "ts_us")
    got, _ = collected(windows.closed_scan_windows(stream, lateness_s=0, most_rows=6), tmp_path, windows.scan_features)
    assert any(r["truncated"] for r in got) and max(r["connection_attempts"] for r in got) == 6


def test_connection_stream(spark, tmp_path):
    made = synthetic.scan(spark, 30, start_us=1_000_000).unionByName(synthetic.beacon(spark, 6, start_us=1_000_000))
    late = synthetic.flood(spark, 1, start_us=200_000_000, span_us=1)
    stream = streamed(spark, tmp_path, made.unionByName(late), "timestamp_us", 2)
    got, _ = collected(state.connection_records(stream), tmp_path, lambda b: b)
    names = ["src_ip", "dst_ip", "dst_port", "conn_state", "orig_pkts", "resp_pkts", "history", "ts_us"]
    batch = connections.tcp_records(made).select(names).toPandas()
    got = spark.createDataFrame(got).select(names).toPandas()
    assert rows(got) == rows(batch)


def test_connection_stream_equals_batch(spark, tmp_path):
    made = packets_of(spark, *random_packets(9, 300))
    end = made.agg(F.max("timestamp_us")).first()[0] + 100_000_000
    late = packets_of(spark, (end, ("10.9.9.1", 1, "10.9.9.2", 2), {"syn"}))
    stream = streamed(spark, tmp_path, made.unionByName(late), "timestamp_us", 3)
    got, _ = collected(state.connection_records(stream), tmp_path, lambda b: b)
    names = ["src_ip", "dst_ip", "dst_port", "conn_state", "orig_pkts", "resp_pkts", "history", "ts_us", "duration"]
    assert rows(spark.createDataFrame(got).select(names).toPandas()) == rows(connections.tcp_records(made).select(names).toPandas())


def test_flush_ends_unanswered_records(spark, tmp_path):
    """At the boundary of 10 s: an unanswered record of over 1 s and an idle one end, a young and a busy one don't."""
    out = lambda i: (f"10.0.0.{i}", 5000, "10.0.0.9", 81)
    back = lambda i: ("10.0.0.9", 81, f"10.0.0.{i}", 5000)
    events = [(8_000_000, out(1), {"syn"}), (9_500_000, out(2), {"syn"}), (5_000_000, out(3), {"syn"}), (5_100_000, back(3), {"syn", "ack"}), (9_000_000, out(4), {"syn"}), (9_100_000, back(4), {"ack"})]
    events += [(11_000_000, out(i), {"ack"}) for i in (1, 2, 3, 4)]
    made = packets_of(spark, *sorted(events, key=lambda e: e[0]), (500_000_000, ("10.9.9.1", 1, "10.9.9.2", 2), {"syn"}))
    got, _ = collected(state.connection_records(streamed(spark, tmp_path, made, "timestamp_us", 2), flush_us=10_000_000), tmp_path, lambda b: b)
    assert sorted((r["src_ip"][-1], r["ts_us"], r["orig_pkts"]) for r in got if r["src_ip"] < "10.0.0.5") == [
        ("1", 8_000_000, 1.0), ("1", 11_000_000, 1.0), ("2", 9_500_000, 2.0), ("3", 5_000_000, 1.0), ("3", 11_000_000, 1.0), ("4", 9_000_000, 2.0)
    ]


def test_beacon_history_stream(spark, tmp_path):
    packets = synthetic.beacon(spark, 12, start_us=1_000_000)
    starts = beacons.qualified_starts(beacons.connection_starts(packets), beacons.endpoint_summary(flows.assembled(packets)))
    stream = streamed(spark, tmp_path, starts, "timestamp_us", 2)
    got, _ = collected(state.beacon_histories(stream), tmp_path, lambda b: b)
    last = max(got, key=lambda r: len(r["times"]))
    assert len(last["times"]) == 12
    scored = beacons.beacon_scores(state.history_events(spark.createDataFrame([last])))
    batch = beacons.beacon_scores(starts.withColumn("ts", F.col("timestamp_us") / 1e6))
    pick = lambda df: tuple(df.select("beacon_count", "is_beacon", "total_bytes", F.round("confidence", 9)).first())
    assert pick(scored) == pick(batch) and pick(scored)[1]
