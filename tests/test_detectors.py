"""Scenarios with known outcomes."""

from __future__ import annotations

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from trafficlens.functions import domains as D
from trafficlens.operators import beacons, connections, detect, domains, flows, portscan, serving, training, units
from trafficlens.plans import live
from trafficlens.sources import synthetic


def one(df):
    out = df.collect()
    assert len(out) == 1
    return out[0]


def floods(packets):
    return detect.flood_decisions(detect.destination_load(flows.assembled(packets)))


def test_syn_flood_is_critical(spark):
    r = one(floods(synthetic.flood(spark, 2500)))
    assert (r["is_flood"], r["confidence"], r["severity"], r["flows"]) == (True, 0.99, "CRITICAL", 2500)


def test_connection_flood_on_one_port(spark):
    r = one(floods(synthetic.flood(spark, 400)))
    assert r["is_flood"] and r["severity"] == "MEDIUM" and 0.90 < r["confidence"] < 0.91


def test_small_flood_is_none(spark):
    assert not one(floods(synthetic.flood(spark, 150)))["is_flood"]


def test_scan_is_claimed_not_flooded(spark):
    r = one(floods(synthetic.scan(spark, 60, answered=False)))
    assert r["scan_shaped"] and not r["is_flood"]


def test_upload_is_exfiltration_only(spark):
    packets = synthetic.upload(spark)
    assert not one(floods(packets))["is_flood"]
    r = one(detect.exfiltration_decisions(flows.assembled(packets)))
    assert r["is_exfiltration"] and r["severity"] == "CRITICAL" and r["confidence"] == 0.995


def test_encrypted_sessions_claim_their_server(spark):
    packets = synthetic.sessions(spark)
    f = flows.assembled(packets)
    s = detect.encrypted_sessions(f)
    r = one(s)
    assert r["is_encrypted_malware"] and r["sessions"] == 3 and r["psh_per_session"] == 5
    assert one(detect.encrypted_session_alerts(s))["severity"] == "HIGH"
    claimed = detect.claims(detect.flood_decisions(detect.destination_load(f)), s).collect()
    assert [(c["kind"], c["ip"]) for c in claimed] == [("dst", "203.0.113.44")]


def beacon_scores(packets):
    f = flows.assembled(packets)
    starts = beacons.qualified_starts(beacons.connection_starts(packets), beacons.endpoint_summary(f))
    return beacons.beacon_scores(starts.withColumn("ts", F.col("timestamp_us") / 1e6))


def test_perfect_beacon(spark):
    r = one(beacon_scores(synthetic.beacon(spark)))
    assert r["is_beacon"] and r["beacon_count"] == 8 and r["cv"] == 0
    assert r["confidence"] == pytest.approx(0.70 + 0.29 * (0.6 + 0.4 * 7 / 20))


def test_jittery_beacon_is_none(spark):
    wild = synthetic.beacon(spark, 12, 8_000_000, jitter_us=200_000_000)
    assert not any(r["is_beacon"] for r in beacon_scores(wild).collect())


def test_beacon_to_a_claimed_server_is_suppressed(spark):
    starts = beacons.connection_starts(synthetic.beacon(spark))
    claimed = starts.select("window_us", F.lit("dst").alias("kind"), F.col("dst_ip").alias("ip")).distinct()
    assert detect.unclaimed(starts, claimed).count() == 0


def test_live_plan_gives_each_attack_its_class(spark):
    parts = [synthetic.flood(spark, 2500), synthetic.scan(spark, 60, answered=False), synthetic.upload(spark), synthetic.beacon(spark), synthetic.sessions(spark)]
    packets = parts[0]
    for p in parts[1:]:
        packets = packets.unionByName(p)
    model = training.scan_detector(spark, 10, 2, trees=5, depth=3, folds=2)
    name = lambda r: (r["threat_class"], r["src_ip"] if r["threat_class"] != "DDoS" else r["dst_ip"])
    found = {name(r) for r in live.alerts(packets, scan_model=model).collect()}
    assert "PortScan" not in {r["threat_class"] for r in live.alerts(packets).collect()}  # nobody scores scans without a model
    assert {("DDoS", "10.9.9.9"), ("PortScan", "10.7.7.7"), ("DataExfiltration", "10.1.1.1"), ("C2_BEACONING", "10.2.2.2"), ("EncryptedMalware", "10.3.3.3")} <= found
    assert not any(k == "C2_BEACONING" and ip != "10.2.2.2" for k, ip in found)


def test_flow_models_in_the_live_plan(spark):
    fitted = {kind: training.flow_detector(spark, kind, trees=5, depth=3, folds=2) for kind in training.VECTORS}
    kinds = {}
    for kind in fitted:
        packets = synthetic.labelled_packets(spark, kind, 20, 20, first=90_000)
        found = live.alerts(packets, flow_models=fitted).where(F.col("threat_class") == kind).select("flow_id", "src_ip").collect()
        kinds[kind] = {r["src_ip"].split(".")[1] for r in found}
        attacks = {r["src_ip"] for r in found if r["src_ip"].startswith("10.51.")}
        assert len(attacks) > 10 >= len({r["src_ip"] for r in found} - attacks), kind
    multicast = flows.assembled(packets_of(spark, *((i, ("10.0.0.1", 5000, ip, 81), {"ack"}) for i, ip in enumerate(("224.0.0.1", "239.1.1.1", "255.255.255.255", "ff02::1", "10.0.0.2")))))
    assert [r["dst_ip"] for r in multicast.where(flows.to_one_host()).collect()] == ["10.0.0.2"]


def packets_of(spark, *events):
    names = "timestamp_us seq src_ip src_port dst_ip dst_port protocol packet_len syn ack rst fin psh".split()
    full = [(t, i, *ends, 6, 60, *(f in flags for f in ("syn", "ack", "rst", "fin", "psh"))) for i, (t, ends, flags) in enumerate(events)]
    return spark.createDataFrame(full, names)


OUT, BACK = ("10.0.0.1", 5000, "10.0.0.2", 81), ("10.0.0.2", 81, "10.0.0.1", 5000)


@pytest.mark.parametrize(
    ("events", "state", "history"),
    [
        ([(0, OUT, {"syn"}), (10, OUT, {"rst"})], "REJ", "-"),
        ([(0, OUT, {"syn"}), (10, BACK, {"rst", "ack"})], "OTH", "-"),  # an answer, and no reset of its own
        ([(0, OUT, {"syn"})], "S0", "S"),
        ([(0, OUT, {"syn"}), (3_000_000, OUT, {"syn"})], "S0", "-"),
        ([(0, OUT, {"syn"}), (10, BACK, {"syn", "ack"}), (20, OUT, {"ack", "fin"})], "SF", "-"),
        ([(0, OUT, {"syn"}), (10, BACK, {"syn", "ack"}), (20, OUT, {"rst"})], "RSTO", "-"),
        ([(0, OUT, {"syn"}), (10, BACK, {"syn", "ack"})], "OTH", "-"),
    ],
)
def test_connection_states(spark, events, state, history):
    r = one(connections.tcp_records(packets_of(spark, *events)))
    assert (r["conn_state"], r["history"], r["src_ip"], r["dst_port"]) == (state, history, "10.0.0.1", "81")


def plain_records(packets):
    """Packet by packet: (key, first, last, own packets, responses, SYN, RST, FIN) of every record."""
    open_, out = {}, []

    def idle(c):
        return 3_000_000 if c["syn"] and not c["resp"] else 30_000_000

    def emit(key):
        c = open_.pop(key)
        out.append((key, c["first"], c["last"], c["orig"], c["resp"], c["syn"], c["rst"], c["fin"]))

    for t, (src, sport, dst, dport), flags in packets:
        for key in [k for k, c in open_.items() if t - c["last"] > idle(c)]:
            emit(key)
        key, peer = (src, dst, dport), (dst, src, sport)
        reply = not ("syn" in flags and "ack" not in flags) and (sport < 1024 or sport in (1433, 3389, 8080, 8443)) and dport > 1024
        if key in open_ or not reply:
            c = open_.setdefault(key, {"first": t, "last": t, "orig": 0, "resp": 0, "syn": False, "rst": False, "fin": False})
            c["last"], c["orig"] = t, c["orig"] + 1
            c["syn"] |= "syn" in flags and not reply
            c["rst"] |= "rst" in flags
            c["fin"] |= "fin" in flags
        if peer in open_:
            open_[peer]["resp"] += 1
        if key in open_ and flags & {"rst", "fin"}:
            emit(key)
    for key in list(open_):
        emit(key)
    return sorted(out)


def random_packets(seed, n=600):
    rng, t, out = random.Random(seed), 0, []
    ends = [(a, p, b, q) for a, b in (("10.0.0.1", "10.0.0.2"), ("10.0.0.2", "10.0.0.3")) for p in (5000, 20) for q in (81, 443, 9001, 6000)]
    for _ in range(n):
        t += rng.choice([1, 400_000, 1_000_000, 2_900_000, 3_000_000, 3_100_000, 8_000_000, 29_000_000, 31_000_000]) // rng.choice([1, 1, 4])
        a, p, b, q = rng.choice(ends)
        way = (a, p, b, q) if rng.random() < 0.6 else (b, q, a, p)
        out.append((t, way, set(rng.choice(["syn", "syn", "syn ack", "ack", "ack", "ack psh", "rst ack", "fin ack"]).split())))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_connections_equal_plain(spark, seed):
    packets = random_packets(seed)
    got = connections.tcp_records(packets_of(spark, *packets)).collect()
    want = plain_records(packets)
    assert sorted(((r["src_ip"], r["dst_ip"], int(r["dst_port"])), r["ts_us"], r["ts_us"] + round(r["duration"] * 1e6), r["orig_pkts"], r["resp_pkts"]) for r in got) == [w[:5] for w in want]
    state = lambda resp, syn, rst, fin: ("REJ" if rst else "S0") if syn and not resp else "RSTO" if resp and rst else "SF" if resp and fin else "OTH"
    assert sorted((r["src_ip"], r["dst_ip"], int(r["dst_port"]), r["ts_us"], r["conn_state"]) for r in got) == [(*w[0], w[1], state(*w[4:])) for w in want]


def test_a_pause_splits_a_connection(spark):
    assert connections.tcp_records(packets_of(spark, (0, OUT, {"syn"}), (40_000_000, OUT, {"syn"}))).count() == 2


def test_gaps_are_directional_and_positive(spark):
    f = one(flows.assembled(packets_of(spark, (0, OUT, {"syn"}), (0, OUT, {"ack"}), (1_000_000, BACK, {"ack"}), (3_000_000, OUT, {"ack"}), (3_500_000, BACK, {"ack"}))))
    assert (f["fwd_gaps"], f["fwd_gap_mean"], f["bwd_gaps"], f["bwd_gap_mean"]) == (1, 3.0, 1, 2.5)


def test_encrypted_vector_abstains(spark):
    f = flows.assembled(synthetic.upload(spark))
    assert flows.encrypted_vector(f).count() == 0 and flows.encrypted_vector(f, abstain=False).count() == 1


def test_few_connections_are_no_window(spark):
    one_s = [(i * 1_000_000, "10.0.0.1", "10.0.0.2", str(i), "S0", 0.0, 1.0, 0.0, "S") for i in range(4)]
    names = "ts_us src_ip dst_ip dst_port conn_state duration orig_pkts resp_pkts history".split()
    assert portscan.window_features(spark.createDataFrame(one_s, names)).count() == 0
    five = spark.createDataFrame([*one_s, (4_000_000, "10.0.0.1", "10.0.0.2", "9", "REJ", 0.0, 1.0, 0.0, "-")], names)
    r = portscan.window_features(five, 30, 30).collect()[0]
    assert (r["unique_dst_ports"], r["failed_conn_ratio"], r["syn_only_ratio"], r["iat_cv"]) == (5, 1.0, 0.8, 0.0)


def unit_rows(spark, *rows):
    return units.prepared(spark.createDataFrame(rows, "ts_us long, orig_h string, resp_h string, resp_p string, proto string, orig_pkts long, resp_pkts long, duration double, local_orig boolean"))


def test_one_flow_unit_has_nulls(spark):
    r = one(units.unit_features(unit_rows(spark, (5_000_000, "a", "b", "bad", " TCP ", 3, 1, 0.5, None)), 60))
    assert (r["resp_p"], r["proto"], r["n_flows"], r["dst_recurrence"], r["mean_pkts"]) == (-1, "tcp", 1, 0.1, 4.0)
    assert all(r[c] is None for c in ("iat_mean", "iat_cov", "iat_madn", "dur_cov", "pkts_cov"))


def test_external_flows_go_and_unknown_stay(spark):
    rows = unit_rows(spark, (0, "a", "b", "1", "tcp", 1, 1, 0.0, False), (1, "a", "b", "1", "tcp", 1, 1, 0.0, True), (2, "a", "b", "1", "", 1, 1, 0.0, None))
    assert sorted(r["proto"] for r in rows.collect()) == ["tcp", "unknown"]


def test_sliding_units_start_at_the_origin(spark):
    rows = unit_rows(spark, *((3_000_000 + i * 5_000_000, "a", "b", "1", "tcp", 1, 1, 0.0, None) for i in range(20)))
    origin = units.origin_us(rows)
    starts = [r["start_us"] for r in units.unit_features(rows, 60, 10, origin).collect()]
    assert min(starts) == origin == 3_000_000 and all((s - origin) % 10_000_000 == 0 for s in starts)
    assert {r["detector_id"] for r in units.both_timescales(rows).select("detector_id").distinct().collect()} == {"fast", "deep"}


def test_medians_of_a_busy_unit_are_exact_and_keep_no_list(spark):
    """60,000 flows of one unit in a window, many at the same time, beside a unit of two and one of three flows."""
    rng = random.Random(7)
    times = {"busy": [rng.randrange(60_000_000) if rng.random() < 0.7 else 1_000_000 * rng.randrange(60) for _ in range(60_000)], "two": [5, 1_000_000], "three": [0, 10, 31]}
    rows = spark.createDataFrame([(t, host) for host, ts in times.items() for t in ts], "ts_us long, orig_h string").select(
        "*", F.lit("b").alias("resp_h"), F.lit("1").alias("resp_p"), F.lit("tcp").alias("proto"), F.lit(1).alias("orig_pkts"), F.lit(1).alias("resp_pkts"), F.lit(0.0).alias("duration")
    )
    out = units.unit_features(units.prepared(rows), 60)
    got = {r["orig_h"]: (r["n_flows"], r["iat_madn"]) for r in out.collect()}
    for host, ts in times.items():
        ts = sorted(ts)
        gaps = [b - a for a, b in zip(ts, ts[1:], strict=False)]
        middle = median(gaps)
        want = median(abs(g - middle) for g in gaps) / middle if len(gaps) > 1 and middle else None
        assert got[host] == (len(ts), want if want is None else pytest.approx(want, abs=1e-6))
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_domain_statistics(spark):
    df = spark.createDataFrame([("Xkcd-99q.Example.com",), ("",), ("a",)], "domain string")
    r = df.select("domain", *(c.alias(n) for n, c in D.statistics(F.col("domain")).items())).collect()
    x = next(v for v in r if v["domain"].startswith("X"))
    assert (x["sld_length"], x["num_dots"], x["max_consonant_run"], x["popular_tld"], x["hyphen_ratio"]) == (8, 2, 4, 1.0, 1 / 8)
    assert x["digit_alpha_transitions"] == pytest.approx(2 / 7) and len(D.statistics(F.col("domain"))) == 19
    assert next(v for v in r if v["domain"] == "")["entropy"] == 0


@pytest.mark.parametrize(("name", "local"), [("x._spotify-connect.example", True), ("Printer.LAN", True), ("_x.y", True), ("4.3.2.1.in-addr.arpa", True), ("example.com", False), ("localhost.com", False)])
def test_local_lookups(spark, name, local):
    assert spark.createDataFrame([(name,)], "d string").select(D.is_local_lookup(F.col("d"))).first()[0] is local


@pytest.mark.parametrize(("name", "safe"), [("e1.akamaiedge.net", True), ("_x._tcp.local", True), ("api.zoom.us", True), ("zoom.us", True), ("kq9x.info", False), ("notzoom.us", False)])
def test_safe_domains(spark, name, safe):
    assert spark.createDataFrame([(name,)], "d string").select(D.is_safe(F.col("d"))).first()[0] is safe


def test_dns_answers_and_safe_names_are_not_scored(spark):
    rows = [("x.info", "a", "b", 1, 5353, 53), ("x.info", "b", "a", 1, 53, 5353), ("printer.local", "a", "b", 1, 5353, 53), (None, "a", "b", 1, 5353, 53)]
    df = spark.createDataFrame(rows, "dns_query string, src_ip string, dst_ip string, timestamp_us long, src_port int, dst_port int")
    assert [r["src_ip"] for r in domains.dns_queries(df).collect()] == ["a"]


def test_serving_guards_and_texts(spark):
    a = spark.createDataFrame([("1", 0, "DDoS", 0.9, "LOW", "s", "d", 0, 1, 1)], "alert_id string, ts_us long, threat_class string, confidence double, severity string, src_ip string, dst_ip string, src_port int, dst_port int, seq long")
    with pytest.raises(ValueError):
        serving.page(a, 0)
    assert serving.page(a)[1].first()["total"] == 1
    assert serving.filter_summary("DDoS", "HIGH") == "Type: Denial-of-service flood · Severity: High" and serving.filter_summary() == "All threats"
    assert a.select(serving.uptime(F.lit(11220))).first()[0] == "3h 07m"
    assert [r[0] for r in spark.createDataFrame([(5,), (12345,), (2_500_000,)], "n long").select(serving.compact(F.col("n"))).collect()] == ["5", "12.3K", "2.5M"]
    assert serving.described(a.withColumn("threat_class", F.lit("Odd"))).first()["code"] == "?"
    ticks = spark.createDataFrame([(1, 5), (2, 9), (3, 4)], "tick int, total int")
    assert [r["delta"] for r in serving.rate_deltas(ticks).orderBy("tick").collect()] == [5, 4, 0]
    name, best = detect.arbitrated({"DDoS": F.lit(0.2), "DGA": F.lit(0.7)})
    assert tuple(a.select(name, best).first()) == ("DGA", 0.7)


def test_percentiles_and_thresholds_equal_plain(spark):
    rng = random.Random(8)
    data = [(rng.choice([rng.gauss(0, 1), 0.25, 0.5]), int(rng.random() < 0.4)) for _ in range(4000)]
    df = spark.createDataFrame(data, "score double, label int")
    r = serving.latency_percentiles(df, "score").first()
    v = sorted(x for x, _ in data)
    for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        at = p * (len(v) - 1)
        low = int(at)
        assert r[name] == pytest.approx(v[low] + (at - low) * (v[min(low + 1, len(v) - 1)] - v[low]), abs=2e-6)
    assert r["max"] == pytest.approx(v[-1], abs=1e-6) and r["mean"] == pytest.approx(sum(v) / len(v), abs=1e-6)
    best = serving.best_threshold(df).first()
    total = sum(y for _, y in data)
    f1 = {t: 2 * sum(y for x, y in data if x >= t) / (sum(x >= t for x, _ in data) + total) for t in {*v[:50], *v[-50:], 0.25, 0.5, best["threshold"]}}
    assert best["f1"] == pytest.approx(f1[best["threshold"]], abs=1e-6) and best["f1"] >= max(f1.values()) - 1e-6
    assert serving.latency_percentiles(df.where("score = 0.25"), "score").first()["p95"] == 0.25
    assert serving.best_threshold(df.where("false")).count() == 0


def test_runs_of_seconds_and_the_bounded_store(spark):
    arrivals = [(0, 5), (1, 5), (2, 6), (3, 5), (4, 7), (5, 7)]
    a = spark.createDataFrame([(i, s * 1_000_000, "DDoS" if i % 2 else "DGA") for i, s in arrivals], "seq long, ts_us long, threat_class string")
    got = [(r["second"], r["total"], r["ddos"]) for r in serving.second_groups(a, 10_000_000).collect()]
    assert got == [(7, 2, 1), (5, 1, 1), (6, 1, 0), (5, 2, 1)]
    assert [r["second"] for r in serving.second_groups(a, 10_000_000, slots=2).collect()] == [7, 5]
    assert tuple(serving.peak_and_last(serving.second_slots(a, 10_000_000)).first()) == (3, 2)
    assert [r["seq"] for r in serving.newest_stored(a, 2).collect()] == [5, 4]
