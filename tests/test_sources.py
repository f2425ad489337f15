"""Readers and writers."""

from __future__ import annotations

import json
import struct

import pytest
from pyspark.sql import functions as F

from trafficlens.sources import captures, dispatch, packets, pcap, sinks, synthetic, training_files, tshark, zeek

FIELDS = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "duration", "orig_pkts", "resp_pkts", "conn_state", "history", "local_orig"]
VALUES = ["1700000000.123456", "C1", "10.0.0.1", "5000", "10.0.0.2", "443", "TCP", "0.000702", "3", "2", "SF", "ShA", "T"]


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def header():
    return ["#separator \\x09", "\t".join(["#fields", *FIELDS])]


def test_tsv_equals_json(spark, tmp_path):
    tsv = write(tmp_path / "conn.log", *header(), "\t".join(VALUES))
    record = dict(zip(FIELDS, VALUES, strict=True)) | {"ts": 1700000000.123456, "duration": 0.000701904296875, "orig_pkts": 3, "resp_pkts": 2, "id.resp_p": 443}
    js = write(tmp_path / "conn.json", json.dumps(record))
    assert zeek.sniff(spark, tsv) == "tsv" and zeek.sniff(spark, js) == "json"
    a, b = (zeek.conn_log(spark, p)[0].collect() for p in (tsv, js))
    assert a == b and a[0]["duration"] == 0.000702 and a[0]["ts_us"] == 1700000000123456


def test_dirty_log(spark, tmp_path):
    bad = [*VALUES]
    bad[7], bad[8], bad[10] = "-", "(empty)", ""
    path = write(tmp_path / "conn.log", *header(), "\t".join(VALUES), "\t".join(bad), "cut\tline", "#close")
    records, rejected = zeek.conn_log(spark, path)
    quality = zeek.data_quality(records, rejected).first()
    assert tuple(quality) == (2, 1, 2, 1)
    assert sorted((r["duration"], r["conn_state"]) for r in records.collect()) == [(0.0, "-"), (0.000702, "SF")]


def test_log_contract(spark, tmp_path):
    with pytest.raises(ValueError, match="#fields"):
        zeek.read_tsv(spark, write(tmp_path / "a.log", "1\t2"))
    with pytest.raises(ValueError, match="history"):
        zeek.read_tsv(spark, write(tmp_path / "b.log", "\t".join(["#fields", *(f for f in FIELDS if f != "history")])))


def test_c2_normalisers(spark, tmp_path):
    raw, _ = zeek.read_tsv(spark, write(tmp_path / "c.log", *header(), "\t".join(VALUES)), required=())
    r = zeek.c2_flows(raw).first()
    assert (r["proto"], r["local_orig"], r["resp_p"], r["orig_pkts"], r["uid"]) == ("tcp", True, 443, 3.0, "C1")
    flow = spark.createDataFrame([("1700000000.5", "a", "b", "53", "UDP", "2", "x")], "ts string, SrcAddr string, DstAddr string, Dport string, Proto string, SrcPkts string, DstPkts string")
    r = zeek.binetflow(flow).first()
    assert (r["ts_us"], r["proto"], r["orig_pkts"], r["resp_pkts"], r["local_orig"]) == (1700000000500000, "udp", 2.0, 0.0, None)


def frame(src, dst, sport, dport, flags=0x02, payload=b""):
    tcp = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, flags, 0, 0, 0) + payload
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0, bytes(map(int, src.split("."))), bytes(map(int, dst.split("."))))
    return bytes(12) + b"\x08\x00" + ip + tcp


def dns_frame(name):
    question = b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\x00\x00\x01\x00\x01"
    message = struct.pack(">HHHHHH", 1, 0x0100, 1, 0, 0, 0) + question
    udp = struct.pack(">HHHH", 5353, 53, 8 + len(message), 0) + message
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(udp), 0, 0, 64, 17, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 53]))
    return bytes(12) + b"\x08\x00" + ip + udp


def capture(frames):
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for us, f in frames:
        out += struct.pack("<IIII", us // 1_000_000, us % 1_000_000, len(f), len(f)) + f
    return out


def test_captures(spark, tmp_path):
    frames = [(1_000_001, frame("10.0.0.1", "10.0.0.2", 5000, 81)), (2_000_000, dns_frame("kq9x.example.info")), (3_000_000, b"\x00" * 14)]
    (tmp_path / "b.PCAP").write_bytes(capture(frames) + b"cut")
    (tmp_path / "other.txt").write_bytes(b"no")
    got = {r["timestamp_us"]: r for r in captures.read(spark, str(tmp_path)).collect()}
    assert set(got) == {1_000_001, 2_000_000}
    assert got[1_000_001]["syn"] and got[1_000_001]["dst_port"] == 81 and got[1_000_001]["payload_len"] == 0
    assert got[2_000_000]["dns_query"] == "kq9x.example.info" and got[2_000_000]["protocol"] == 17


def test_next_generation_capture():
    f = frame("10.0.0.1", "10.0.0.2", 1, 2)
    pad = bytes(-len(f) % 4)
    section = struct.pack("<IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28)
    interface = struct.pack("<IIHHII", 1, 20, 1, 0, 0, 20)
    size = 32 + len(f) + len(pad)
    packet = struct.pack("<IIIIIII", 6, size, 0, 0, 7, len(f), len(f)) + f + pad + struct.pack("<I", size)
    assert list(pcap.records(section + interface + packet)) == [(7, f)]


def test_tshark_fields(spark, tmp_path):
    lines = ["1.5\t10.0.0.1\t10.0.0.2\t81\t\t0x0002\t6\t5000\t", "1.6\t10.0.0.2\t10.0.0.1\t5000\t\t0x0014\t6\t81\t", "short\tline"]
    path = write(tmp_path / "p.tsv", *lines)
    r = dispatch.open_source(spark, f"tshark:{path}").collect()
    # the reset is the answer of a server, and no reset of the record's own
    assert [(x["conn_state"], x["dst_port"], x["orig_pkts"], x["resp_pkts"]) for x in r] == [("OTH", "81", 1.0, 1.0)]
    assert tshark.read_fields(spark, path).count() == 2


def test_dispatch():
    assert dispatch.split_spec("zeek:/a/b") == ("zeek", "/a/b") and dispatch.split_spec("/x/y.PCAP")[0] == "pcap" and dispatch.split_spec("s3a://b/conn.log") == ("zeek", "s3a://b/conn.log")
    with pytest.raises(ValueError):
        dispatch.open_source(None, "iface:eth0")


def test_packet_json_and_messages(spark, tmp_path):
    made = synthetic.scan(spark, 3)
    messages = sinks.packet_messages(made.withColumn("tcp_flags", F.struct("syn", "ack", "rst", "fin", "psh", "urg")))
    lines = [r["value"] for r in messages.collect()]
    path = write(tmp_path / "p.json", *lines, "{broken", '{"src_ip": "10.0.0.1"}')
    good, bad = packets.read_json(spark, path)
    assert good.count() == 6 and bad.count() == 2 and good.where("syn and not ack").count() == 3
    assert messages.where(F.col("key") == "10.7.7.7:40000-10.9.9.8:20").count() == 1


def test_exports(spark, tmp_path):
    a = spark.createDataFrame([("1", 1_700_000_000_000_000, "DDoS", 0.934, "HIGH", 's "q", x', "d", 0, 80)], "alert_id string, ts_us long, threat_class string, confidence double, severity string, src_ip string, dst_ip string, src_port int, dst_port int")
    r = sinks.report_columns(a).first()
    assert len(r) == 11 and (r["timestamp_utc"], r["threat_type"], r["severity"], r["confidence_pct"], r["source_port"]) == ("2023-11-14 22:13:20 UTC", "Denial-of-service flood", "High", "93.4", None)
    assert len(sinks.ledger_columns(a).columns) == 12
    sinks.write_csv(sinks.report_columns(a), str(tmp_path / "csv"))
    parts = [part.read_text().splitlines() for part in (tmp_path / "csv").glob("*.csv")]  # an empty part has a header alone
    assert all(part[0].startswith("timestamp_utc,") for part in parts) and sum('"s ""q"", x"' in line for part in parts for line in part[1:]) == 1
    observed, seen = sinks.counted(a, "alerts", critical=F.count_if(F.col("severity") == "CRITICAL"))
    sinks.append_alerts(observed, str(tmp_path / "store"))
    assert json.loads(sinks.summary({"alerts": seen})) == {"alerts": {"rows": 1, "critical": 0}}
    sinks.write_json_lines(a, str(tmp_path / "jsonl"))
    assert spark.read.json(str(tmp_path / "jsonl")).count() == 1


def test_each_log_is_read_by_its_own_header(spark, tmp_path):
    fields = list(zeek.REQUIRED)
    for name, order in (("a.log", fields), ("b.log", fields[::-1])):
        values = {f: f"{f}-{name}" for f in fields}
        (tmp_path / name).write_text("#separator \\x09\n#fields\t" + "\t".join(order) + "\n" + "\t".join(values[f] for f in order) + "\nshort\tline\n")
    good, bad = zeek.read_tsv(spark, str(tmp_path))
    assert sorted(r["ts"] for r in good.collect()) == ["ts-a.log", "ts-b.log"] and all(r["history"] == "history" + r["ts"][2:] for r in good.collect()) and bad.count() == 2
    (tmp_path / "c.log").write_text("no\theader\n")
    with pytest.raises(ValueError, match="c.log"):
        zeek.read_tsv(spark, str(tmp_path))


def test_training_files(spark, tmp_path):
    (tmp_path / "flows.csv").write_text(" Flow Duration , Label\n3,BENIGN\n")
    assert training_files.flow_table(spark, str(tmp_path / "flows.csv")).columns == ["Flow Duration", "Label"]
    (tmp_path / "names.txt").write_text("1,a.com\n\n 2,b.org \n3,c.net\n")
    assert [r[0] for r in training_files.name_list(spark, str(tmp_path / "names.txt"), 2, ranked=True).collect()] == ["a.com", "b.org"]
    assert [r[0] for r in training_files.name_list(spark, str(tmp_path / "names.txt")).collect()] == ["1,a.com", "2,b.org", "3,c.net"]


def test_capped_flows_are_the_first_by_time_then_arrival(spark):
    rows = spark.createDataFrame([(5, "z"), (1, "y"), (1, "x"), (9, "w")], "ts_us long, uid string").coalesce(1)
    assert [r["uid"] for r in zeek.first_flows(rows, 3).collect()] == ["y", "x", "z"] and zeek.first_flows(rows).count() == 4


def test_timeline_has_benign_flows_and_its_phases(spark):
    made = synthetic.timeline(spark, [("flood", 100_000_000), ("beacon", 300_000_000)], benign=10)
    assert {r["dst_ip"] for r in made.where("dst_ip in ('10.9.9.9', '203.0.113.66')").collect()} == {"10.9.9.9", "203.0.113.66"}
    assert made.where("dst_ip = '10.9.9.9'").agg(F.min("timestamp_us")).first()[0] == 100_000_000
    assert made.where("src_ip like '10.50.%'").select("src_ip").distinct().count() == 10
