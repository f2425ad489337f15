"""Captures read by ranges give the packets of a plain walk."""

from __future__ import annotations

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sources import capture, dns_frame, frame
from trafficlens.sources import captures, pcap


def odd_frame(rng):
    kind = rng.random()
    if kind < 0.15:
        return dns_frame(rng.choice(["a.example", "kq9x.info", "", "x" * 60 + ".org"]))
    if kind < 0.3:  # IPv6, TCP or other
        body = bytes(rng.randrange(256) for _ in range(rng.randint(0, 60)))
        inner = struct.pack(">IHBB", 6 << 28, rng.choice([len(body), 9, 200]), rng.choice([6, 17, 58]), 64) + bytes(rng.randrange(256) for _ in range(32)) + body
        f = bytes(12) + b"\x86\xdd" + inner
    else:
        f = frame(f"10.0.{rng.randrange(3)}.{rng.randrange(4)}", "10.9.9.9", rng.choice([5000, 53, 80]), rng.choice([53, 81, 443])) + bytes(rng.randrange(256) for _ in range(rng.randint(0, 300)))
        if rng.random() < 0.4:  # any lengths and header sizes
            raw = bytearray(f)
            for _ in range(rng.randint(1, 3)):
                raw[rng.randrange(12, min(60, len(raw)))] = rng.randrange(256)
            f = bytes(raw)
    for _ in range(rng.choice([0, 0, 0, 1, 2])):
        f = f[:12] + rng.choice([b"\x81\x00", b"\x88\xa8"]) + b"\x00\x05" + f[12:]
    return f[: rng.randrange(len(f) + 1)] if rng.random() < 0.15 else f


def some_frames(n, seed=1, embedded=True):
    rng = random.Random(seed)
    out = [(1_700_000_000_000_000 + i * 1_000 + rng.randrange(900), odd_frame(rng)) for i in range(n)]
    if embedded:  # packets that carry captures
        for i in range(5, n, 40):
            ts, f = out[i]
            inner = capture([(ts + k, odd_frame(rng)) for k in range(6)])
            out[i] = (ts, frame("10.0.0.7", "10.0.0.8", 5000, 9000) + inner[24:])
    return out


def plain(frames):
    return [r for r in (pcap.decode(ts, f) for ts, f in frames) if r is not None]


def key(r):
    flags = None if r["tcp_flags"] is None else tuple(sorted((r["tcp_flags"].asDict() if hasattr(r["tcp_flags"], "asDict") else r["tcp_flags"]).items()))
    return (r["timestamp_us"], *(str(r[c]) for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_len", "payload_len", "dns_query")), flags)


def test_decoding_by_arrays_equals_decoding_one_by_one():
    frames = some_frames(3000)
    size = np.array([len(f) for _, f in frames])
    got = captures.decoded(np.frombuffer(b"".join(f for _, f in frames), np.uint8), np.cumsum(size) - size, size, np.array([t for t, _ in frames])).to_pylist()
    want = plain(frames)
    assert len(want) > 1500 and [key(r) for r in got] == [key(r) for r in want]


@pytest.mark.parametrize("range_bytes", [700, 50_000, 1 << 30])
def test_ranges_hold_every_packet_once(spark, tmp_path, range_bytes):
    frames = some_frames(400)
    (tmp_path / "a b.pcap").write_bytes(capture(frames))
    (tmp_path / "cut.cap").write_bytes(capture(frames[:90])[:-5])
    (tmp_path / "empty.pcap").write_bytes(b"")
    (tmp_path / "head.pcap").write_bytes(capture([]))
    (tmp_path / "no.pcap").write_bytes(b"this is no capture")
    got = captures.read(spark, str(tmp_path), range_bytes)
    assert sorted(map(key, got.collect())) == sorted(map(key, plain(frames) + plain(frames[:89])))
    assert got.rdd.getNumPartitions() >= (60 if range_bytes == 700 else 2)


def test_a_time_filter_skips_ranges(spark, tmp_path):
    frames = some_frames(400)
    (tmp_path / "a.pcap").write_bytes(capture(frames))
    low, high = frames[100][0], frames[130][0]
    got = captures.read(spark, str(tmp_path), 2000, low, high)
    assert sorted(map(key, got.collect())) == sorted(map(key, plain(f for f in frames if low <= f[0] < high)))
    assert got.rdd.getNumPartitions() < captures.read(spark, str(tmp_path), 2000).rdd.getNumPartitions() / 5


def test_borders_are_found_in_a_file_of_some_mb(spark, tmp_path):
    rng = random.Random(3)
    base = [odd_frame(rng) + bytes(rng.randrange(200, 1400)) for _ in range(500)]
    frames = [(1_700_000_000_000_000 + i * 100, base[i % 500]) for i in range(9000)]
    (tmp_path / "big.pcap").write_bytes(capture(frames))
    ranges = captures.indexed(spark, str(tmp_path / "big.pcap"), 1 << 19)
    assert len(ranges) > 10 and all(a["next_at"] == b["first_at"] for a, b in zip(ranges, ranges[1:], strict=False))
    got = captures.read(spark, str(tmp_path / "big.pcap"), 1 << 19)
    assert got.count() == len(plain(frames)) and got.agg(F.sum("packet_len")).first()[0] == sum(r["packet_len"] for r in plain(frames))


def test_next_generation_by_portions(spark, tmp_path, monkeypatch):
    frames = [(ts % 10**9, f) for ts, f in some_frames(150, embedded=False)]
    out = struct.pack("<IIIHHqI", 0x0A0D0D0A, 28, 0x1A2B3C4D, 1, 0, -1, 28) + struct.pack("<IIHHII", 1, 20, 1, 0, 0, 20)
    for ts, f in frames:
        pad = bytes(-len(f) % 4)
        size = 32 + len(f) + len(pad)
        out += struct.pack("<IIIIIII", 6, size, 0, ts >> 32, ts & 0xFFFFFFFF, len(f), len(f)) + f + pad + struct.pack("<I", size)
    (tmp_path / "n.pcapng").write_bytes(out + b"\x06\x00\x00\x00\xff")
    assert sorted(map(key, captures.read(spark, str(tmp_path)).collect())) == sorted(map(key, plain(frames)))


def test_a_folder_without_captures_gives_no_rows(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"x")
    assert captures.read(spark, str(tmp_path)).count() == 0
