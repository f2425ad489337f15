"""A growing log is followed byte by byte, and a replay keeps to its clock."""

from __future__ import annotations

import json
import os

import pytest

from tests.conftest import rows
from tests.test_sources import FIELDS, VALUES, header
from trafficlens.sources import dispatch, synthetic, tail, zeek
from trafficlens.streaming import windows


def line(k, width=None):
    values = [f"{1700000000 + k}.5", f"C{k}", *VALUES[2:]]
    return "\t".join(values[:width])


def drained(spark, path, checkpoint, from_start=True):
    """What a query over the log gives until it has caught up, and its rejected lines."""
    got = []
    q = windows.each_batch(zeek.tail(spark, path, from_start), lambda b, _: got.extend(b.collect()), checkpoint, once=True)
    q.awaitTermination()
    return sorted((r["ts_us"] - 500_000) // 1_000_000 - 1_700_000_000 for r in got), zeek.rejected_lines(q)


def test_halves_rotation_and_restart_lose_and_repeat_nothing(spark, tmp_path):
    log, check = tmp_path / "logs" / "conn.log", str(tmp_path / "check")
    log.parent.mkdir()
    log.write_text("\n".join([*header(), line(0), line(1)]) + "\n" + line(2)[:20])
    (log.parent / "connections.txt").write_text("not of the series\n")
    assert drained(spark, str(log), check) == ([0, 1], 0)
    with log.open("a") as f:
        f.write(line(2)[20:] + "\n" + line(3, 5) + "\n\n#close\n" + line(4)[:7])
    assert drained(spark, str(log), check) == ([2], 1)
    assert drained(spark, str(log), check) == ([], 0)
    with log.open("a") as f:
        f.write(line(4)[7:] + "\n" + line(5))  # its last line never gets a line feed
    log.rename(log.parent / "conn.2024-01-01.log")
    # another layout, and a second rotation before anybody looks
    order = list(reversed(FIELDS))
    log.write_text("\n".join([header()[0], "\t".join(["#fields", *order]), "\t".join(reversed(line(6).split("\t")))]) + "\n")
    log.rename(log.parent / "conn-2024-01-02.log")
    log.write_text(json.dumps({"ts": 1700000007.5, "id.orig_h": "a"}) + "\n{broken\n" + json.dumps({"ts": 1700000008.5})[:9])
    assert drained(spark, str(log), check) == ([4, 5, 6, 7], 1)
    with log.open("a") as f:
        f.write(json.dumps({"ts": 1700000008.5})[9:] + "\n")
    assert drained(spark, str(log), check) == ([8], 0)
    log.write_text(json.dumps({"ts": 1700000009.5}) + "\n")  # cut and begun anew in place
    assert drained(spark, str(log), check) == ([9], 0)


def test_tail_from_the_end_and_without_a_log(spark, tmp_path):
    log = tmp_path / "conn.log"
    check = [str(tmp_path / f"check{i}") for i in range(3)]
    assert drained(spark, str(log), check[0]) == ([], 0)
    (tmp_path / "conn.old.log").write_text("\n".join([*header(), line(1)]) + "\n")
    log.write_text("\n".join([*header(), line(2)]) + "\n")
    assert drained(spark, str(log), check[1], from_start=False) == ([], 0)
    assert drained(spark, str(log), check[2]) == ([2], 0)  # what was rotated before isn't read
    with log.open("a") as f:
        f.write(line(3) + "\n")
    assert drained(spark, str(log), check[1], from_start=False) == ([3], 0)


@pytest.mark.parametrize("split", [1, 7, 64, 10**6])
def test_every_line_is_read_once_however_it_is_split(tmp_path, split):
    log = tmp_path / "a.log"
    texts = ["", "é" * 30, "x", "\r", "tail " * 40, "", "y" * 200, "z"]
    log.write_bytes("\n".join(texts * 5).encode() + b"\n" + b"\xff\xfe bad\n" + b"held back")
    reader = tail.TailReader(str(log), True, split)
    end = reader.latestOffset()
    got = [x for p in reader.partitions(reader.initialOffset(), end) for b in reader.read(p) for x in zip(b.column("position").to_pylist(), b.column("value").to_pylist(), strict=True)]
    want = [x.rstrip("\r") for x in texts * 5] + ["�� bad"]
    assert [v for _, v in sorted(got)] == want and reader.partitions(end, end) == []


def test_a_planned_range_is_found_after_a_rename_and_missed_when_gone(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("one\ntwo\n")
    reader = tail.TailReader(str(log), True, 100)
    end = reader.latestOffset()
    (part,) = reader.partitions({}, end)
    log.rename(tmp_path / "a.1.log")
    log.write_text("three\n")
    assert [v for b in reader.read(part) for v in b.column("value").to_pylist()] == ["one", "two"]
    os.remove(tmp_path / "a.1.log")
    with pytest.raises(FileNotFoundError, match="gone"):
        reader.partitions({}, end)


def test_dispatch_tails_a_log_and_follows_a_folder(spark, tmp_path):
    log = tmp_path / "conn.log"
    log.write_text("\n".join([*header(), line(0)]) + "\n")
    assert dispatch.open_source(spark, f"zeek-tail:{log}").isStreaming
    assert dispatch.open_source(spark, f"zeek-tail:{tmp_path}", FIELDS).isStreaming


def test_replay_keeps_to_the_clock(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "packets")
    made = synthetic.beacon(spark, 20)
    made.repartition(3).write.parquet(table)
    first, last = made.selectExpr("min(timestamp_us)", "max(timestamp_us)").first()
    options = {"path": table, "speed": "2", "firstUs": str(first), "lastUs": str(last), "anchorUs": "1000000", "ts": "timestamp_us"}
    schema = spark.read.parquet(table).schema
    now = [0]
    monkeypatch.setattr(tail.ReplayReader, "clock", staticmethod(lambda: now[0]))
    reader, at, seen = tail.ReplayReader(options, schema), None, []
    at = reader.initialOffset()
    for now[0], admitted in ((0, first - 1), (1_000_000, first), (1_500_000, first + 1_000_000), (4_000_000, first + 6_000_000), (10**9, last), (2 * 10**9, last)):
        end = reader.latestOffset()
        assert end == {"us": admitted}
        new = [t for p in reader.partitions(at, end) for b in reader.read(p) for t in b.column("timestamp_us").to_pylist()]
        assert all(at["us"] < t <= end["us"] for t in new)
        seen, at = seen + new, end
    assert sorted(seen) == sorted(r[0] for r in made.select("timestamp_us").collect())
    assert tail.ReplayReader(options | {"speed": "0"}, schema).latestOffset() == {"us": last}


def test_replayed_packets_as_a_stream(spark, tmp_path):
    table = str(tmp_path / "packets")
    made = synthetic.beacon(spark, 12)
    made.repartition(2).write.parquet(table)
    for k, (speed, anchor, n) in enumerate(((0, None, made.count()), (10, 1, made.count()), (1, 1 << 60, 0))):
        got = []
        windows.each_batch(tail.replay(spark, table, speed, anchor), lambda b, _, got=got: got.extend(b.collect()), str(tmp_path / f"check{k}"), once=True).awaitTermination()
        assert len(got) == n
        if n:
            assert rows(spark.createDataFrame(got, made.schema).toPandas()) == rows(made.toPandas())
