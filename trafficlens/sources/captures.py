"""Large captures: byte ranges of a file are read by tasks of their own, and packets are decoded by arrays.

A classic capture has no index: a record's place follows from all before it. ``indexed`` finds record borders in all ranges
at once: each task looks for the first place in its range from which headers follow one another for more bytes than the
largest packet has, walks on to the range's end, and reports where it began and ended. A range's end must be the next one's begin; where it
isn't (a packet may hold a capture itself) the later range is walked again from the known place. So the borders are exact, and the
driver sees two numbers for each range, and the times in it, by which ranges outside a time filter are never read.

``read`` then decodes: headers are gathered from the range's buffer as columns, addresses become text once for each distinct one, and
only the names in DNS queries are parsed one by one. The rows are those of ``pcap.decode``.

Next-generation captures (blocks that refer to interfaces named earlier) are one range each; they are walked block by block and decoded
in portions, so they may be larger than 2 GB, but are one task a file. Files are reached through ``pyarrow.fs``, by the paths that Spark lists.

Cases: an empty folder, an empty file or one that is no capture gives no rows; a cut last record ends its file; packets that are
neither IPv4 nor IPv6 are skipped.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from trafficlens.schemas import PACKET
from trafficlens.sources import pcap
from trafficlens.sources.packets import flat

RANGE_BYTES = 64 << 20
#: Packets that are decoded at once
PORTION = 1 << 16
#: No link has longer frames; a chain of headers over more bytes can't lie in one packet
LARGEST = 262_144
FILE_HEAD, RECORD_HEAD = 24, 16
# Magic numbers to byte order and the parts of a second
MAGIC = {b"\xa1\xb2\xc3\xd4": (">", 1_000_000), b"\xd4\xc3\xb2\xa1": ("<", 1_000_000), b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000), b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000)}
BLOCKS = b"\x0a\x0d\x0d\x0a"

_FIELDS = StructType([f for f in PACKET.fields if f.name != "ingest_time"])
_FLAGS = (("syn", 2), ("ack", 16), ("rst", 4), ("fin", 1), ("psh", 8), ("urg", 32))
RANGE = StructType([StructField("path", StringType()), *(StructField(n, LongType()) for n in ("size", "begin", "until", "first_at", "next_at", "from_us", "to_us"))])


def _open(path: str) -> pa.NativeFile:
    where = urlparse(path)
    if where.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(where.path))
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _head(file: pa.NativeFile) -> tuple[str, int] | None:
    return MAGIC.get(file.read_at(4, 0))


class Walk(NamedTuple):
    """Records of one range: their places in ``data``, sizes and times; ``next_at`` is the first border at or behind the range's end."""

    at: np.ndarray
    size: np.ndarray
    ts_us: np.ndarray
    next_at: int


def walk(data: bytes, base: int, first_at: int, until: int, end_of_file: int, order: str, parts: int) -> Walk:
    """Step over record headers from a border; ``data`` begins at ``base`` and holds the last record whole, unless the file is cut."""
    at, found, times = first_at, [], []
    read = struct.Struct(order + "III").unpack_from
    per_us = parts // 1_000_000
    while at < until and at + RECORD_HEAD <= end_of_file:
        seconds, part, size = read(data, at - base)
        if at + RECORD_HEAD + size > end_of_file:
            at = end_of_file
            break
        found.append((at - base + RECORD_HEAD, size))
        times.append(seconds * 1_000_000 + part // per_us)
        at += RECORD_HEAD + size
    places = np.array(found, np.int64).reshape(-1, 2)
    return Walk(places[:, 0], places[:, 1], np.array(times, np.int64), end_of_file if at < until else at)


def first_border(data: bytes, order: str, parts: int, ends: bool) -> int | None:
    """The first place from which plausible headers follow one another for over LARGEST bytes, or to the end if ``ends``."""
    raw = np.frombuffer(data, np.uint8)
    n = min(len(raw) - RECORD_HEAD + 1, 2 * LARGEST)
    if n <= 0:
        return None
    word = lambda k: sum(raw[k + i : k + i + n].astype(np.int64) << (8 * (i if order == "<" else 3 - i)) for i in range(4))
    part, kept, sent = word(4), word(8), word(12)
    able = (part < parts) & (kept <= sent) & (kept <= LARGEST) & (sent <= LARGEST)
    read = struct.Struct(order + "IIII").unpack_from
    for start in np.flatnonzero(able).tolist():
        at, before = start, None
        while at + RECORD_HEAD <= len(data) and at - start <= 2 * LARGEST:
            seconds, part_, kept_, sent_ = read(data, at)
            # captures may be out of order, but not by a day
            if part_ >= parts or kept_ > sent_ or sent_ > LARGEST or (before is not None and abs(seconds - before) > 86_400):
                break
            at, before = at + RECORD_HEAD + kept_, seconds
        else:
            if at - start > LARGEST or ends:
                return start
    return None


def _walk_ranges(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each range's records begin and end. A begin that is known (first_at) is taken as it is."""
    for b in rows:
        out = []
        for r in b.to_pylist():
            with _open(r["path"]) as file:
                head = _head(file)
                if head is not None:
                    data = file.read_at(min(r["until"] + 4 * LARGEST, r["size"]) - r["begin"], r["begin"])
                    first = r["first_at"]
                    if first is None:
                        found = first_border(data, *head, ends=r["begin"] + len(data) >= r["size"])
                        first = None if found is None or r["begin"] + found >= r["until"] else r["begin"] + found
                    if first is None or first >= r["until"]:
                        r |= {"first_at": first, "next_at": first}
                    else:
                        w = walk(data, r["begin"], first, r["until"], r["size"], *head)
                        r |= {"first_at": first, "next_at": w.next_at, "from_us": int(w.ts_us.min()) if len(w.ts_us) else None, "to_us": int(w.ts_us.max()) if len(w.ts_us) else None}
            out.append(r)
        yield pa.RecordBatch.from_pylist(out, to_arrow_schema(RANGE))


def _on_tasks(spark: SparkSession, ranges: list[dict]) -> DataFrame:
    """One partition for each range."""
    return spark.createDataFrame([tuple(r[f.name] for f in RANGE.fields) for r in ranges], RANGE).repartition(max(1, len(ranges)))


def _ranges(range_bytes: int):
    """A map from files (path, length) to their ranges, by the kind of file."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            out = []
            for name, size in zip(*(b.column(c).to_pylist() for c in ("path", "length")), strict=True):
                with _open(name) as file:
                    kind = file.read_at(4, 0)
                blank = {"path": name, "size": size, "first_at": None}
                if kind == BLOCKS:
                    out.append(blank | {"begin": 0, "until": size})
                elif kind in MAGIC:
                    out += [blank | {"begin": at, "until": min(at + range_bytes, size), "first_at": at if at == FILE_HEAD else None} for at in range(FILE_HEAD, size, range_bytes)]
            yield pa.RecordBatch.from_pylist(out, to_arrow_schema(RANGE))

    return run


def indexed(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> list[dict]:
    """The ranges of all classic captures under a path with exact borders, and all other captures as one range each."""
    reader = spark.read.format("binaryFile")
    reader = reader if path.lower().endswith((".pcap", ".pcapng", ".cap")) else reader.option("pathGlobFilter", pcap.SUFFIXES)
    walked = reader.load(path).select("path", "length").mapInArrow(_ranges(range_bytes), RANGE)
    walked = walked.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_walk_ranges, RANGE)
    done = sorted((r.asDict() for r in walked.collect()), key=lambda r: (r["path"], r["begin"]))
    while True:
        # the first range that doesn't begin where the one before ended is walked again; those before it are settled
        wrong, at, name = [], None, None
        for r in done:
            if r["begin"] == FILE_HEAD or r["next_at"] is None and r["begin"] == 0:
                at, name = r["next_at"], r["path"]
            elif r["path"] != name:
                continue
            elif at >= r["until"]:
                r |= {"first_at": at, "next_at": at, "from_us": None, "to_us": None}
            elif r["first_at"] != at:
                wrong.append(r | {"first_at": at, "next_at": None})
                name = None  # what follows in this file waits for it
            else:
                at = r["next_at"]
        if not wrong:
            return done
        mended = {(r["path"], r["begin"]): r.asDict() for r in _on_tasks(spark, wrong).mapInArrow(_walk_ranges, RANGE).collect()}
        done = [mended.get((r["path"], r["begin"]), r) for r in done]


def _bytes_at(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> np.ndarray:
    return np.where(inside, data[np.where(inside, at, 0)], 0).astype(np.int64)


def decoded(data: np.ndarray, at: np.ndarray, size: np.ndarray, ts_us: np.ndarray) -> pa.RecordBatch:
    """Packet records of the frames data[at:at + size] that hold IPv4 or IPv6."""
    end = at + size
    byte = lambda place, limit: _bytes_at(data, place, place < limit)  # noqa: E731  beyond the limit: 0
    two = lambda place, limit: byte(place, limit) << 8 | byte(place + 1, limit)
    kind_at = at + 12
    while True:
        tagged = np.isin(two(kind_at, end), (0x8100, 0x88A8)) & (kind_at + 2 <= end)
        if not tagged.any():
            break
        kind_at = kind_at + 4 * tagged
    kind, ip = np.where(kind_at + 2 <= end, two(kind_at, end), 0), kind_at + 2
    four, six = (kind == 0x0800) & (end - ip >= 20), (kind == 0x86DD) & (end - ip >= 40)
    kept = np.flatnonzero(four | six)
    end, ip, ts_us, four = end[kept], ip[kept], ts_us[kept], four[kept]
    head = np.where(four, (byte(ip, end) & 15) * 4, 40)
    protocol = np.where(four, byte(ip + 9, end), byte(ip + 6, end))
    total = np.where(four, two(ip + 2, end), two(ip + 4, end) + 40)
    body, last = ip + head, np.minimum(ip + total, end)
    length = np.maximum(last - body, 0)
    tcp, udp = protocol == 6, protocol == 17
    ported = (tcp | udp) & (length >= 4)
    ports = [np.where(ported, two(body + k, last), 0) for k in (0, 2)]
    flagged = tcp & (length >= 14)
    bits = np.where(flagged, byte(body + 13, last), 0)
    transport = np.where(flagged, (byte(body + 12, last) >> 4) * 4, np.where(udp, 8, 0))
    payload = np.maximum(length - transport, 0)
    names: list[str | None] = [None] * len(kept)
    for i in np.flatnonzero(udp & ((ports[0] == 53) | (ports[1] == 53))).tolist():
        names[i] = pcap.query_name(data[body[i] + transport[i] : max(last[i], body[i] + transport[i])].tobytes())
    address = [_addresses(data, np.where(four, ip + a, ip + b), four) for a, b in ((12, 8), (16, 24))]
    flags = pa.StructArray.from_arrays([pa.array((bits & bit) > 0) for _, bit in _FLAGS], names=[n for n, _ in _FLAGS], mask=pa.array(~flagged))
    made = {
        "src_ip": address[0], "dst_ip": address[1], "src_port": pa.array(ports[0]), "dst_port": pa.array(ports[1]), "protocol": pa.array(protocol), "timestamp_us": pa.array(ts_us),
        "packet_len": pa.array(total), "payload_len": pa.array(payload), "tcp_flags": flags, "dns_query": pa.array(names, pa.string()),
    }
    schema = to_arrow_schema(_FIELDS)
    return pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else pa.nulls(len(kept), f.type) for f in schema], schema=schema)


def _addresses(data: np.ndarray, at: np.ndarray, four: np.ndarray) -> pa.Array:
    """Text of addresses; each distinct one is made once."""
    raw = np.zeros((len(at), 17), np.uint8)
    for mine, n in ((np.flatnonzero(four), 4), (np.flatnonzero(~four), 16)):
        raw[mine, :n] = data[at[mine][:, None] + np.arange(n)]
    raw[:, 16] = four
    each, place = np.unique(raw.view("V17").ravel(), return_inverse=True)
    text = [str(ipaddress.ip_address(v[:4] if v[16] else v[:16])) for v in (x.tobytes() for x in each)]
    return pa.array(text, pa.string()).take(pa.array(place))


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, since_us: int | None = None, until_us: int | None = None) -> DataFrame:
    """Packets of all captures in a folder (or of one file), of times from ``since_us`` to below ``until_us``."""
    low, high = -(1 << 62) if since_us is None else since_us, 1 << 62 if until_us is None else until_us
    ranges = [r for r in indexed(spark, path, range_bytes) if r["begin"] == 0 or (r["from_us"] is not None and r["from_us"] < high and r["to_us"] >= low)]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in rows for r in b.to_pylist()):
            with _open(r["path"]) as file:
                if r["begin"] == 0:
                    yield from _blocks(file, low, high)
                    continue
                raw = file.read_at(r["next_at"] - r["first_at"], r["first_at"])
                w = walk(raw, r["first_at"], r["first_at"], r["until"], r["size"], *_head(file))
                data, inside = np.frombuffer(raw, np.uint8), np.flatnonzero((w.ts_us >= low) & (w.ts_us < high))
                for k in range(0, len(inside), PORTION):
                    some = inside[k : k + PORTION]
                    yield decoded(data, w.at[some], w.size[some], w.ts_us[some])

    return flat(_on_tasks(spark, ranges).mapInArrow(run, _FIELDS))


def _blocks(file: pa.NativeFile, low: int, high: int) -> Iterator[pa.RecordBatch]:
    """Packets of a next-generation capture, read as a stream."""
    frames: list[tuple[int, bytes]] = []

    def portion() -> pa.RecordBatch:
        size = np.array([len(f) for _, f in frames], np.int64)
        return decoded(np.frombuffer(b"".join(f for _, f in frames), np.uint8), np.cumsum(size) - size, size, np.array([t for t, _ in frames], np.int64))

    for ts, frame in pcap.next_generation(file.read_buffer):
        if low <= ts < high:
            frames.append((ts, frame))
        if len(frames) == PORTION:
            yield portion()
            frames = []
    if frames:
        yield portion()
