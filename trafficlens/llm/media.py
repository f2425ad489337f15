"""MPEG transport streams as media columns.

``store_documents`` puts each text, padded, into a transport stream: program tables
before every random-access point, and the payload as timestamped elementary packets.
``read_media`` parses such streams: program association and map tables with their
checksums, continuity counters, reassembled elementary packets, and an index of
timestamps with random-access points, each with a digest and statistics of the bytes up to the next
one. Both are maps over rows: no shuffle. ``feature`` is made of the index and of what
the bytes hold, all of it read back.

Cases: a null text is stored as an empty one, an empty one as one padded unit; any
length is handled one document at a time; rows are independent, so ties and repeated
rows give equal values; an empty table gives no rows; further columns are ignored.
A damaged stream raises ValueError rather than giving a partial payload.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.scratch import keep
from trafficlens.llm.words import slices

PACKET = 188
ALIGN = 192
#: Payload bytes in one elementary packet, and units from one random-access point to the next
UNIT, GROUP = 10 * ALIGN, 8
PAT_PID, PMT_PID, DATA_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
PRIVATE_DATA = 0x06
PTS_STEP, PTS_MODULUS = 3600, 1 << 33
_PES_HEADER, _PCR_FIELD = 14, 8


class Media(NamedTuple):
    """What a transport stream holds."""

    payload: bytes
    programs: dict[int, int]
    streams: dict[int, int]
    packets: int
    continuity_errors: int
    pts: np.ndarray
    offset: np.ndarray
    random_access: np.ndarray


@functools.lru_cache(4096)
def crc32_mpeg(data: bytes) -> int:
    """CRC-32 of program tables: polynomial 0x04C11DB7, most significant bit first."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


@functools.cache
def _table_packets() -> np.ndarray:
    """A PAT and a PMT packet, with continuity counter 0."""

    def packet(pid: int, table: int, number: int, body: bytes) -> bytes:
        head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
        section = head + body
        section += crc32_mpeg(section).to_bytes(4, "big")
        return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")

    pat = packet(PAT_PID, 0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    stream = bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = packet(PMT_PID, 2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + stream)
    return np.frombuffer(pat + pmt, np.uint8).reshape(2, PACKET)


def _unit_packets(units: np.ndarray, first: int) -> np.ndarray:
    """Packets (unit, packet, byte) of equally long payload units, numbered from ``first``; counters are left 0."""
    n, size = units.shape
    number = np.arange(first, first + n)
    pts = number * PTS_STEP % PTS_MODULUS
    pes = np.empty((n, _PES_HEADER + size), np.uint8)
    pes[:, :9] = [0, 0, 1, 0xBD, (size + 8) >> 8, (size + 8) & 255, 0x80, 0x80, 5]
    pes[:, 9], pes[:, 10], pes[:, 11] = 0x21 | pts >> 29 & 0x0E, pts >> 22 & 255, pts >> 14 & 0xFE | 1
    pes[:, 12], pes[:, 13], pes[:, 14:] = pts >> 7 & 255, pts << 1 & 0xFE | 1, units
    total, room = pes.shape[1], PACKET - 4
    more = max(0, -(-(total - (room - _PCR_FIELD)) // room))
    out = np.full((n, 1 + more, PACKET), 0xFF, np.uint8)
    out[:, :, 0], out[:, :, 1], out[:, :, 2], out[:, :, 3] = 0x47, DATA_PID >> 8, DATA_PID & 255, 0x10
    out[:, 0, 1] |= 0x40
    out[:, 0, 3] |= 0x20
    lead = min(total, room - _PCR_FIELD)
    out[:, 0, 4] = room - lead - 1
    out[:, 0, 5] = np.where(number % GROUP == 0, 0x50, 0x10)
    out[:, 0, 6], out[:, 0, 7], out[:, 0, 8], out[:, 0, 9] = pts >> 25 & 255, pts >> 17 & 255, pts >> 9 & 255, pts >> 1 & 255
    out[:, 0, 10], out[:, 0, 11] = (pts & 1) << 7 | 0x7E, 0
    out[:, 0, PACKET - lead :] = pes[:, :lead]
    if more > 1:
        out[:, 1:more, 4:] = pes[:, lead : lead + (more - 1) * room].reshape(n, more - 1, room)
    if more:
        tail = total - lead - (more - 1) * room
        if tail < room:
            out[:, more, 3] |= 0x20
            out[:, more, 4] = room - tail - 1
            if room - tail > 1:
                out[:, more, 5] = 0
        out[:, more, PACKET - tail :] = pes[:, total - tail :]
    return out


def padded(text: bytes) -> bytes:
    """The payload: spaces up to a positive multiple of ALIGN."""
    return text.ljust(max(1, -(-len(text) // ALIGN)) * ALIGN, b" ")


def mux(payload: bytes) -> bytes:
    """A transport stream of one program with one private data stream."""
    data = np.frombuffer(payload, np.uint8)
    whole = len(data) // UNIT
    parts = list(_unit_packets(data[: whole * UNIT].reshape(whole, UNIT), 0)) if whole else []
    if len(data) % UNIT:
        parts += list(_unit_packets(data[whole * UNIT :].reshape(1, -1), whole))
    laid = [x for i in range(0, len(parts), GROUP) for x in (_table_packets(), *parts[i : i + GROUP])]
    out = np.concatenate(laid)
    data_rows = out[:, 1] & 0x1F == DATA_PID >> 8
    out[data_rows, 3] |= (np.arange(data_rows.sum()) & 15).astype(np.uint8)
    tables = np.flatnonzero(~data_rows)
    out[tables, 3] |= (np.arange(len(tables)) // 2 & 15).astype(np.uint8)
    return out.tobytes()


@functools.lru_cache(1024)
def _section(payload: bytes) -> tuple[int, int, bytes]:
    """Table id, table number and body of the checked section at the start of a payload."""
    at = 1 + payload[0]
    size = 3 + (int.from_bytes(payload[at + 1 : at + 3], "big") & 0x0FFF)
    section = payload[at : at + size]
    if len(section) < size or crc32_mpeg(section[:-4]) != int.from_bytes(section[-4:], "big"):
        raise ValueError("a program table is cut or fails its checksum")
    return section[0], int.from_bytes(section[3:5], "big"), section[8:-4]


def demux(media: bytes) -> Media:
    """Parse a transport stream with one data stream."""
    if not media or len(media) % PACKET:
        raise ValueError("not a whole number of packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any() or (p[:, 1] & 0x80).any():
        raise ValueError("a packet has no sync byte or is marked as damaged")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    opens, field, counter = p[:, 1] & 0x40 > 0, p[:, 3] & 0x20 > 0, p[:, 3] & 15
    field_size = np.where(field, p[:, 4].astype(np.int32), 0)
    begin = 4 + field + field_size
    carries = p[:, 3] & 0x10 > 0
    flags = np.where(field & (field_size > 0), p[:, 5], 0)

    def rows(of: int) -> tuple[np.ndarray, int]:
        """Packets of one PID without repeated ones, and its counter's jumps."""
        at = np.flatnonzero((pid == of) & carries)
        step = (counter[at[1:]] - counter[at[:-1]]) & 15
        again = np.concatenate([[False], (step == 0) & (p[at[1:]] == p[at[:-1]]).all(axis=1)]) if (step == 0).any() else np.zeros(len(at), bool)
        lost = (step != 1) & ~again[1:] & (flags[at[1:]] & 0x80 == 0)
        return at[~again], int(lost.sum())

    programs: dict[int, int] = {}
    streams: dict[int, int] = {}
    errors = 0
    at, lost = rows(PAT_PID)
    errors += lost
    for x in {p[i, begin[i] :].tobytes() for i in at[opens[at]]}:
        table, _, body = _section(x)
        if table == 0:
            programs |= {int.from_bytes(body[k : k + 2], "big"): int.from_bytes(body[k + 2 : k + 4], "big") & 0x1FFF for k in range(0, len(body), 4)}
    for map_pid in {v for k, v in programs.items() if k}:
        at, lost = rows(map_pid)
        errors += lost
        for x in {p[i, begin[i] :].tobytes() for i in at[opens[at]]}:
            table, _, body = _section(x)
            k = 4 + (int.from_bytes(body[2:4], "big") & 0x0FFF)
            while table == 2 and k < len(body):
                streams[int.from_bytes(body[k + 1 : k + 3], "big") & 0x1FFF] = body[k]
                k += 5 + (int.from_bytes(body[k + 3 : k + 5], "big") & 0x0FFF)
    if len(streams) != 1:
        raise ValueError(f"{len(streams)} elementary streams; one is read")
    at, lost = rows(next(iter(streams)))
    errors += lost
    if errors:
        raise ValueError(f"{errors} jumps of continuity counters")
    es = p[at][np.arange(PACKET) >= begin[at, None]]
    sizes = PACKET - begin[at]
    head = (np.cumsum(sizes) - sizes)[opens[at]]
    h = es[head[:, None] + np.arange(_PES_HEADER)].astype(np.int64)
    if not len(head) or (h[:, :3] != [0, 0, 1]).any() or (h[:, 7] & 0x80 == 0).any():
        raise ValueError("an elementary packet has no start code or timestamp")
    data, until = head + 9 + h[:, 8], head + 6 + (h[:, 4] << 8 | h[:, 5])
    if (until > np.append(head[1:], len(es))).any():
        raise ValueError("an elementary packet is cut")
    payload = b"".join([es[a:b].tobytes() for a, b in zip(data.tolist(), until.tolist(), strict=True)])
    pts = (h[:, 9] & 0x0E) << 29 | h[:, 10] << 22 | (h[:, 11] & 0xFE) << 14 | h[:, 12] << 7 | h[:, 13] >> 1
    offset = np.cumsum(until - data) - (until - data)
    return Media(payload, programs, streams, len(p), errors, pts, offset, flags[at][opens[at]] & 0x40 > 0)


GROUPS = pa.list_(pa.struct([("pts", pa.int64()), ("offset", pa.int64()), ("bytes", pa.int64()), ("crc32", pa.int64()), ("byte_sum", pa.int64()), ("distinct", pa.int32())]))
STORED = "doc_id long, n_bytes long, media binary"
INDEXED = (
    "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "programs int, streams int, packets long, continuity_errors long, units array<struct<pts:long,offset:long,random_access:boolean>>, "
    "groups array<struct<pts:long,offset:long,bytes:long,crc32:long,byte_sum:long,distinct:int>>"
)


def group_rows(m: Media) -> list[dict[str, int]]:
    """One row for each random-access point: its timestamp and offset, and what its bytes up to the next one hold."""
    at = np.flatnonzero(m.random_access)
    begin, out = m.offset[at].tolist(), []
    for pts, a, b in zip(m.pts[at].tolist(), begin, [*begin[1:], len(m.payload)], strict=True):
        part = m.payload[a:b]
        counts = np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        out.append({"pts": pts, "offset": a, "bytes": b - a, "crc32": zlib.crc32(part), "byte_sum": int(counts @ np.arange(256)), "distinct": int((counts > 0).sum())})
    return out


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts = [(x or "").encode() for x in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), pa.array([mux(padded(x)) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"]
        )


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "media"):
        media = b.column("media").to_pylist()
        read = [demux(x) for x in media]
        counts = np.cumsum([0, *(len(m.pts) for m in read)])
        units = pa.ListArray.from_arrays(
            pa.array(counts, pa.int32()),
            pa.StructArray.from_arrays(
                [np.concatenate([x for m in read for x in [getattr(m, k)]]) if read else [] for k in ("pts", "offset", "random_access")], ["pts", "offset", "random_access"]
            ),
        )
        columns = {
            "doc_id": b.column("doc_id"),
            "n_bytes": b.column("n_bytes"),
            "media_bytes": pa.array([len(x) for x in media], pa.int64()),
            "media_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in media]),
            "payload_bytes": pa.array([len(m.payload) for m in read], pa.int64()),
            "payload_sha256": pa.array([hashlib.sha256(m.payload).hexdigest() for m in read]),
            "tail_crc32": pa.array([zlib.crc32(m.payload[-16:]) for m in read], pa.int64()),
            "programs": pa.array([len(m.programs) for m in read], pa.int32()),
            "streams": pa.array([len(m.streams) for m in read], pa.int32()),
            "packets": pa.array([m.packets for m in read], pa.int64()),
            "continuity_errors": pa.array([m.continuity_errors for m in read], pa.int64()),
            "units": units,
            "groups": pa.array([group_rows(m) for m in read], GROUPS),
        }
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def store_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the transport stream of each text."""
    return documents.select("doc_id", "text").mapInArrow(_store, STORED)


def written(stored: DataFrame) -> DataFrame:
    """The media table, written to the shared folder, as it is read back."""
    return keep(stored, "media", compression="zstd")


def read_media(stored: DataFrame) -> DataFrame:
    """Digests, table counts and the timestamp index, read back from the stored bytes."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_index, INDEXED)


def features(indexed: DataFrame) -> DataFrame:
    """Adds ``feature``: the stream's tables and index, and the mean byte, distinct bytes and digest of its random-access groups."""
    last = F.element_at("units", -1)["pts"]
    total = lambda field: F.aggregate("groups", F.lit(0).cast("long"), lambda n, g: n + g[field])
    digest = F.sha2(F.array_join(F.transform("groups", lambda g: F.concat_ws(":", g["pts"], g["offset"], g["crc32"])), ","), 256)
    text = "programs=%d streams=%d packets=%d units=%d last_pts=%d random_access=%d mean_byte=%.4f distinct=%d index=%s"
    return indexed.withColumn(
        "feature",
        F.format_string(
            text, "programs", "streams", "packets", F.size("units"), last, F.size("groups"), total("byte_sum") / total("bytes"), F.array_max(F.transform("groups", lambda g: g["distinct"])), F.substring(digest, 1, 16)
        ),
    )
