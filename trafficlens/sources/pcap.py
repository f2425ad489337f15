"""The formats of packet captures and frames, record by record; ``captures`` reads files by ranges and decodes by arrays."""

from __future__ import annotations

import io
import ipaddress
import struct
from collections.abc import Callable, Iterator

SUFFIXES = "*.{pcap,pcapng,cap,PCAP,PCAPNG,CAP}"
_BLOCK_SECTION, _BLOCK_INTERFACE, _BLOCK_PACKET = 0x0A0D0D0A, 1, 6
ETHERNET = 1


def records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(time in microseconds, Ethernet frame) of a capture in either file format; a cut last record ends it."""
    if data[:4] == b"\x0a\x0d\x0d\x0a":
        yield from next_generation(io.BytesIO(data).read)
        return
    order = {b"\xa1\xb2\xc3\xd4": ">", b"\xd4\xc3\xb2\xa1": "<", b"\xa1\xb2\x3c\x4d": ">", b"\x4d\x3c\xb2\xa1": "<"}.get(data[:4])
    if order is None:
        return
    per_us = 1000 if data[:4] in (b"\xa1\xb2\x3c\x4d", b"\x4d\x3c\xb2\xa1") else 1
    at = 24
    while at + 16 <= len(data):
        seconds, part, size = struct.unpack_from(order + "III", data, at)
        if at + 16 + size > len(data):
            return
        yield seconds * 1_000_000 + part // per_us, data[at + 16 : at + 16 + size]
        at += 16 + size


def next_generation(read: Callable[[int], bytes]) -> Iterator[tuple[int, bytes]]:
    """The same of the newer format, from a function that reads so many bytes on."""
    order, units = "<", []
    while len(head := bytes(read(12))) == 12:
        if head[:4] == b"\x0a\x0d\x0d\x0a":
            order, units = ("<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"), []
        kind, size = struct.unpack_from(order + "II", head)
        if size < 12 or len(block := head + bytes(read(size - 12))) < size:
            return
        if kind == _BLOCK_INTERFACE:
            units.append(_resolution(block[16 : size - 4], order))
        elif kind == _BLOCK_PACKET:
            interface, high, low, kept = struct.unpack_from(order + "IIII", block, 8)
            unit = units[interface] if interface < len(units) else 1_000_000
            yield ((high << 32) | low) * 1_000_000 // unit, block[28 : 28 + kept]


def _resolution(options: bytes, order: str) -> int:
    """Ticks a second of an interface (option 9), a million unless given."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 9 and size:
            value = options[at + 4]
            return 2 ** (value & 127) if value & 128 else 10**value
        if not code:
            break
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


def query_name(message: bytes) -> str | None:
    """The first question's name of a DNS query; None for answers and damaged messages."""
    if len(message) < 13 or message[2] & 0x80:
        return None
    labels, at = [], 12
    while at < len(message) and (size := message[at]):
        if size > 63 or at + 1 + size > len(message):
            return None
        labels.append(message[at + 1 : at + 1 + size].decode("utf-8", "replace"))
        at += 1 + size
    return ".".join(labels) or None


def decode(ts: int, frame: bytes) -> dict | None:
    """A packet record of an Ethernet frame; None unless it holds IPv4 or IPv6."""
    at = 12
    while frame[at : at + 2] in (b"\x81\x00", b"\x88\xa8"):
        at += 4
    kind, ip = frame[at : at + 2], frame[at + 2 :]
    if kind == b"\x08\x00" and len(ip) >= 20:
        head, protocol, total = (ip[0] & 15) * 4, ip[9], int.from_bytes(ip[2:4], "big")
        src, dst = ip[12:16], ip[16:20]
    elif kind == b"\x86\xdd" and len(ip) >= 40:
        head, protocol, total = 40, ip[6], int.from_bytes(ip[4:6], "big") + 40
        src, dst = ip[8:24], ip[24:40]
    else:
        return None
    body = ip[head:total]
    ports = struct.unpack_from(">HH", body) if protocol in (6, 17) and len(body) >= 4 else (0, 0)
    bits = body[13] if protocol == 6 and len(body) >= 14 else None
    transport = (body[12] >> 4) * 4 if bits is not None else 8 if protocol == 17 else 0
    payload = body[transport:]
    return {
        "src_ip": str(ipaddress.ip_address(src)),
        "dst_ip": str(ipaddress.ip_address(dst)),
        "src_port": ports[0],
        "dst_port": ports[1],
        "protocol": protocol,
        "timestamp_us": ts,
        "packet_len": total,
        "payload_len": len(payload),
        "tcp_flags": None if bits is None else {n: bool(bits & b) for n, b in (("syn", 2), ("ack", 16), ("rst", 4), ("fin", 1), ("psh", 8), ("urg", 32))},
        "dns_query": query_name(payload) if protocol == 17 and 53 in ports else None,
    }
