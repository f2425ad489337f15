"""One entry for all sources of connection records."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from trafficlens.operators.connections import records
from trafficlens.sources import captures, tshark, zeek
from trafficlens.sources.packets import read_json

CAPTURES = (".pcap", ".pcapng", ".cap")


def split_spec(spec: str) -> tuple[str, str]:
    """Kind and path of "kind:path"; a bare path's kind follows from its suffix."""
    kind, colon, path = spec.partition(":")
    if colon and kind in ("zeek", "zeek-tail", "pcap", "tshark", "packets", "iface"):
        return kind, path
    low = spec.lower()
    return ("pcap" if low.endswith(CAPTURES) else "tshark" if low.endswith(".tsv") else "zeek"), spec


def open_source(spark: SparkSession, spec: str, fields: list[str] | None = None) -> DataFrame:
    """Connection records of zeek:, zeek-tail: (a stream), pcap:, tshark: and packets: sources."""
    kind, path = split_spec(spec)
    if kind == "zeek":
        return zeek.conn_log(spark, path)[0].drop("bad_numbers")
    if kind == "zeek-tail":
        # a folder gets whole files, one log grows
        return (zeek.follow(spark, path, fields or list(zeek.REQUIRED)) if fields or os.path.isdir(path) else zeek.tail(spark, path)).drop("bad_numbers")
    if kind == "pcap":
        return records(captures.read(spark, path))
    if kind == "tshark":
        return records(tshark.read_fields(spark, path))
    if kind == "packets":
        return records(read_json(spark, path)[0])
    raise ValueError(f"{kind}: capture on an interface with a capture tool, and read its files")
