"""Connection records with boundary flushes: one step function for batches and streams.

``connections.tcp_records`` are records that live until their own end or idle time. The live plan also
ends records at every multiple of ``flush_us``: unanswered ones of ``FLUSH_AGE_US`` or more, and all that have been idle for
over ``FLUSH_IDLE_US``, so that a scan without answers counts in its own windows. What a packet does to a record
then depends on when boundaries fall, so a key's packets are stepped through in order, in one pass that holds a
single record. A record is *known* at the time when it ends: at its own RST or FIN, else when its idle
time or a boundary has passed. A UDP packet is known at once.

A key's packets are cut into chunks that are stepped through apart: a packet after the key's own RST or
FIN, or after ``IDLE_US`` without one of its own, can't belong to an earlier record whatever came before. Cuts are
found by stretches of ``CHUNK_US``, so neither a task's rows nor its order spans a busy key's whole time, only what lies between two cuts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.operators.beacons import not_a_scan_source
from trafficlens.operators.connections import IDLE_US, KEY, SYN_IDLE_US, above_watermark, roles
from trafficlens.operators.portscan import in_tasks
from trafficlens.schemas import STANDARD_PORTS, UDP

#: At a flush: the least age of an unanswered record, and the idle time of any other
FLUSH_AGE_US, FLUSH_IDLE_US = 1_000_000, 3_000_000
CHUNK_US = 600_000_000

RECORD = "ts_us long, src_ip string, dst_ip string, dst_port string, conn_state string, duration double, orig_pkts double, resp_pkts double, history string"
KNOWN_RECORD = RECORD + ", known_us long"
STATE = "first_us long, last_us long, orig long, resp long, opened boolean, reset boolean, closed boolean"
FIELDS = [f.split()[0] for f in STATE.split(", ")]
STEP = ("timestamp_us", "seq", "own", "udp", "syn", "rst", "fin", "reply")


def over_us(c: dict, flush_us: int | None) -> int:
    """The first time at which a record is over if nothing else comes."""
    idle = SYN_IDLE_US if c["opened"] and not c["resp"] else IDLE_US
    over = c["last_us"] + idle + 1
    if flush_us:
        due = c["last_us"] + FLUSH_IDLE_US + 1
        if not c["resp"]:
            due = min(due, max(c["first_us"] + FLUSH_AGE_US, c["last_us"] + 1))
        over = min(over, -(-due // flush_us) * flush_us)
    return over


def record(key: tuple, c: dict) -> tuple:
    """A finished record's columns, but for when it was known."""
    if c["opened"] and not c["resp"]:
        state = "REJ" if c["reset"] else "S0"
    elif c["resp"] and c["reset"]:
        state = "RSTO"
    elif c["resp"] and c["closed"]:
        state = "SF"
    else:
        state = "OTH"
    history = "S" if state == "S0" and c["orig"] == 1 else "-"
    return (c["first_us"], key[0], key[1], str(key[2]), state, (c["last_us"] - c["first_us"]) / 1e6, float(c["orig"]), float(c["resp"]), history)


def step(key: tuple, c: dict | None, packet: tuple, flush_us: int | None, out: list[tuple]) -> dict | None:
    """The open record after a packet (values of STEP); finished ones go to ``out`` with the time they were known."""
    now, _, own, udp, syn, rst, fin, reply = packet
    if udp:
        out.append((now, key[0], key[1], str(key[2]), "SF", 0.0, 1.0, 0.0, "-", now))
        return c
    if c is not None and now >= over_us(c, flush_us):
        out.append((*record(key, c), over_us(c, flush_us)))
        c = None
    if not own:
        if c is not None:
            c["resp"] += 1
        return c
    if c is None:
        if reply:
            return None
        c = dict(zip(FIELDS, (now, now, 0, 0, False, False, False), strict=True))
    c["orig"] += 1
    c["last_us"] = now
    c["opened"] |= bool(syn and not reply)
    c["reset"] |= bool(rst)
    c["closed"] |= bool(fin)
    if rst or fin:
        out.append((*record(key, c), now))
        return None
    return c


def events(packets: DataFrame) -> DataFrame:
    """What moves records: each TCP packet in both of its roles, and UDP packets that are no service's answer."""
    tcp = roles(packets).withColumn("udp", F.lit(False))
    kept = (F.col("protocol") == UDP) & not_a_scan_source() & ~F.col("src_port").isin(*STANDARD_PORTS)
    udp = packets.where(above_watermark(kept) if "event_time" in packets.columns else kept)
    no = [F.lit(False).alias(c) for c in ("syn", "rst", "fin", "reply")]
    return tcp.unionByName(udp.select(*KEY, F.lit(True).alias("own"), F.lit(True).alias("udp"), "timestamp_us", "seq", *no)).select(*KEY, *STEP)


def _chunked(rows: DataFrame, chunk_us: int, most: int) -> DataFrame:
    """Rows (``most``, if known) with ``chunk``: those of one key and chunk depend on no others."""
    own, ts = F.col("own") & ~F.col("udp"), F.col("timestamp_us")
    order = Window.partitionBy(*KEY, "stretch").orderBy("timestamp_us", "seq", F.desc("own"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    pause = ts - F.last(F.when(own, ts), ignorenulls=True).over(before)
    ended = F.last(F.when(own, F.col("rst") | F.col("fin")), ignorenulls=True).over(before)
    rows = in_tasks(rows.withColumn("stretch", F.floor(ts / chunk_us)), (*KEY, "stretch"), most).withColumn("cut", F.coalesce(own & ((pause > IDLE_US) | ended), F.lit(False)))
    rows = rows.withColumn("after", F.max("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = rows.groupBy(*KEY, "stretch").agg(F.max("cut").alias("has"))
    earlier = Window.partitionBy(*KEY).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    came = stretches.select(*KEY, "stretch", F.last(F.when(F.col("has"), F.col("stretch")), ignorenulls=True).over(earlier).alias("came_from"))
    joined = rows.join(came, [*KEY, "stretch"])
    return joined.withColumn("chunk", F.when(F.col("after"), F.col("stretch")).otherwise(F.coalesce("came_from", F.lit(-(1 << 62))))).select(*KEY, "chunk", *STEP)


def flushed_records(packets: DataFrame, flush_us: int | None, chunk_us: int = CHUNK_US, most: int = 0) -> DataFrame:
    """All records of a batch, with known_us; ``most``, the number of packets, sizes the tasks."""
    group = [*KEY, "chunk"]
    dealt = _chunked(events(packets), chunk_us, 2 * most).repartition(*group).sortWithinPartitions(*group, "timestamp_us", "seq", F.desc("own"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, c, out = None, None, []
        for b in batches:
            for row in b.itertuples(index=False, name=None):
                if row[:4] != at:
                    if c is not None:
                        out.append((*record(at, c), over_us(c, flush_us)))
                    at, c = row[:4], None
                c = step(at, c, row[4:], flush_us, out)
            if out:
                yield pd.DataFrame(out, columns=[f.split()[0] for f in KNOWN_RECORD.split(", ")])
                out = []
        if c is not None:
            yield pd.DataFrame([(*record(at, c), over_us(c, flush_us))], columns=[f.split()[0] for f in KNOWN_RECORD.split(", ")])

    return dealt.mapInPandas(run, KNOWN_RECORD)
