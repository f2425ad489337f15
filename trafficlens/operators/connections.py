"""Connection records from packets, in batch.

A TCP record belongs to a directed key: source, destination and destination port. Packets on
the key update it, and packets of its peer (the reverse way, from the key's port) count as
responses while it is open. A server's reply never opens a record. A record ends with its own
RST or FIN, or idle: after ``SYN_IDLE_US`` if it has a SYN and no response, else after
``IDLE_US``. Time is event time, so a record is over once its idle time has passed, whether
or not another packet comes. A UDP packet is a record of its own.

The rules look sequential, but a key's packets need one ordered pass: a pause over ``SYN_IDLE_US``
ends an unanswered record if a SYN came since the pause before, and once a response has
reached a record nothing but RST, FIN or a pause over ``IDLE_US`` ends it. So every
decision is a running value in one window, and no key is gathered. ``streaming.state``
keeps the same records for streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.operators.beacons import not_a_scan_source
from trafficlens.schemas import STANDARD_PORTS, TCP, UDP

SYN_IDLE_US, IDLE_US = 3_000_000, 30_000_000
KEY = ("src_ip", "dst_ip", "dst_port")


def server_reply() -> Column:
    """From a service port to a high port, and no initiating SYN."""
    initiating = F.col("syn") & ~F.col("ack")
    return ~initiating & (F.col("src_port").isin(*STANDARD_PORTS) | (F.col("src_port") < 1024)) & (F.col("dst_port") > 1024)


def above_watermark(condition: Column) -> Column:
    """The same filter for rows with ``event_time``, but one that isn't pushed below the watermark: rows that it drops move it too."""
    return condition | F.col("event_time").isNull()


def roles(packets: DataFrame) -> DataFrame:
    """Each TCP packet twice: on its own key, and as a response on its peer's key."""
    kept = (F.col("protocol") == TCP) & not_a_scan_source()
    kept = packets.where(above_watermark(kept) if "event_time" in packets.columns else kept).withColumn("reply", server_reply())
    own = F.struct("src_ip", "dst_ip", "dst_port", F.lit(True).alias("own"))
    response = F.struct(F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"), F.col("src_port").alias("dst_port"), F.lit(False).alias("own"))
    return kept.select("timestamp_us", "seq", "syn", "rst", "fin", "reply", F.explode(F.array(own, response)).alias("k")).select("k.*", "timestamp_us", "seq", "syn", "rst", "fin", "reply")


def udp_records(packets: DataFrame, state: str = "SF") -> DataFrame:
    """One record for each UDP packet that is no service's answer."""
    kept = packets.where((F.col("protocol") == UDP) & not_a_scan_source() & ~F.col("src_port").isin(*STANDARD_PORTS))
    return kept.select(
        F.col("timestamp_us").alias("ts_us"), "src_ip", "dst_ip", F.col("dst_port").cast("string").alias("dst_port"), F.lit(state).alias("conn_state"),
        F.lit(0.0).alias("duration"), F.lit(1.0).alias("orig_pkts"), F.lit(0.0).alias("resp_pkts"), F.lit("-").alias("history"),
    )


def tcp_records(packets: DataFrame, syn_idle_us: int = SYN_IDLE_US, idle_us: int = IDLE_US) -> DataFrame:
    """TCP records: S0 for SYNs without a response, REJ if it reset them itself; RSTO, SF or OTH once answered."""
    order = Window.partitionBy(*KEY).orderBy("timestamp_us", "seq", F.desc("own"))
    before, now = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    own, fresh = F.col("own"), F.col("own") & ~F.col("reply")
    last = lambda condition, frame=now: F.coalesce(F.last(F.when(condition, F.col("n")), ignorenulls=True).over(frame), F.lit(0))

    rows = roles(packets).withColumns(
        {
            "n": F.row_number().over(order),
            "pause": F.col("timestamp_us") - F.last(F.when(own, F.col("timestamp_us")), ignorenulls=True).over(before),
            "ended": F.coalesce(F.last(F.when(own, F.col("rst") | F.col("fin")), ignorenulls=True).over(before), F.lit(True)),
        }
    )
    rows = rows.withColumn("opens", own & (F.col("ended") | (F.col("pause") > idle_us))).withColumn("breaks", F.col("opens") | (own & (F.col("pause") > syn_idle_us)))
    # a run: packets without a pause over syn_idle_us; fresh_at: the last packet that may open a record
    rows = rows.withColumns({"segment_at": last(F.col("opens")), "run_at": last(F.col("breaks")), "syn_at": last(fresh & F.col("syn")), "fresh_at": last(fresh)})
    rows = rows.withColumn("run_syn", F.col("syn_at") >= F.col("run_at"))
    rows = rows.withColumn("unanswered_end", F.col("breaks") & ~F.col("opens") & F.coalesce(F.lag("run_syn").over(order), F.lit(False)))
    rows = rows.withColumn("first_at", last(F.col("opens") | F.col("unanswered_end")))
    # a segment's first response, found as if none had come before it, is one; it keeps its record open
    in_time = ~own & ~F.col("ended") & (F.col("fresh_at") >= F.col("first_at")) & (F.col("pause") <= F.when(F.col("run_syn"), syn_idle_us).otherwise(idle_us))
    rows = rows.withColumn("in_time", in_time).withColumn("answered", last(F.col("in_time"), before) >= F.col("segment_at"))
    rows = rows.withColumn("record", last(F.col("opens") | (F.col("unanswered_end") & ~F.col("answered"))))
    response = ~own & ~F.col("ended") & (F.col("pause") <= F.when(F.col("run_syn") & ~F.col("answered"), syn_idle_us).otherwise(idle_us))
    rows = rows.where((F.col("fresh_at") >= F.col("record")) & (F.col("record") > 0)).withColumn("response", response).where(own | F.col("response"))
    out = rows.groupBy(*KEY, "record").agg(
        F.min(F.when(own, F.col("timestamp_us"))).alias("ts_us"),
        F.max(F.when(own, F.col("timestamp_us"))).alias("last_us"),
        F.count_if(own).cast("double").alias("orig_pkts"),
        F.count_if(~own).cast("double").alias("resp_pkts"),
        F.bool_or(fresh & F.col("syn")).alias("opened"),
        F.bool_or(own & F.col("rst")).alias("reset"),
        F.bool_or(own & F.col("fin")).alias("closed"),
    )
    answered = F.col("resp_pkts") > 0
    state = (
        F.when(F.col("opened") & ~answered, F.when(F.col("reset"), "REJ").otherwise("S0"))
        .when(answered & F.col("reset"), "RSTO")
        .when(answered & F.col("closed"), "SF")
        .otherwise("OTH")
    )
    out = out.withColumn("conn_state", state)
    history = F.when((F.col("conn_state") == "S0") & (F.col("orig_pkts") == 1), "S").otherwise("-")
    duration = ((F.col("last_us") - F.col("ts_us")) / 1e6).alias("duration")
    return out.select("ts_us", "src_ip", "dst_ip", F.col("dst_port").cast("string").alias("dst_port"), "conn_state", duration, "orig_pkts", "resp_pkts", history.alias("history"))


def records(packets: DataFrame) -> DataFrame:
    return tcp_records(packets).unionByName(udp_records(packets))
