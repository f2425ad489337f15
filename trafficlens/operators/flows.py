"""Bidirectional flows from packets, and the feature vectors computed from a flow.

A flow is all packets of one unordered endpoint pair and protocol inside one window
of event time. The first packet (by time, then ``seq``) says which side is forward.
All of it is one shuffle on (window, flow key): direction and gaps are window
functions over the partitions that the final aggregation uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.functions.numeric import or_zero, ratio
from trafficlens.schemas import COMMON_PORTS, TCP, WEB_PORTS, WINDOW_US

KEY = ("window_us", "flow_key")


def flow_key() -> Column:
    """Endpoints in string order, then the protocol."""
    a, b = F.concat_ws(":", "src_ip", "src_port"), F.concat_ws(":", "dst_ip", "dst_port")
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b), F.col("protocol"))


def keyed(packets: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """Packets with the start of their window and their flow key."""
    return packets.withColumn("window_us", F.floor(F.col("timestamp_us") / window_us) * window_us).withColumn("flow_key", flow_key())


def directed(packets: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """Keyed packets with ``fwd``, the first packet's endpoints, and the gap to the last packet of the same direction."""
    in_flow = Window.partitionBy(*KEY).orderBy("timestamp_us", "seq")
    one_way = Window.partitionBy(*KEY, "fwd").orderBy("timestamp_us", "seq")
    first = {f"first_{c}": F.first(c).over(in_flow) for c in ("src_ip", "src_port", "dst_ip", "dst_port")}
    out = keyed(packets, window_us).withColumns(first)
    out = out.withColumn("fwd", (F.col("src_ip") == F.col("first_src_ip")) & (F.col("src_port") == F.col("first_src_port")))
    gap = F.col("timestamp_us") - F.lag("timestamp_us").over(one_way)
    return out.withColumn("gap_us", F.when(gap > 0, gap))


def assembled(packets: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """One row for each flow: endpoints, times, counts, flags, and statistics of sizes and gaps (seconds)."""
    fwd, size, gap = F.col("fwd"), F.col("packet_len"), F.col("gap_us")

    def of(side: Column, x: Column) -> Column:
        return F.when(side, x)

    flags = [F.count_if(c).alias(f"{c}_count") for c in ("syn", "ack", "rst", "fin", "psh")]
    sides = []
    for name, side in (("fwd", fwd), ("bwd", ~fwd)):
        sides += [
            F.count_if(side).alias(f"{name}_packets"),
            F.coalesce(F.sum(of(side, size)), F.lit(0)).cast("long").alias(f"{name}_bytes"),
            or_zero(F.avg(of(side, size))).alias(f"{name}_size_mean"),
            or_zero(F.stddev_pop(of(side, size))).alias(f"{name}_size_std"),
            F.coalesce(F.max(of(side, size)), F.lit(0)).alias(f"{name}_size_max"),
            F.count(of(side, gap)).alias(f"{name}_gaps"),
            (F.avg(of(side, gap)) / 1e6).alias(f"{name}_gap_mean"),
            or_zero(F.stddev_pop(of(side, gap)) / 1e6).alias(f"{name}_gap_std"),
        ]
    return (
        directed(packets, window_us)
        .groupBy(*KEY)
        .agg(
            F.first("protocol").alias("protocol"),
            *(F.first(f"first_{c}").alias(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port")),
            F.min("timestamp_us").alias("start_us"),
            F.max("timestamp_us").alias("last_us"),
            *flags,
            *sides,
            F.avg(size).alias("size_mean"),
            F.stddev_pop(size).alias("size_std"),
            F.var_pop(size).alias("size_var"),
            F.max(size).alias("size_max"),
            F.min(size).alias("size_min"),
            or_zero(F.avg(gap) / 1e6).alias("gap_mean"),
            or_zero(F.stddev_pop(gap) / 1e6).alias("gap_std"),
            or_zero(F.max(gap) / 1e6).alias("gap_max"),
            or_zero(F.min(gap) / 1e6).alias("gap_min"),
        )
        .withColumn("duration", F.greatest((F.col("last_us") - F.col("start_us")) / 1e6, F.lit(0.001)))
        .withColumn("total_packets", F.col("fwd_packets") + F.col("bwd_packets"))
        .withColumn("total_bytes", F.col("fwd_bytes") + F.col("bwd_bytes"))
    )


def _per_packet(name: str) -> Column:
    return ratio(F.col(f"{name}_count"), F.col("total_packets"))


def _gaps(name: str) -> tuple[Column, Column]:
    """Mean (the duration without gaps) and deviation of one direction's gaps."""
    return F.coalesce(F.col(f"{name}_gap_mean"), F.col("duration")), F.col(f"{name}_gap_std")


def regularity(floor: float = 0.0) -> Column:
    """1 - min(mean deviation / mean gap, 1) over both directions; 0 for a mean gap under ``floor``."""
    (fm, fs), (bm, bs) = _gaps("fwd"), _gaps("bwd")
    mean, std = (fm + bm) / 2, (fs + bs) / 2
    value = 1 - F.least(std / F.greatest(mean, F.lit(0.001)), F.lit(1.0))
    return F.when(mean < floor, 0.0).otherwise(value) if floor else value


def to_one_host() -> Column:
    """False for multicast and broadcast destinations, which no flow model scores."""
    ip = F.col("dst_ip")
    # The excluded prefixes and address.
    return ~(ip.startswith("224.") | ip.startswith("239.") | (ip == "255.255.255.255") | ip.startswith("ff02:"))


def legacy_vector(flows: DataFrame) -> DataFrame:
    """The 23-feature flow vector; times in microseconds."""
    micro = 1e6
    return flows.select(
        *KEY,
        (F.col("duration") * micro).alias("flow_duration"),
        F.col("fwd_packets").alias("total_fwd_packets"),
        F.col("bwd_packets").alias("total_bwd_packets"),
        (F.col("total_bytes") / F.col("duration")).alias("flow_bytes_per_sec"),
        (F.col("total_packets") / F.col("duration")).alias("flow_packets_per_sec"),
        *((F.col(f"gap_{s}") * micro).alias(f"flow_iat_{s}") for s in ("mean", "std", "max", "min")),
        *((or_zero(F.col(f"{d}_gap_mean")) * micro).alias(f"{d}_iat_mean") for d in ("fwd", "bwd")),
        *(F.col(f"{d}_size_mean").alias(f"{d}_packet_len_mean") for d in ("fwd", "bwd")),
        F.col("size_var").alias("packet_len_variance"),
        (F.col("total_bytes") / F.col("total_packets")).alias("avg_packet_size"),
        *(F.col(f"{c}_count").alias(f"{c}_flag_count") for c in ("syn", "ack", "rst", "fin", "psh")),
        ratio(F.col("bwd_bytes"), F.col("fwd_bytes")).alias("down_up_ratio"),
        "fwd_bytes",
        "bwd_bytes",
    )


def _rates() -> dict[str, Column]:
    (fm, fs), (bm, bs) = _gaps("fwd"), _gaps("bwd")
    return {
        "bytes_per_sec": F.col("total_bytes") / F.col("duration"),
        "pkts_per_sec": F.col("total_packets") / F.col("duration"),
        "fwd_bytes_per_pkt": ratio(F.col("fwd_bytes"), F.col("fwd_packets")),
        "bwd_bytes_per_pkt": ratio(F.col("bwd_bytes"), F.col("bwd_packets")),
        "fwd_iat_mean": fm,
        "fwd_iat_std": fs,
        "bwd_iat_mean": bm,
        "bwd_iat_std": bs,
        "bytes_ratio": ratio(F.col("fwd_bytes"), F.col("total_bytes")),
        "pkt_ratio": ratio(F.col("fwd_packets"), F.col("total_packets")),
    }


def _named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


_VOLUME = ("duration", "total_bytes", "total_packets", "fwd_bytes", "bwd_bytes", "fwd_packets", "bwd_packets")


#: Which flows a vector is made of, and its features
Vector = tuple[Column, list[Column]]


def _made(flows: DataFrame, vector: Vector) -> DataFrame:
    return flows.where(vector[0]).select(*KEY, *vector[1])


def flood_vector(flows: DataFrame) -> DataFrame:
    """The 31-feature vector of flows with at least five packets."""
    return _made(flows, flood_columns())


def flood_columns() -> Vector:
    bucket = F.when(F.col("duration") < 0.1, 0).when(F.col("duration") < 1, 1).when(F.col("duration") < 10, 2).otherwise(3)
    return F.col("total_packets") >= 5, [
        *map(F.col, _VOLUME),
        *_named(_rates()),
        *map(F.col, ("size_mean", "size_std", "size_max", "size_min")),
        *(_per_packet(c).alias(f"{c}_ratio") for c in ("syn", "ack", "rst", "fin", "psh")),
        F.col("syn_count"),
        ratio(F.col("bwd_bytes"), F.col("fwd_bytes")).alias("down_up_ratio"),
        F.col("dst_port"),
        F.col("dst_port").isin(*COMMON_PORTS).cast("int").alias("is_common_port"),
        bucket.alias("duration_bucket"),
    ]


def _high_port() -> Column:
    return ((F.col("dst_port") > 1024) & ~F.col("dst_port").isin(443, 8443, 8080)).cast("int")


def exfiltration_vector(flows: DataFrame) -> DataFrame:
    """The 29-feature vector of TCP flows with at least three packets and 1,000 bytes sent."""
    return _made(flows, exfiltration_columns())


def exfiltration_columns() -> Vector:
    return (F.col("protocol") == TCP) & (F.col("total_packets") >= 3) & (F.col("fwd_bytes") >= 1000), [
        *(F.col(c) for c in _VOLUME if c != "total_packets"),
        *_named(_rates()),
        F.col("fwd_size_std").alias("fwd_pkt_size_std"),
        F.col("bwd_size_std").alias("bwd_pkt_size_std"),
        regularity().alias("iat_regularity"),
        ratio(F.col("fwd_bytes"), F.col("bwd_bytes")).alias("up_down_ratio"),
        F.col("dst_port"),
        (F.col("dst_port") == 443).cast("int").alias("is_std_https"),
        _high_port().alias("is_high_port"),
        *(_per_packet(c).alias(f"{c}_ratio") for c in ("syn", "ack", "psh", "fin")),
        (F.col("fwd_packets") / F.col("duration")).alias("fwd_burst_rate"),
        ratio(F.col("bwd_packets"), F.col("fwd_packets")).alias("response_ratio"),
    ]


def encrypted_vector(flows: DataFrame, abstain: bool = True) -> DataFrame:
    """The 31-feature vector of TCP flows on which encrypted-session scoring doesn't abstain."""
    return _made(flows, encrypted_columns(abstain))


def encrypted_columns(abstain: bool = True) -> Vector:
    scored = (
        (F.col("duration") >= 5)
        & ((F.col("fwd_gaps") >= 2) | (F.col("bwd_gaps") >= 2))
        & ~((F.col("fwd_bytes") > 10_000) & (F.col("bwd_bytes") > 10_000))
        & (F.col("total_bytes") / F.col("duration") <= 100_000)
        & ~F.col("dst_port").isin(*WEB_PORTS)
    )
    kept = (F.col("protocol") == TCP) & (F.col("total_packets") >= 6)
    return kept & scored if abstain else kept, [
        *map(F.col, _VOLUME),
        *_named(_rates()),
        F.col("fwd_size_std").alias("fwd_pkt_size_std"),
        F.col("bwd_size_std").alias("bwd_pkt_size_std"),
        F.col("fwd_size_max").alias("fwd_pkt_size_max"),
        F.col("bwd_size_max").alias("bwd_pkt_size_max"),
        regularity(0.1).alias("iat_regularity"),
        F.col("dst_port"),
        (F.col("dst_port") == 443).cast("int").alias("is_std_https"),
        _high_port().alias("is_high_port"),
        *(_per_packet(c).alias(f"{c}_ratio") for c in ("syn", "ack", "psh", "rst", "fin")),
        ratio(F.col("bwd_bytes"), F.col("fwd_bytes")).alias("down_up_ratio"),
    ]
