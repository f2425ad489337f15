"""Rule detectors on flows: floods, encrypted sessions, exfiltration, and the claims between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.functions.numeric import or_zero, ratio, severity
from trafficlens.schemas import MODEL_VERSION, STANDARD_PORTS, TCP

WINDOW = "window_us"


def source_profile(packets: DataFrame, window_us: int) -> DataFrame:
    """Per window and source: targets, flags and sizes. ``port_entropy`` is over the set of ports, so its log2."""
    w = (F.floor(F.col("timestamp_us") / window_us) * window_us).alias(WINDOW)
    n, ports = F.count("*"), F.count_distinct("dst_port")
    return packets.groupBy(w, "src_ip").agg(
        ports.alias("unique_dst_ports"),
        F.count_distinct("dst_ip").alias("unique_dst_ips"),
        n.alias("packets"),
        F.count_if("syn").alias("syn_count"),
        F.count_if("rst").alias("rst_count"),
        (F.count_if("syn") / n).alias("syn_ratio"),
        (F.count_if("rst") / n).alias("rst_ratio"),
        F.log2(ports).alias("port_entropy"),
        or_zero(F.stddev_pop("packet_len")).alias("packet_len_std"),
        (n / (window_us / 1e6)).alias("packets_per_sec"),
    )


def destination_load(flows: DataFrame) -> DataFrame:
    """Per window and TCP destination: volume, fan-out, and the first flow's source and port."""
    order = F.concat(F.lpad(F.col("start_us").cast("string"), 20, "0"), F.col("flow_key"))
    return (
        flows.where(F.col("protocol") == TCP)
        .groupBy(WINDOW, "dst_ip")
        .agg(
            F.sum("total_packets").alias("packets"),
            F.sum("total_bytes").alias("bytes"),
            F.sum("fwd_bytes").alias("fwd_bytes"),
            F.sum("bwd_bytes").alias("bwd_bytes"),
            F.count("*").alias("flows"),
            F.sum("syn_count").alias("syn_count"),
            F.count_distinct("dst_port").alias("unique_dst_ports"),
            F.sum("bwd_packets").alias("response_packets"),
            F.min("start_us").alias("first_us"),
            F.max("last_us").alias("last_us"),
            F.min_by("src_ip", order).alias("src_ip"),
            F.min_by("dst_port", order).alias("dst_port"),
        )
        .withColumn("duration", F.greatest((F.col("last_us") - F.col("first_us")) / 1e6, F.lit(0.001)))
        .withColumn("packet_rate", F.col("packets") / F.col("duration"))
    )


def _scan_shaped() -> Column:
    return F.col("unique_dst_ports") >= 20


def _flood() -> Column:
    upload = (F.col("fwd_bytes") > 100_000) & (F.col("fwd_bytes") > 4 * F.greatest("bwd_bytes", F.lit(1)))
    fast = (F.col("packets") >= 500) & (F.col("packet_rate") >= 200) & (F.col("flows") >= 10)
    many = (F.col("flows") >= 200) & (F.col("duration") < 15) & (F.col("unique_dst_ports") <= 5)
    return ~_scan_shaped() & ~((F.col("flows") <= 3) & upload) & (fast | many)


def flood_decisions(load: DataFrame) -> DataFrame:
    """Destinations with scan_shaped, is_flood, confidence and severity."""
    graded = F.least(0.90 + F.least(F.col("packet_rate") / 5000, F.lit(0.09)), F.lit(0.99))
    score = F.when((F.col("flows") >= 500) | (F.col("packet_rate") >= 2000), 0.99).otherwise(graded)
    out = load.withColumn("scan_shaped", _scan_shaped()).withColumn("is_flood", _flood())
    out = out.withColumn("confidence", F.when(F.col("is_flood"), score))
    return out.withColumn("severity", F.when(F.col("is_flood"), severity("DDoS", F.col("confidence"))))


def encrypted_sessions(flows: DataFrame) -> DataFrame:
    """Repeated answered TCP sessions per endpoint off the standard ports, with the session rule's verdict."""
    port = F.col("dst_port")
    kept = flows.where((F.col("protocol") == TCP) & ~port.isin(*STANDARD_PORTS) & (port > 1024) & (F.col("bwd_packets") > 0))
    out = kept.groupBy(WINDOW, "src_ip", "dst_ip", "dst_port").agg(
        F.count("*").alias("sessions"), F.sum("total_bytes").alias("bytes"), F.sum("fwd_bytes").alias("fwd_bytes"), F.sum("psh_count").alias("psh"), F.sum("total_packets").alias("packets")
    )
    per = {f"{c}_per_session": F.col(c) / F.col("sessions") for c in ("bytes", "fwd_bytes", "psh")}
    out = out.withColumns(per)
    hit = (F.col("sessions") >= 3) & (F.col("fwd_bytes_per_session") >= 500) & (F.col("bytes_per_session") >= 700) & (F.col("psh_per_session") >= 3)
    return out.withColumn("is_encrypted_malware", hit)


def exfiltration_decisions(flows: DataFrame, model_score: Column | None = None, threshold: float = 0.98997) -> DataFrame:
    """Uploads of TCP flows: the volume rules lift a model's score (0 without a model)."""
    kept = flows.where((F.col("protocol") == TCP) & (F.col("total_packets") >= 3) & (F.col("fwd_bytes") >= 1000))
    up = ratio(F.col("fwd_bytes"), F.col("bwd_bytes"))
    base = F.lit(0.0) if model_score is None else model_score
    lifted = F.when((F.col("fwd_bytes") > 500_000) & (up > 5), F.greatest(base, F.lit(0.995))).when((F.col("fwd_bytes") > 100_000) & (up > 10), F.greatest(base, F.lit(0.992))).otherwise(base)
    out = kept.withColumn("up_down_ratio", up).withColumn("confidence", lifted)
    return out.withColumn("is_exfiltration", F.col("confidence") >= threshold).withColumn("severity", severity("DataExfiltration", F.col("confidence")))


def claims(floods: DataFrame, sessions: DataFrame, scanners: DataFrame | None = None) -> DataFrame:
    """Entities that a detector has claimed in a window: kind (dst or src) and ip."""

    def entity(df: DataFrame, kind: str, ip: str) -> DataFrame:
        return df.select(WINDOW, F.lit(kind).alias("kind"), F.col(ip).alias("ip"))

    parts = [
        entity(floods.where("is_flood"), "dst", "dst_ip"),
        entity(floods.where("scan_shaped"), "src", "src_ip"),
        entity(sessions.where("is_encrypted_malware"), "dst", "dst_ip"),
    ]
    if scanners is not None:
        parts.append(entity(scanners, "src", "src_ip"))
    return reduce(DataFrame.unionByName, parts).distinct()


def unclaimed(events: DataFrame, claimed: DataFrame) -> DataFrame:
    """Rows whose destination and source nobody has claimed in their window."""
    dsts = claimed.where("kind = 'dst'").select(WINDOW, F.col("ip").alias("dst_ip"))
    srcs = claimed.where("kind = 'src'").select(WINDOW, F.col("ip").alias("src_ip"))
    return events.join(dsts, [WINDOW, "dst_ip"], "left_anti").join(srcs, [WINDOW, "src_ip"], "left_anti")


def alert(df: DataFrame, threat_class: str, evidence: dict[str, Column], src_port: Column | None = None, dst_ip: Column | None = None, dst_port: Column | None = None) -> DataFrame:
    """Pipeline alerts from rows with window_us, src_ip, dst_ip, dst_port, confidence, severity.

    The id is a digest of the alert's identity, so a retried write gives the same row.
    """
    sport, dip, dport = src_port if src_port is not None else F.lit(0), dst_ip if dst_ip is not None else F.col("dst_ip"), dst_port if dst_port is not None else F.col("dst_port")
    flow_id = F.concat(F.col("src_ip"), F.lit(":"), sport, F.lit("-"), dip, F.lit(":"), dport)
    return df.select(
        F.sha2(F.concat_ws("|", F.lit(threat_class), F.col(WINDOW), flow_id), 256).alias("alert_id"),
        (F.col(WINDOW) / 1e6).alias("timestamp"),
        F.lit(threat_class).alias("threat_class"),
        F.round("confidence", 4).alias("confidence"),
        "severity",
        "src_ip",
        dip.alias("dst_ip"),
        sport.cast("int").alias("src_port"),
        dport.cast("int").alias("dst_port"),
        flow_id.alias("flow_id"),
        F.to_json(F.struct(*(c.alias(n) for n, c in evidence.items()))).alias("evidence"),
        F.lit(MODEL_VERSION).alias("model_version"),
    )


def flood_alerts(decisions: DataFrame) -> DataFrame:
    evidence = {
        "duration_sec": F.round("duration", 2),
        "total_bytes": F.col("bytes"),
        "total_packets": F.col("packets"),
        "connection_count": F.col("flows"),
        "bytes_per_sec": F.round(F.col("bytes") / F.col("duration"), 1),
        "pkts_per_sec": F.round("packet_rate", 1),
        "syn_count": F.col("syn_count"),
    }
    return alert(decisions.where("is_flood"), "DDoS", evidence)


def encrypted_session_alerts(sessions: DataFrame) -> DataFrame:
    evidence = {
        "session_count": F.col("sessions"),
        "bytes_per_session": F.round("bytes_per_session", 1),
        "fwd_bytes_per_session": F.round("fwd_bytes_per_session", 1),
        "psh_per_session": F.round("psh_per_session", 1),
        "total_bytes": F.col("bytes"),
        "dst_port": F.col("dst_port"),
    }
    scored = sessions.where("is_encrypted_malware").withColumn("confidence", F.lit(0.90))
    return alert(scored.withColumn("severity", severity("EncryptedMalware", F.col("confidence"))), "EncryptedMalware", evidence)


def exfiltration_alerts(decisions: DataFrame) -> DataFrame:
    evidence = {
        "duration_sec": F.round("duration", 2),
        "fwd_bytes": F.col("fwd_bytes"),
        "bwd_bytes": F.col("bwd_bytes"),
        "up_down_ratio": F.round("up_down_ratio", 2),
        "fwd_packets": F.col("fwd_packets"),
        "bwd_packets": F.col("bwd_packets"),
        "response_ratio": F.round(ratio(F.col("bwd_packets"), F.col("fwd_packets")), 3),
        "bytes_per_sec": F.round(F.col("total_bytes") / F.col("duration"), 1),
    }
    return alert(decisions.where("is_exfiltration"), "DataExfiltration", evidence, F.col("src_port"))


def model_alerts(flow_rows: DataFrame, scored: DataFrame, threat_class: str, threshold: float) -> DataFrame:
    """Alerts of flows whose ``probability`` under a class's model reaches the threshold."""
    hits = scored.where(F.col("probability") >= threshold).select(WINDOW, "flow_key", F.col("probability").alias("confidence"))
    rows = flow_rows.join(hits, [WINDOW, "flow_key"]).withColumn("severity", severity(threat_class, F.col("confidence")))
    evidence = {
        "duration_sec": F.round("duration", 2),
        "total_bytes": F.col("total_bytes"),
        "total_packets": F.col("total_packets"),
        "fwd_bytes": F.col("fwd_bytes"),
        "bwd_bytes": F.col("bwd_bytes"),
        "bytes_per_sec": F.round(F.col("total_bytes") / F.col("duration"), 1),
    }
    return alert(rows, threat_class, evidence, F.col("src_port"))


def arbitrated(scores: dict[str, Column]) -> tuple[Column, Column]:
    """Class and confidence of the greatest score among several models' attack labels."""
    best = F.greatest(*scores.values())
    name = reduce(lambda acc, x: acc.when(x[1] == best, x[0]), list(scores.items())[1:], F.when(next(iter(scores.values())) == best, next(iter(scores))))
    return name, best
