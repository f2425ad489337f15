"""Command-and-control beacons: connection starts, endpoint summaries, and periodicity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.functions.numeric import severity
from trafficlens.operators.detect import WINDOW, alert
from trafficlens.schemas import STANDARD_PORTS, TCP, WINDOW_US

ENDPOINT = ("src_ip", "dst_ip", "dst_port")
# Fixed values of the periodicity rule.
HISTORY, LEAST_EVENTS, LEAST_GAP, MOST_GAP, MOST_SPAN = 256, 5, 1.0, 900.0, 3600.0
TTL_US = 1_800_000_000
LEAST_BYTES, MOST_CV, ALERT_AT, NOMINAL_BYTES = 200, 0.50, 0.7, 40


def not_a_scan_source() -> Column:
    """Broadcast, multicast, loopback and two content networks never count as scanners."""
    ip = F.col("src_ip")
    # The excluded endings, address and prefixes.
    excluded = ip.endswith(".255") | ip.endswith(".0") | (ip == "255.255.255.255")
    for prefix in ("224.", "239.", "162.159.", "127.", "104.16."):
        excluded = excluded | ip.startswith(prefix)
    return ~excluded


def connection_starts(packets: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """Initiating SYNs to high ports off the standard list, with their window."""
    starts = packets.where((F.col("protocol") == TCP) & F.col("syn") & ~F.col("ack") & (F.col("dst_port") > 1024) & ~F.col("dst_port").isin(*STANDARD_PORTS) & not_a_scan_source())
    w = F.floor(F.col("timestamp_us") / window_us) * window_us
    return starts.select(w.alias(WINDOW), *ENDPOINT, "timestamp_us", "seq")


def endpoint_summary(flows: DataFrame) -> DataFrame:
    """Per window and TCP endpoint: volume, resets, and established flows with data."""
    estab = (F.col("psh_count") > 0) & (F.col("bwd_packets") > 0)
    return (
        flows.where(F.col("protocol") == TCP)
        .groupBy(WINDOW, *ENDPOINT)
        .agg(
            F.sum("bwd_packets").alias("response_packets"),
            F.sum("total_bytes").alias("bytes"),
            F.sum("total_packets").alias("packets"),
            (F.sum(F.col("last_us") - F.col("start_us")) / 1e6).alias("duration"),
            F.count("*").alias("flows"),
            F.sum("rst_count").alias("rst_count"),
            F.count_if(estab).alias("established"),
            F.coalesce(F.sum(F.when(estab, F.col("total_bytes"))), F.lit(0)).alias("data_bytes"),
        )
    )


def qualified_starts(starts: DataFrame, summary: DataFrame) -> DataFrame:
    """Connection starts that are not bursts or closed ports, with the bytes that fall to each."""
    per_endpoint = Window.partitionBy(WINDOW, *ENDPOINT)
    joined = starts.withColumn("starts", F.count("*").over(per_endpoint)).join(summary, [WINDOW, *ENDPOINT], "left")
    seen = F.col("flows").isNotNull()
    burst = seen & (F.col("packets") / F.col("flows") > 60)
    closed = seen & (F.col("established") == 0) & (F.col("data_bytes") == 0)
    share = F.when(seen, F.floor(F.col("bytes") / F.col("starts"))).otherwise(NOMINAL_BYTES).cast("long")
    return joined.where(~burst & ~closed).select(WINDOW, *ENDPOINT, "timestamp_us", "seq", share.alias("bytes"))


def beacon_scores(events: DataFrame, key: tuple[str, ...] = ENDPOINT, ts: str = "ts", size: str = "bytes", order: str = "seq") -> DataFrame:
    """Periodicity of each key's last HISTORY events (``ts`` in seconds): gaps, jitter, confidence, is_beacon.

    The newest events are a group limit, so a busy key's other events go before the shuffle. ``total_bytes``
    is of all events, summed apart.
    """
    newest = Window.partitionBy(*key).orderBy(F.desc(ts), F.desc(order))
    in_time = Window.partitionBy(*key).orderBy(ts, order)
    last = events.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= HISTORY)
    totals = events.groupBy(*key).agg(F.sum(size).alias("total_bytes"))
    gap = F.col(ts) - F.lag(ts).over(in_time)
    gaps = last.withColumn("gap", gap).withColumn("gap", F.when(F.col("gap").between(LEAST_GAP, MOST_GAP), F.col("gap")))
    out = gaps.groupBy(*key).agg(
        F.count("*").alias("beacon_count"),
        (F.max(ts) - F.min(ts)).alias("span"),
        F.count("gap").alias("n_gaps"),
        F.avg("gap").alias("mean_interval"),
        F.stddev_pop("gap").alias("interval_std"),
    )
    return _judged(out.join(totals, list(key)))


def _judged(stats: DataFrame) -> DataFrame:
    """cv, confidence and is_beacon from beacon_count, span, n_gaps, mean_interval, interval_std and total_bytes."""
    out = stats.withColumn("cv", F.col("interval_std") / F.col("mean_interval"))
    regular = 1 - F.least(F.col("cv") / MOST_CV, F.lit(1.0))
    volume = F.least(F.col("n_gaps") / 20.0, F.lit(1.0))
    confidence = F.least(0.70 + 0.29 * (0.6 * regular + 0.4 * volume), F.lit(0.99))
    hit = (
        (F.col("beacon_count") >= LEAST_EVENTS)
        & (F.col("span") <= MOST_SPAN)
        & (F.col("n_gaps") >= LEAST_EVENTS - 1)
        & (F.col("mean_interval") >= LEAST_GAP)
        & (F.col("total_bytes") >= LEAST_BYTES)
        & (F.col("cv") <= MOST_CV)
        & (confidence >= ALERT_AT)
    )
    return out.withColumn("confidence", confidence).withColumn("is_beacon", F.coalesce(hit, F.lit(False)))


def histories(starts: DataFrame) -> DataFrame:
    """For each endpoint and window with starts: its history at the window's end, in whole microseconds.

    The history is the last HISTORY starts since a pause of over TTL_US, which forgets the endpoint. ``streaming.state`` keeps
    the same.
    """
    by = Window.partitionBy(*ENDPOINT).orderBy("timestamp_us", "seq")
    pause = F.col("timestamp_us") - F.lag("timestamp_us").over(by)
    rows = starts.withColumn("life", F.sum((F.coalesce(pause, F.lit(0)) > TTL_US).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    life = Window.partitionBy(*ENDPOINT, "life").orderBy("timestamp_us", "seq")
    gap = F.col("timestamp_us") - F.lag("timestamp_us").over(life)
    rows = rows.withColumn("gap", F.when(gap.between(int(LEAST_GAP * 1e6), int(MOST_GAP * 1e6)), gap))
    kept, gaps = life.rowsBetween(-(HISTORY - 1), 0), life.rowsBetween(-(HISTORY - 2), 0)
    square = F.col("gap").cast("decimal(19,0)") * F.col("gap").cast("decimal(19,0)")
    rows = rows.select(
        *ENDPOINT, WINDOW, F.lead(WINDOW).over(life).alias("next_window"),
        F.count("*").over(kept).alias("beacon_count"), F.min("timestamp_us").over(kept).alias("first_us"), F.col("timestamp_us").alias("last_us"),
        F.count("gap").over(gaps).alias("n_gaps"), F.coalesce(F.sum("gap").over(gaps), F.lit(0)).alias("gap_sum"),
        F.coalesce(F.sum(square).over(gaps), F.lit(0)).cast("decimal(38,0)").alias("gap_squares"), F.sum("bytes").over(life.rowsBetween(Window.unboundedPreceding, 0)).alias("total_bytes"),
    )
    return rows.where(F.col("next_window").isNull() | (F.col("next_window") != F.col(WINDOW))).drop("next_window")


def history_scores(found: DataFrame) -> DataFrame:
    """The verdict on each history; the same numbers from a batch and from a stream, as the sums are whole."""
    mean = F.col("gap_sum") / F.col("n_gaps")
    variance = F.col("gap_squares").cast("double") / F.col("n_gaps") - mean * mean
    stats = {"span": (F.col("last_us") - F.col("first_us")) / 1e6, "mean_interval": mean / 1e6, "interval_std": F.sqrt(F.greatest(variance, F.lit(0.0))) / 1e6}
    return _judged(found.withColumns({k: F.when(F.col("n_gaps") > 0, v) if k != "span" else v for k, v in stats.items()}))


def beacon_alerts(scores: DataFrame, window_us: Column) -> DataFrame:
    evidence = {
        "beacon_count": F.col("beacon_count"),
        "mean_interval_sec": F.round("mean_interval", 2),
        "jitter_cv": F.round("cv", 3),
        "interval_std_sec": F.round("interval_std", 2),
        "total_bytes": F.col("total_bytes"),
    }
    hits = scores.where("is_beacon").withColumn(WINDOW, window_us).withColumn("severity", severity("C2_BEACONING", F.col("confidence")))
    return alert(hits, "C2_BEACONING", evidence)
