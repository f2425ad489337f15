"""Sliding windows of connection records per source, and the scan decision on them.

Records are shuffled once, by source and a bucket of neighbouring windows; only those near a
bucket's start go to two. Gaps are taken in one pass over a bucket, and records are dealt to their
overlapping windows of an epoch-aligned grid inside the partitions, where
every count, entropy and gap is summed. A busy source is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.functions.numeric import or_zero, rounded, severity
from trafficlens.schemas import FAILED_STATES

KEY = ("src_ip", "start_us")
#: Windows' lengths in a bucket
SPAN = 16
#: Rows of a task once they are dealt to their windows; their sums take some 2 kB each
TASK_ROWS = 250_000
#: The calibrated probability at which a candidate alerts
ALERT_AT = 0.60
# The model's features in its order.
FEATURES = (
    "unique_dst_ports", "unique_dst_hosts", "max_ports_to_single_host", "max_hosts_on_single_port", "ports_per_host", "dst_port_entropy", "fanout_ratio",
    "connection_attempts", "connections_per_sec", "failed_conn_ratio", "s0_ratio", "rej_ratio", "resp_ratio", "zero_resp_ratio", "avg_pkts_per_conn",
    "avg_duration", "iat_cv", "syn_only_ratio",
)


def dealt(flows: DataFrame, window_s: float, stride_s: float, ts: str = "ts_us", origin_us: int = 0) -> DataFrame:
    """Each row once for every window [start_us, start_us + window) on the grid that holds it."""
    w, s = int(window_s * 1_000_000), int(stride_s * 1_000_000)
    last = F.floor((F.col(ts) - origin_us) / s) * s + origin_us
    first = last - (-(-w // s) - 1) * s
    out = flows.withColumn("start_us", F.explode(F.sequence(first.cast("long"), last.cast("long"), F.lit(s).cast("long"))))
    return out.where(F.col(ts) < F.col("start_us") + w)


def in_tasks(rows: DataFrame, key: tuple[str, ...], most: int) -> DataFrame:
    """``rows`` shuffled by key to as many tasks as ``most`` rows, once dealt to their windows, need at some ``TASK_ROWS`` each.

    A shuffle's own number of partitions, and their size after adaptive coalescing, know nothing of what rows take once they are
    multiplied and summed, so large tasks hold, and spill, many times the input.
    """
    tasks = -(-most // TASK_ROWS)
    if tasks <= 1:
        return rows.repartition(*key)
    return rows.repartition(max(tasks, rows.sparkSession.sparkContext.defaultParallelism), *key)


def dealt_in_buckets(flows: DataFrame, key: tuple[str, ...], window_s: float, stride_s: float, ts: str = "ts_us", origin_us: int = 0, spread: tuple[str, ...] | None = None) -> DataFrame:
    """As ``dealt``, shuffled by key (or some of it: ``spread``) and bucket before rows are multiplied; adds bucket and prev_us, the key's previous time."""
    w, s = int(window_s * 1_000_000), int(stride_s * 1_000_000)
    span = SPAN * -(-w // s) * s
    last = F.floor((F.col(ts) - origin_us) / s) * s
    first = last - (-(-w // s) - 1) * s
    buckets = F.sequence(F.floor(first / span), F.floor(last / span))
    rows = in_tasks(flows.withColumn("bucket", F.explode(buckets)), (*(spread or key), "bucket"), flows.count() * -(-w // s))
    rows = rows.withColumn("prev_us", F.lag(ts).over(Window.partitionBy(*key, "bucket").orderBy(ts)))
    begin = F.col("bucket") * span
    starts = F.sequence(F.greatest(first, begin).cast("long"), F.least(last, begin + (span - s)).cast("long"), F.lit(s).cast("long"))
    out = rows.withColumn("start_us", F.explode(F.transform(starts, lambda x: x + origin_us)))
    return out.where(F.col(ts) < F.col("start_us") + w)


def window_features(flows: DataFrame, window_s: float = 30, stride_s: float = 10, min_flows: int = 5) -> DataFrame:
    """One row for each (source, window) of at least ``min_flows`` connections: 18 features, rsto_ratio, and evidence."""
    return features(dealt_in_buckets(flows, ("src_ip",), window_s, stride_s), window_s, min_flows)


def _in_buckets(rows: DataFrame, most: int = 0) -> DataFrame:
    """Rows of windows with bucket and prev_us; those that weren't dealt in buckets are shuffled by window, to tasks for ``most`` rows."""
    if "bucket" in rows.columns:
        return rows
    rows = in_tasks(rows, KEY, most).withColumn("bucket", F.lit(0))
    return rows.withColumn("prev_us", F.lag("ts_us").over(Window.partitionBy(*KEY).orderBy("ts_us")))


def _summed(rows: DataFrame, sums: dict[str, Column], extremes: dict[str, Column]) -> DataFrame:
    """Fan-out of each (source, window), and totals, in one chain of aggregates over one partitioning.

    Rows become pairs of host and port with their sums, pairs become ports and hosts, and the
    ports carry the sums on.
    """
    key = (*KEY, "bucket")
    pairs = rows.groupBy(*key, "dst_ip", "dst_port").agg(F.count("*").alias("c"), *(F.sum(x).alias(n) for n, x in sums.items()), *(x.alias(n) for n, x in extremes.items()))
    return _of_pairs(pairs, tuple(sums), tuple(extremes))


def _of_pairs(pairs: DataFrame, sums: tuple[str, ...], extremes: tuple[str, ...]) -> DataFrame:
    """The second half: from pairs of host and port with their sums."""
    key = (*KEY, "bucket")
    port = F.struct(F.lit(True).alias("is_port"), F.col("dst_port").alias("value"))
    host = F.struct(F.lit(False).alias("is_port"), F.col("dst_ip").alias("value"))
    sides = pairs.withColumn("side", F.explode(F.array(port, host))).withColumns({"is_port": F.col("side.is_port"), "value": F.col("side.value")})
    once = lambda n: F.when(F.col("is_port"), F.col(n))
    least_most = lambda n: (F.min if n.startswith("min") else F.max)(once(n)).alias(n)
    each = sides.groupBy(*key, "is_port", "value").agg(F.sum("c").alias("c"), F.count("*").alias("others"), *(F.sum(once(n)).alias(n) for n in sums), *map(least_most, extremes))
    c = once("c")
    return each.groupBy(*key).agg(
        F.count_if("is_port").alias("unique_dst_ports"),
        F.max(once("others")).alias("max_hosts_on_single_port"),
        rounded(F.abs(F.log2(F.sum(c)) - F.sum(c * F.log2(c)) / F.sum(c))).alias("dst_port_entropy"),
        F.count_if(~F.col("is_port")).alias("unique_dst_hosts"),
        F.max(F.when(~F.col("is_port"), F.col("others"))).alias("max_ports_to_single_host"),
        F.sum(c).alias("connection_attempts"),
        *(F.sum(n).alias(n) for n in sums),
        *map(least_most, extremes),
    )


def features(rows: DataFrame, window_s: float, min_flows: int = 5, most: int = 0) -> DataFrame:
    """Features of connections that are already dealt to their windows; ``most``, a bound of the rows, sizes the tasks."""
    return _finished(_summed(_in_buckets(rows, most), _sums(), {"min_us": F.min("ts_us"), "max_us": F.max("ts_us")}), window_s, min_flows)


def features_of_pairs(pairs: DataFrame, window_s: float, min_flows: int = 5) -> DataFrame:
    """The same of windows that are already summed by host and port (``PAIR_SUMS``, ``c``, min_us, max_us); a window's gaps are on any of its pairs."""
    return _finished(_of_pairs(pairs.withColumn("bucket", F.lit(0)), PAIR_SUMS, ("min_us", "max_us")), window_s, min_flows)


#: Sums of a window's connections, by pair of host and port
PAIR_SUMS = ("failed_connections", "s0_n", "rej_n", "rsto_n", "zero_n", "lone_n", "orig", "resp", "dur", "gaps", "gap_sum", "gap_squares")


def _sums() -> dict[str, Column]:
    state = F.col("conn_state")
    gap = F.when(F.col("prev_us") >= F.col("start_us"), F.col("ts_us") - F.col("prev_us"))
    of = lambda condition: condition.cast("long")
    return {
        "failed_connections": of(state.isin(*FAILED_STATES)), **{f"{x.lower()}_n": of(state == x) for x in ("S0", "REJ", "RSTO")}, "zero_n": of(F.col("resp_pkts") == 0), "lone_n": of(F.col("history") == "S"),
        "orig": F.col("orig_pkts"), "resp": F.col("resp_pkts"), "dur": F.col("duration"), "gaps": of(gap.isNotNull()), "gap_sum": F.coalesce(gap, F.lit(0)), "gap_squares": F.coalesce(gap * gap, F.lit(0)),
    }


def _finished(summed: DataFrame, window_s: float, min_flows: int) -> DataFrame:
    total = summed.where(F.col("connection_attempts") >= min_flows)
    n = F.col("connection_attempts")
    span = (F.col("max_us") - F.col("min_us")) / 1e6
    mean = F.col("gap_sum") / F.col("gaps")
    cv = F.when(mean > 0, F.sqrt(F.greatest(F.col("gap_squares") / F.col("gaps") - mean * mean, F.lit(0.0))) / mean)
    made = {
        "connections_per_sec": rounded(n / window_s),
        "failed_conn_ratio": rounded(F.col("failed_connections") / n),
        **{f"{x}_ratio": rounded(F.col(f"{x}_n") / n) for x in ("s0", "rej", "rsto")},
        "resp_ratio": F.when(F.col("orig") != 0, rounded(F.col("resp") / F.col("orig"))).otherwise(0.0),
        "zero_resp_ratio": rounded(F.col("zero_n") / n),
        "avg_pkts_per_conn": rounded((F.col("orig") + F.col("resp")) / n),
        "avg_duration": rounded(F.col("dur") / n),
        "iat_cv": rounded(or_zero(cv)),
        "syn_only_ratio": rounded(F.col("lone_n") / n),
        "scan_rate": rounded(F.when(span > 0, n / span).otherwise(n / window_s), 4),
        "ports_per_host": rounded(F.col("unique_dst_ports") / F.col("unique_dst_hosts")),
        "fanout_ratio": rounded(F.col("unique_dst_ports") / n),
        "end_us": F.col("start_us") + int(window_s * 1_000_000),
    }
    return total.withColumns(made).drop("bucket", "min_us", "max_us", *PAIR_SUMS[1:])


def fan_out(rows: DataFrame) -> DataFrame:
    """Distinct ports and hosts, their maxima against each other, and port entropy per (source, window)."""
    return _summed(_in_buckets(rows), {}, {}).drop("bucket", "connection_attempts")


def scan_candidates(windows: DataFrame, min_ports: int = 10) -> DataFrame:
    """Windows that reach enough ports to be scans. Which of them alert is a model's to say."""
    return windows.where(F.col("unique_dst_ports") >= min_ports)


def scan_decisions(scored: DataFrame, min_ports: int = 10, threshold: float = ALERT_AT) -> DataFrame:
    """Candidate windows with a calibrated ``probability`` at the alert threshold, and their severity."""
    out = scan_candidates(scored, min_ports).withColumn("confidence", rounded(F.col("probability"), 4))
    return out.where(F.col("confidence") >= threshold).withColumn("severity", severity("PortScan", F.col("confidence")))


def state_histogram(flows: DataFrame) -> DataFrame:
    return flows.groupBy("conn_state").agg(F.count("*").alias("n"))


def component_alerts(decisions: DataFrame, detector: str, threshold: float = ALERT_AT) -> DataFrame:
    """Nested alerts: window, detector, confidence and evidence."""
    iso = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    evidence = ("unique_dst_hosts", "unique_dst_ports", "connection_attempts", "failed_connections", "scan_rate")
    return decisions.select(
        F.sha2(F.concat_ws("|", F.lit(detector), "src_ip", "start_us"), 256).alias("alert_id"),
        F.lit("PortScan").alias("threat_class"),
        "src_ip",
        "confidence",
        "severity",
        F.struct(iso("start_us").alias("start"), iso("end_us").alias("end")).alias("window"),
        F.struct(F.lit(detector).alias("name"), F.lit(threshold).alias("threshold")).alias("detector"),
        F.struct(*evidence).alias("evidence"),
    )


def pipeline_alerts(component: DataFrame) -> DataFrame:
    """The component's alerts in the pipeline's flat form: many destinations, so no single one is named."""
    return component.select(
        "alert_id",
        (F.unix_micros(F.to_timestamp("window.start")) / 1e6).alias("timestamp"),
        "threat_class",
        "confidence",
        "severity",
        "src_ip",
        F.lit("multiple").alias("dst_ip"),
        F.lit(0).alias("src_port"),
        F.lit(0).alias("dst_port"),
        F.concat("src_ip", F.lit(":scan-multiple:0")).alias("flow_id"),
        F.to_json("evidence").alias("evidence"),
        F.col("detector.name").alias("model_version"),
    )
