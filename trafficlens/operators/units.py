"""Windowed command-and-control units: 13 features for each (window, host, endpoint).

A unit is the flows of one host to one endpoint (host, port, protocol) in a window.
Windows are tumbling, or slide on a grid anchored at an origin. Fan-in and fan-out are
counted inside the same window only. Missing values are null, never NaN.

Flows are shuffled once by host and bucket of windows (see ``portscan``), so units and their
fan-out need no other shuffle. Fan-in comes from the panes of one stride in which a unit has flows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.functions.numeric import rounded
from trafficlens.operators.portscan import dealt, dealt_in_buckets

UNIT = ("start_us", "orig_h", "resp_h", "resp_p", "proto")
# The models' features in their order.
BASE = ("endpoint_host_fanin", "n_flows", "dst_recurrence", "host_endpoint_fanout", "iat_mean", "iat_cov", "mean_pkts")
EXTENDED = (*BASE, "iat_madn", "dur_mean", "dur_cov", "pkts_cov", "bytes_mean", "host_flow_share")
ENDPOINT = ("start_us", "resp_h", "resp_p", "proto")
NO_PORT, SUBBINS = -1, 10
#: Endpoints, over all windows, up to which their fan-in is broadcast
MOST_ENDPOINTS = 131_072
#: The two timescales: detector id, window and stride in seconds
TIMESCALES = (("fast", 60, 10), ("deep", 300, 60))


def prepared(flows: DataFrame, internal_only: bool = True, prefixes: tuple[str, ...] | None = None) -> DataFrame:
    """Flows with a time, normalised keys, and packet, byte and duration columns; rows marked as external go."""
    columns = set(flows.columns)
    out = flows.where(F.col("ts_us").isNotNull())
    if internal_only and "local_orig" in columns:
        out = out.where(~F.col("local_orig").eqNullSafe(False))
    if prefixes is not None:
        inside = F.lit(False)
        for p in prefixes:
            inside = inside | F.col("orig_h").startswith(p)
        out = out.where(inside)
    proto = F.lower(F.trim("proto"))
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in columns else F.lit(0.0)
    return out.withColumns(
        {
            "resp_p": F.coalesce(F.col("resp_p").try_cast("long"), F.lit(NO_PORT).cast("long")),
            "proto": F.when(proto.isNull() | proto.isin("", "nan", "none", "<na>"), "unknown").otherwise(proto),
            "pkts": number("orig_pkts") + number("resp_pkts"),
            "bytes": number("orig_ip_bytes") + number("resp_ip_bytes"),
            "dur": number("duration"),
        }
    )


def origin_us(flows: DataFrame) -> int:
    """The first event, down to a whole second."""
    return (flows.agg(F.min("ts_us")).first()[0] or 0) // 1_000_000 * 1_000_000


def _cov(x: str) -> Column:
    return F.when((F.count("*") >= 2) & (F.avg(x) > 0), F.stddev_samp(x) / F.avg(x))


def unit_features(flows: DataFrame, window_s: int, stride_s: int | None = None, origin: int | None = None, uids: bool = False) -> DataFrame:
    """All 13 features of each unit of prepared flows.

    ``stride_s`` None: tumbling from the epoch. Otherwise sliding from ``origin``, and no
    window starts before it.
    """
    stride, at = stride_s or window_s, origin or 0
    rows = dealt_in_buckets(flows, UNIT[1:], window_s, stride, origin_us=at, spread=("orig_h",))
    pairs = _pairs(flows, window_s, stride, at)
    if origin is not None:
        rows, pairs = rows.where(F.col("start_us") >= origin), pairs.where(F.col("start_us") >= origin)
    host = Window.partitionBy("start_us", "orig_h", "bucket")
    units = _units(rows, window_s, uids).withColumns({"host_endpoint_fanout": F.count("*").over(host), "host_flows": F.sum("n_flows").over(host)})
    return _finished(units.where(F.col("orig_h").isNotNull()).join(_fanin(pairs), list(ENDPOINT)), uids)


def _pairs(flows: DataFrame, window_s: int, stride_s: int, origin: int) -> DataFrame:
    """The units of each window, once each. A unit's panes of one stride are bits of a long, so rows are combined before
    they are shuffled and no row is dealt to its windows; where windows aren't whole strides or the bits don't do, rows are dealt."""
    n = window_s // stride_s
    if window_s % stride_s or n > 32:
        return dealt(flows, window_s, stride_s, origin_us=origin).select(*UNIT).distinct()
    starts = 64 - n  # of a long's windows; their panes are one bit less than it has
    pane = F.floor((F.col("ts_us") - origin) / (stride_s * 1_000_000))
    one = F.lit(1).cast("long")
    words = F.sequence(F.floor((pane - (n - 1)) / starts), F.floor(pane / starts))
    bit = F.call_function("shiftleft", one, (F.col("pane") - F.col("word") * starts).cast("int"))
    bits = flows.withColumn("pane", pane).withColumn("word", F.explode(words)).groupBy(*UNIT[1:], "word").agg(F.bit_or(bit).alias("bits"))
    seen = lambda i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(F.lit((1 << n) - 1)) != 0
    start = F.explode(F.filter(F.sequence(F.lit(0), F.lit(starts - 1)), seen))
    return bits.select(*UNIT[1:], "word", start.alias("i")).select(((F.col("word") * starts + F.col("i")) * (stride_s * 1_000_000) + origin).alias("start_us"), *UNIT[1:])


def _fanin(pairs: DataFrame) -> DataFrame:
    """Hosts of each endpoint and window. Where these are few, they are broadcast, so that units aren't shuffled for them."""
    fanin = pairs.groupBy(*ENDPOINT).agg(F.count("*").alias("endpoint_host_fanin"))
    few = fanin.limit(MOST_ENDPOINTS + 1).collect()
    if len(few) > MOST_ENDPOINTS:
        return fanin
    return F.broadcast(pairs.sparkSession.createDataFrame(few, fanin.schema))


def features_of(rows: DataFrame, window_s: int, uids: bool = False) -> DataFrame:
    """Unit features of flows that are already dealt to their windows."""
    pairs = rows.groupBy(*UNIT).agg(F.count("*").alias("n_flows"))
    last = F.lag("ts_us").over(Window.partitionBy(*UNIT).orderBy("ts_us"))
    return _joined(rows.withColumns({"prev_us": last, "bucket": F.lit(0)}), pairs, window_s, uids)


def _joined(rows: DataFrame, pairs: DataFrame, window_s: int, uids: bool) -> DataFrame:
    """Fan-in and fan-out come from the units' keys alone, so a host or endpoint of many units is no task's whole input."""
    fanin = pairs.groupBy(*ENDPOINT).agg(F.count("*").alias("endpoint_host_fanin"))
    fanout = pairs.groupBy("start_us", "orig_h").agg(F.count("*").alias("host_endpoint_fanout"), F.sum("n_flows").alias("host_flows"))
    return _finished(_units(rows, window_s, uids).join(fanin, list(ENDPOINT)).join(fanout, ["start_us", "orig_h"]), uids)


def _units(rows: DataFrame, window_s: int, uids: bool) -> DataFrame:
    """What each unit's own rows say.

    Medians keep counts of distinct gaps, not gaps: a unit's gaps are whole microseconds and add up to its window at most,
    so at most sqrt(2 * window) differ (24,495 in 300 s), whatever the unit's rows. The rows are spilled, not held.
    """
    gap = F.when(F.col("prev_us") >= F.col("start_us"), F.col("ts_us") - F.col("prev_us"))
    width = window_s * 1_000_000 / SUBBINS
    rows = rows.withColumn("gap", gap).withColumn("bin", F.least(F.greatest(F.floor((F.col("ts_us") - F.col("start_us")) / width), F.lit(0)), F.lit(SUBBINS - 1)))
    rows = rows.withColumn("gap_median", F.median("gap").over(Window.partitionBy(*UNIT, "bucket")))
    gaps, middle = F.count("gap"), F.max("gap_median")
    return rows.groupBy(*UNIT, "bucket").agg(
        F.count("*").alias("n_flows"),
        (F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("bin").cast("int")))) / SUBBINS).alias("dst_recurrence"),
        (F.avg("gap") / 1e6).alias("iat_mean"),
        F.when((gaps >= 2) & (F.avg("gap") > 0), F.stddev_pop("gap") / F.avg("gap")).alias("iat_cov"),
        F.avg("pkts").alias("mean_pkts"),
        F.when((gaps >= 2) & (middle > 0), F.median(F.abs(F.col("gap") - F.col("gap_median"))) / middle).alias("iat_madn"),
        F.avg("dur").alias("dur_mean"),
        _cov("dur").alias("dur_cov"),
        _cov("pkts").alias("pkts_cov"),
        F.avg("bytes").alias("bytes_mean"),
        *([F.sort_array(F.collect_list("uid")).alias("flow_id")] if uids else []),
    )


def _finished(units: DataFrame, uids: bool) -> DataFrame:
    out = units.withColumn("host_flow_share", F.col("n_flows") / F.col("host_flows"))
    exact = {"endpoint_host_fanin", "n_flows", "host_endpoint_fanout"}
    return out.select(*UNIT, *(F.col(c) if c in exact else rounded(F.col(c)).alias(c) for c in EXTENDED), *(["flow_id"] if uids else []))


def both_timescales(flows: DataFrame, origin: int | None = None) -> DataFrame:
    """Units of both timescales, never merged: each row names its detector."""
    at = origin_us(flows) if origin is None else origin
    parts = [unit_features(flows, w, s, at).withColumn("detector_id", F.lit(name)) for name, w, s in TIMESCALES]
    return parts[0].unionByName(parts[1])


def unit_alerts(scored: DataFrame, detector: str, timescale: str, threshold: float) -> DataFrame:
    """Nested alerts of units whose ``probability`` reaches the threshold; needs ``flow_id``."""
    iso = F.date_format(F.timestamp_micros("start_us"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return scored.where(F.col("probability") >= threshold).select(
        iso.alias("timestamp"),
        iso.alias("window_start"),
        F.lit(detector).alias("detector_id"),
        F.lit(timescale).alias("timescale"),
        "flow_id",
        F.lit("C2_BEACONING").alias("threat_class"),
        F.round("probability", 4).alias("confidence"),
        F.struct(F.struct("orig_h", "resp_h", "resp_p", "proto").alias("unit"), F.size("flow_id").alias("n_contributing_flows"), F.struct(*EXTENDED).alias("features")).alias("evidence"),
    )
