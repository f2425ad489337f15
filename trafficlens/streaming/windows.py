"""Sliding windows on streams, with the batch kernels.

A window's rows are held in state until the watermark passes its end; a closed window is
emitted once, and its features are computed by the batch operator inside
``foreachBatch``. So stream and batch agree by construction. Rows behind the watermark
are dropped for the windows that have closed only. ``most_rows`` cuts a closed window, and it
says so; ``state.bounded_scan_windows`` bounds what is held before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from trafficlens.operators import flows as flow_ops
from trafficlens.operators import portscan, units
from trafficlens.operators.serving import ranged

SCAN_COLUMNS = ("ts_us", "dst_ip", "dst_port", "conn_state", "duration", "orig_pkts", "resp_pkts", "history")
UNIT_COLUMNS = ("ts_us", "orig_h", "resp_h", "resp_p", "proto", "pkts", "bytes", "dur", "uid")
PACKET_COLUMNS = ("timestamp_us", "seq", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_len", "syn", "ack", "rst", "fin", "psh")


def _closed(rows: DataFrame, ts: str, window_s: float, stride_s: float, lateness_s: float, key: list[str], columns: tuple[str, ...], offset_us: int = 0, most_rows: int | None = None) -> DataFrame:
    """(start_us, key, rows, truncated) of windows that the watermark has passed."""
    timed = rows.withColumn("event_time", F.timestamp_micros(F.col(ts))).withWatermark("event_time", f"{int(lateness_s * 1000)} milliseconds")
    window = F.window("event_time", f"{int(window_s * 1000)} milliseconds", f"{int(stride_s * 1000)} milliseconds", f"{offset_us} microseconds")
    out = timed.groupBy(window, *key).agg(F.collect_list(F.struct(*columns)).alias("rows"))
    start = F.unix_micros("window.start").alias("start_us")
    if most_rows is None:
        return out.select(start, *key, "rows", F.lit(False).alias("truncated"))
    return out.select(start, *key, F.slice(F.sort_array("rows"), 1, most_rows).alias("rows"), (F.size("rows") > most_rows).alias("truncated"))


def closed_scan_windows(connections: DataFrame, window_s: float = 30, stride_s: float = 10, lateness_s: float = 60, most_rows: int | None = None) -> DataFrame:
    """Closed windows of each source's connections."""
    return _closed(connections, "ts_us", window_s, stride_s, lateness_s, ["src_ip"], SCAN_COLUMNS, most_rows=most_rows)


def closed_unit_windows(flows: DataFrame, window_s: float, stride_s: float, lateness_s: float = 0, origin_us: int = 0) -> DataFrame:
    """Closed windows of prepared flows, on a grid through the origin; none starts before it."""
    rows = flows if "uid" in flows.columns else flows.withColumn("uid", F.lit(None).cast("string"))
    closed = _closed(rows.withColumn("all", F.lit(0)), "ts_us", window_s, stride_s, lateness_s, ["orig_h"], UNIT_COLUMNS[:1] + UNIT_COLUMNS[2:], offset_us=origin_us % int(stride_s * 1_000_000))
    return closed.where(F.col("start_us") >= origin_us)


def closed_flow_windows(packets: DataFrame, window_s: float = 10, lateness_s: float = 5) -> DataFrame:
    """Closed tumbling windows of each flow's packets."""
    keyed = packets.withColumn("flow_key", flow_ops.flow_key())
    return _closed(keyed, "timestamp_us", window_s, window_s, lateness_s, ["flow_key"], PACKET_COLUMNS)


def unrolled(closed: DataFrame) -> DataFrame:
    """The rows of closed windows, one by one, with the window's key."""
    keys = [c for c in closed.columns if c not in ("rows", "truncated")]
    return closed.select(*keys, F.explode("rows").alias("r")).select(*keys, "r.*")


def scan_features(closed: DataFrame, window_s: float = 30, min_flows: int = 5) -> DataFrame:
    """Features of closed scan windows (a batch), with ``truncated``."""
    cut = closed.select(*portscan.KEY, "truncated")
    return portscan.features(unrolled(closed), window_s, min_flows).join(cut, list(portscan.KEY))


def unit_features(closed: DataFrame, window_s: int) -> DataFrame:
    """Unit features of closed windows (a batch). Only whole windows of all hosts close together, so fan-in is complete."""
    return units.features_of(unrolled(closed), window_s)


def flows(closed: DataFrame, window_s: float = 10) -> DataFrame:
    """Assembled flows of closed windows (a batch)."""
    return flow_ops.assembled(unrolled(closed).drop("start_us", "flow_key"), int(window_s * 1_000_000))


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Run ``handle`` on the windows that each micro-batch closes. ``once``: all that is there, then stop."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if once else writer).start()


def tick_row(spark: SparkSession, schema: StructType, at_us: int, ts: str = "ts_us") -> DataFrame:
    """One row that only moves the watermark to ``at_us``: appended to a stream's source when it has gone quiet (now), or
    at its end (far ahead), it closes the windows that are still held. Its own window stays open."""
    values = [F.lit(at_us if f.name == ts else None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return spark.range(1).select(*values)


def _arrivals(rows: DataFrame, window_s: float, stride_s: float, lateness_s: float, source: str) -> DataFrame:
    """Each row's source, whether it is late or partly late, and how far behind it is.

    The watermark is the greatest time of all earlier arrivals (``seq``) less the allowance. It is taken by
    ranges of arrival, so no task sees all rows.
    """
    w, s = int(window_s * 1_000_000), int(stride_s * 1_000_000)
    dealt = ranged(rows, "seq")
    tops = dealt.groupBy("range").agg(F.max("ts_us").alias("top"))
    before = tops.select("range", F.max("top").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("top_before"))
    earlier = F.max("ts_us").over(Window.partitionBy("range").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = dealt.withColumn("earlier", earlier).join(F.broadcast(before), "range").withColumn("newest", F.greatest("earlier", "top_before"))
    mark = F.col("newest") - int(lateness_s * 1_000_000)
    last = F.floor(F.col("ts_us") / s) * s
    first = last - (-(-w // s) - 1) * s
    return rows.select(
        F.col(source).alias("source"), F.coalesce(last + w <= mark, F.lit(False)).alias("late"), F.coalesce((first + w <= mark) & (last + w > mark), F.lit(False)).alias("partly"),
        F.greatest((F.col("newest") - F.col("ts_us")) / 1e6, F.lit(0.0)).alias("behind_s"),
    )


def lateness(rows: DataFrame, window_s: float, stride_s: float, lateness_s: float, source: str = "src_ip") -> DataFrame:
    """How recorded arrivals (``ts_us``, and ``seq`` in order of arrival) fare, in one row of counts.

    A row is late if all its windows have closed when it comes, and partly late if the first has.
    """
    by = _arrivals(rows, window_s, stride_s, lateness_s, source).groupBy("source").agg(F.count("*").alias("n"), F.count_if("late").alias("l"), F.count_if("partly").alias("p"), F.max("behind_s").alias("b"))
    return by.agg(F.sum("n").alias("rows"), (F.sum("n") - F.sum("l")).alias("admitted"), F.sum("l").alias("late"), F.sum("p").alias("partly_late"), F.count("*").alias("sources"), F.max("b").alias("worst_behind_s"))


def late_sources(rows: DataFrame, window_s: float, stride_s: float, lateness_s: float, source: str = "src_ip", most: int = 5) -> DataFrame:
    """The sources with most late rows."""
    told = _arrivals(rows, window_s, stride_s, lateness_s, source).where("late")
    return told.groupBy("source").agg(F.count("*").alias("late")).orderBy(F.desc("late"), "source").limit(most)


def window_health(rows: DataFrame, window_s: float, stride_s: float, min_flows: int = 5, most_rows: int | None = None, source: str = "src_ip") -> DataFrame:
    """Windows emitted, withheld for too few rows, and cut at ``most_rows``, in one row."""
    sizes = portscan.dealt(rows.select(source, "ts_us"), window_s, stride_s).groupBy(source, "start_us").agg(F.count("*").alias("n"))
    cut = F.lit(False) if most_rows is None else F.col("n") > most_rows
    return sizes.agg(F.count_if(F.col("n") >= min_flows).alias("emitted"), F.count_if(F.col("n") < min_flows).alias("abstained"), F.count_if(cut).alias("truncated"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that the watermark has dropped so far."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p.get("stateOperators", []))
