"""Writers of packets, alerts, reports and run summaries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from trafficlens.operators.serving import described, flow_id, severity_rank
from trafficlens.schemas import FLAGS


def packet_messages(packets: DataFrame) -> DataFrame:
    """key and value of packets for a message topic; the key is the directed pair of endpoints."""
    key = F.concat(F.concat_ws(":", "src_ip", "src_port"), F.lit("-"), F.concat_ws(":", "dst_ip", "dst_port"))
    return packets.select(key.alias("key"), F.to_json(F.struct(*(c for c in packets.columns if c not in (*FLAGS, "seq")))).alias("value"))


def alert_messages(alerts: DataFrame) -> DataFrame:
    """key (the source) and value of alerts for a message topic."""
    return alerts.select(F.col("src_ip").alias("key"), F.to_json(F.struct(*alerts.columns)).alias("value"))


def write_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    """Batch write with acknowledgement of all replicas. Needs Spark's Kafka connector."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("topic", topic).save()


def stream_kafka(messages: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    return messages.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def write_json_lines(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("overwrite").json(path)


def append_alerts(alerts: DataFrame, path: str) -> None:
    """The alert store: a table that only grows. Queries bound what they show."""
    alerts.write.mode("append").parquet(path)


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def write_once(rows: DataFrame, folder: str, batch: int) -> bool:
    """A micro-batch's rows as the folder ``batch=<n>``, exactly once; False if it was there.

    The rows are written beside it first, under a name that readers pass over, and then renamed in one step. A batch that
    was cut off before the rename leaves nothing that is read, and one that is replayed after it changes nothing.
    """
    (to, fs), (by, _) = (_path(rows.sparkSession, f"{folder}/{name}") for name in (f"batch={batch}", f"_batch-{batch}"))
    if fs.exists(to):
        return False
    rows.write.mode("overwrite").parquet(by.toString())
    if not fs.rename(by, to):
        raise OSError(f"{by.toString()} can't be renamed to {to.toString()}")
    return True


def written(spark: SparkSession, folder: str, batch: int, schema: StructType) -> DataFrame:
    """What ``write_once`` wrote for a batch; no rows if it wrote none."""
    path, fs = _path(spark, f"{folder}/batch={batch}")
    return spark.read.schema(schema).parquet(path.toString()) if fs.exists(path) else spark.createDataFrame([], schema)


def forget(spark: SparkSession, folder: str, batch: int) -> None:
    path, fs = _path(spark, f"{folder}/batch={batch}")
    fs.delete(path, True)


def _utc(pattern: str) -> Column:
    return F.date_format(F.timestamp_micros("ts_us"), pattern)


def report_columns(alerts: DataFrame) -> DataFrame:
    """The 11 columns of the report export."""
    return described(alerts).select(
        F.concat(_utc("yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")).alias("timestamp_utc"),
        F.col("label").alias("threat_type"),
        F.initcap(F.lower("severity")).alias("severity"),
        F.format_string("%.1f", 100 * F.col("confidence")).alias("confidence_pct"),
        F.col("src_ip").alias("source_ip"),
        F.nullif(F.col("src_port").cast("string"), F.lit("0")).alias("source_port"),
        F.col("dst_ip").alias("destination_ip"),
        F.nullif(F.col("dst_port").cast("string"), F.lit("0")).alias("destination_port"),
        *(_or_null(alerts, c) for c in ("flow_id", "model_version", "alert_id")),
    )


def ledger_columns(alerts: DataFrame) -> DataFrame:
    """The 12 columns of the ledger export."""
    names = ("threat_class", "severity", "confidence", "src_ip", "src_port", "dst_ip", "dst_port", "flow_id", "model_version", "alert_id", "evidence")
    return alerts.select(_utc("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp_utc"), *(_or_null(alerts, c) for c in names))


def _or_null(df: DataFrame, c: str) -> Column:
    if c == "flow_id" and c not in df.columns:
        return flow_id().alias(c)
    return F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def report_rows(alerts: DataFrame) -> DataFrame:
    """The printed report's table: by severity, then recency."""
    return alerts.orderBy(F.desc(severity_rank()), F.desc("ts_us"), "alert_id")


def counted(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` with metrics that fill while a sink runs it: no second pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in metrics.items())), seen


def summary(seen: dict[str, Observation]) -> str:
    """A run's summary as JSON, from its observations."""
    return json.dumps({name: o.get for name, o in seen.items()}, sort_keys=True, default=str)
