"""Packet records: JSON lines, or the same JSON from Kafka."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from trafficlens.schemas import FLAGS, PACKET

CORRUPT = "_corrupt_record"


def flat(packets: DataFrame) -> DataFrame:
    """Packets with flat flags (a missing one is false) and ``seq``, a content hash that breaks ties in time."""
    flags = {f: F.coalesce(F.col(f"tcp_flags.{f}"), F.lit(False)) for f in FLAGS}
    return packets.withColumns(flags).withColumn("seq", F.xxhash64(*(c for c in packets.columns if c != "tcp_flags"), *FLAGS))


def _usable() -> Column:
    return F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull() & F.col("timestamp_us").isNotNull()


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Usable packets, and the lines that are not (bad JSON, or without endpoints or time)."""
    schema = StructType(PACKET.fields).add(CORRUPT, StringType())
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    good = F.col(CORRUPT).isNull() & _usable()
    return flat(rows.where(good).drop(CORRUPT)), rows.where(~good)


def stream_json(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same from files that appear in a folder; unusable lines are dropped."""
    reader = spark.readStream.schema(PACKET)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader
    return flat(reader.json(path).where(_usable()))


def stream_kafka(spark: SparkSession, servers: str, topic: str = "flow-records", **options: str) -> DataFrame:
    """The same from Kafka values, from the newest offsets unless told otherwise. Needs Spark's Kafka connector."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**({"startingOffsets": "latest"} | options))
    parsed = reader.load().select(F.from_json(F.col("value").cast("string"), PACKET).alias("p")).select("p.*")
    return flat(parsed.where(_usable()))


def event_time() -> Column:
    return F.timestamp_micros(F.col("timestamp_us"))
