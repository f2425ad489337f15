"""Per-packet fields that a protocol analyser prints as tab-separated lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The analyser's field names, in print order. Source ports let answers find their connection.
FIELDS = ("frame.time_epoch", "ip.src", "ip.dst", "tcp.dstport", "udp.dstport", "tcp.flags", "ip.proto")
WITH_SOURCE_PORTS = (*FIELDS, "tcp.srcport", "udp.srcport")


def read_fields(spark: SparkSession, path: str, fields: tuple[str, ...] = WITH_SOURCE_PORTS) -> DataFrame:
    """Packets from printed fields; lines of another width are skipped. Without source ports they are 0."""
    parts = F.split("value", "\t", -1)
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") == len(fields))
    col = {f: F.nullif(F.col("p")[i], F.lit("")) for i, f in enumerate(fields)}
    none = F.lit(None).cast("string")
    flags = F.conv(F.regexp_replace(col["tcp.flags"], "^0x", ""), 16, 10).cast("int")
    port = lambda side: F.coalesce(col.get(f"tcp.{side}", none), col.get(f"udp.{side}", none), F.lit("0")).try_cast("int")
    out = rows.select(
        F.floor(col["frame.time_epoch"].try_cast("double") * 1e6 + 0.5).alias("timestamp_us"),
        col["ip.src"].alias("src_ip"),
        col["ip.dst"].alias("dst_ip"),
        port("srcport").alias("src_port"),
        port("dstport").alias("dst_port"),
        col["ip.proto"].try_cast("int").alias("protocol"),
        *(F.coalesce(flags.bitwiseAND(bit) > 0, F.lit(False)).alias(n) for n, bit in (("syn", 2), ("ack", 16), ("rst", 4), ("fin", 1), ("psh", 8))),
    ).where("timestamp_us is not null and src_ip is not null and dst_ip is not null and protocol is not null")
    return out.withColumn("seq", F.xxhash64(*out.columns))
