"""Traffic-shaped views over the benchmark tables (see FIXTURES.md for their meaning)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _pair(prefix: str, n: str) -> Column:
    return F.expr(f"'{prefix}.' || cast({n} div 256 as string) || '.' || cast({n} % 256 as string)")


def _line_seq() -> Column:
    return F.col("l_orderkey") * 8 + F.col("l_linenumber")


def _line_ts() -> Column:
    return F.expr("unix_micros(cast(l_shipdate as timestamp)) div 86400 + ((l_orderkey * 8 + l_linenumber) % 1000) * 1000")


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection records, one for each line item."""
    flags = F.concat("l_returnflag", "l_linestatus")
    state = F.when(flags == "AF", "SF").when(flags == "AO", "S0").when(flags == "NF", "REJ").when(flags == "NO", "RSTO").when(flags == "RF", "OTH").otherwise("S1")
    lone = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O") & (F.col("l_quantity") <= 25)
    return table(spark, sf_dir, "lineitem").select(
        _line_seq().alias("seq"),
        _line_ts().alias("ts_us"),
        _pair("10.0", "l_suppkey").alias("src_ip"),
        F.concat(F.lit("172.16.0."), (F.col("l_partkey") % 40).cast("string")).alias("dst_ip"),
        (F.col("l_partkey") % 1024).cast("string").alias("dst_port"),
        state.alias("conn_state"),
        (F.col("l_linenumber").cast("double") / 8).alias("duration"),
        F.col("l_quantity").cast("double").alias("orig_pkts"),
        F.when(F.col("l_linestatus") == "O", 0.0).otherwise(F.col("l_linenumber").cast("double")).alias("resp_pkts"),
        F.when(lone, "S").otherwise("-").alias("history"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of both directions, one for each event."""
    kind = F.col("event_type")
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    e = e.select(
        "*",
        _pair("10.1", "user_id").alias("cli"),
        F.concat(F.lit("203.0.113."), (F.col("k") % 2).cast("string")).alias("srv"),
        (40000 + F.col("user_id") % 20000).cast("int").alias("cp"),
        F.when(F.col("k") % 2 == 0, 443).otherwise(9001).alias("sp"),
        (F.col("event_id") % 3 == 0).alias("reply"),
    )
    size = F.floor("value").cast("int")
    return e.select(
        F.col("event_id").alias("seq"),
        F.expr("1704067200000000 + (unix_micros(cast(ts as timestamp)) - 1704067200000000) div 100000").alias("timestamp_us"),
        F.when(F.col("reply"), F.col("srv")).otherwise(F.col("cli")).alias("src_ip"),
        F.when(F.col("reply"), F.col("cli")).otherwise(F.col("srv")).alias("dst_ip"),
        F.when(F.col("reply"), F.col("sp")).otherwise(F.col("cp")).alias("src_port"),
        F.when(F.col("reply"), F.col("cp")).otherwise(F.col("sp")).alias("dst_port"),
        F.when(F.col("user_id") % 5 == 0, 17).otherwise(6).alias("protocol"),
        (60 + size).alias("packet_len"),
        (20 + size).alias("payload_len"),
        (kind == "signup").alias("syn"),
        kind.isin("view", "click", "purchase").alias("ack"),
        (kind == "error").alias("rst"),
        (kind == "purchase").alias("fin"),
        kind.isin("click", "purchase").alias("psh"),
    )


def attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of attacks and of traffic just below them, one for each event: 500 events make up 10 s.

    Each such block holds a flood, a scan, encrypted sessions, an upload and beacons; those of
    even blocks are over the rules' limits, those of odd ones are not.
    """
    return table(spark, sf_dir, "events").selectExpr("event_id as seq", "event_id div 500 as b", "cast(event_id % 500 as int) as j").selectExpr(*_ATTACKS)


_KIND = "case when j < 210 then {0} when j < 250 then {1} when j < 310 then {2} when j < 430 then {3} else {4} end"
#: Back means from the server: every fifth session packet, every sixtieth of the upload, every third of a beacon's
_BACK = "(j between 250 and 309 and j % 5 = 4) or (j between 310 and 429 and j % 60 = 59) or (j >= 430 and (j - 430) % 21 % 3 = 1)"
_CLIENT = _KIND.format(
    "'10.8.' || cast(j % 40 as string) || '.7'", "'10.7.' || cast(b % 250 as string) || '.7'", "'10.3.3.' || cast(b % 250 + 1 as string)", "'10.1.1.' || cast(b % 250 + 1 as string)",
    "'10.2.' || cast(b % 250 as string) || '.' || cast((j - 430) div 21 + 1 as string)",
)
#: The second beacon calls the sessions' server
_SERVER = _KIND.format(
    "'10.9.' || cast(b % 250 as string) || '.9'", "'10.9.' || cast(b % 250 as string) || '.8'", "'203.0.113.' || cast(b % 250 + 1 as string)", "'198.51.100.9'",
    "case when (j - 430) div 21 = 1 then '203.0.113.' || cast(b % 250 + 1 as string) else '198.51.100.66' end",
)
_CLIENT_PORT = _KIND.format("20000 + j % case when b % 2 = 0 then 210 else 100 end", "40000 + j", "42000 + (j - 250) div 5", "50000", "41000 + (j - 430) div 3")
_SERVER_PORT = _KIND.format("80", "20 + j % case when b % 2 = 0 then 40 else 10 end", "4444", "8444", "9001")
_OFFSET_US = _KIND.format(
    "j * case when b % 4 = 0 then 200 else 20000 end", "j * 10000", "(j - 250) div 5 * 500000 + j % 5 * 10000", "(j - 310) * 10000",
    "case when b % 2 = 0 then (j - 430) % 21 div 3 * 1300000 else (j - 430) % 21 div 3 * ((j - 430) % 21 div 3) * 190000 end + (j - 430) % 21 % 3 * 1000",
)
_LENGTH = _KIND.format("60", "60", "case when b % 2 = 0 then 220 else 100 end", "case when j % 60 = 59 then 60 when b % 2 = 0 then 1400 else 400 end", "90")
_ATTACKS = (
    "seq", f"1704067200000000 + b * 10000000 + {_OFFSET_US} as timestamp_us",
    f"case when {_BACK} then {_SERVER} else {_CLIENT} end as src_ip", f"case when {_BACK} then {_CLIENT} else {_SERVER} end as dst_ip",
    f"cast(case when {_BACK} then {_SERVER_PORT} else {_CLIENT_PORT} end as int) as src_port", f"cast(case when {_BACK} then {_CLIENT_PORT} else {_SERVER_PORT} end as int) as dst_port",
    "6 as protocol", f"{_LENGTH} as packet_len", f"{_LENGTH} - 40 as payload_len",
    "j < 250 or (j >= 430 and (j - 430) % 21 % 3 < 2) as syn", "j between 250 and 429 or (j >= 430 and (j - 430) % 21 % 3 > 0) as ack", "false as rst", "false as fin",
    "j between 250 and 429 or (j >= 430 and (j - 430) % 21 % 3 = 2) as psh",
)


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts in real time, one for each event."""
    k = F.col("k")
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    names = ("DDoS", "PortScan", "C2_BEACONING", "DataExfiltration", "EncryptedMalware", "DGA")
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("event_id").cast("string").alias("alert_id"),
        _micros("ts").alias("ts_us"),
        F.element_at(F.array(*map(F.lit, names)), (k % 6 + 1).cast("int")).alias("threat_class"),
        ((700 + 3 * k).cast("double") / 1000).alias("confidence"),
        F.when(k >= 94, "CRITICAL").when(k >= 67, "HIGH").when(k >= 34, "MEDIUM").otherwise("LOW").alias("severity"),
        _pair("10.1", "user_id").alias("src_ip"),
        F.concat(F.lit("203.0.113."), (k % 20).cast("string")).alias("dst_ip"),
        F.lit(0).alias("src_port"),
        k.alias("dst_port"),
    )


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host names of pages."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)).alias("domain"))


def named_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host names of all four kinds that the safe-name rule tells apart, one for each page."""
    kinds = (
        ("page_id % 5 = 0", "'host' || page_id || '.lan'"), ("page_id % 5 = 1", "'_svc' || page_id || '._tcp.example.org'"), ("page_id % 5 = 2", "'api' || page_id || '.zoom.us'"),
        ("page_id % 5 = 3", "'e' || page_id || '.akamaiedge.net'"), ("true", "'x' || page_id || 'notzoom.us'"),
    )
    name = " ".join(f"when {c} then {v}" for c, v in kinds)
    return table(spark, sf_dir, "pages").selectExpr("page_id as seq", f"case {name} end as domain")


def c2_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow records of few, recurring endpoints."""
    return table(spark, sf_dir, "lineitem").select(
        _line_seq().alias("seq"),
        _line_ts().alias("ts_us"),
        _pair("147.32", "l_suppkey").alias("orig_h"),
        F.concat(F.lit("172.16.0."), (F.col("l_partkey") % 4).cast("string")).alias("resp_h"),
        F.lit(443).alias("resp_p"),
        F.lit("tcp").alias("proto"),
        F.col("l_quantity").cast("long").alias("orig_pkts"),
        F.col("l_linenumber").cast("long").alias("resp_pkts"),
        (F.col("l_linenumber").cast("double") / 8).alias("duration"),
        F.floor("l_extendedprice").cast("long").alias("orig_ip_bytes"),
        (F.col("l_partkey") % 997).cast("long").alias("resp_ip_bytes"),
        F.concat(F.lit("C"), _line_seq().cast("string")).alias("uid"),
    )
