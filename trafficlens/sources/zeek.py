"""Connection logs: tab-separated with a ``#fields`` header, or JSON lines; and normalisers of flow exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trafficlens.functions.numeric import rounded
from trafficlens.sources import tail as tails

REQUIRED = ("ts", "id.orig_h", "id.resp_h", "id.resp_p", "conn_state", "duration", "orig_pkts", "resp_pkts", "history")
UNSET = ("-", "(empty)", "")


def sniff(spark: SparkSession, path: str) -> str:
    """"json" or "tsv", by the first character of the first line that isn't blank."""
    first = spark.read.text(path).where(F.trim("value") != "").first()
    if first is None or first["value"].lstrip()[0] == "#":
        return "tsv"
    if first["value"].lstrip()[0] == "{":
        return "json"
    raise ValueError(f"{path}: neither a tab-separated log nor JSON lines")


def _headers(lines: DataFrame, path: str) -> dict[tuple[str, tuple[str, ...]], list[str]]:
    """Files of each layout, which is a separator and field names. Every file has a header of its own."""
    heads = lines.where(F.col("value").startswith("#separator") | F.col("value").startswith("#fields")).select("file", "value").distinct().collect()
    found: dict[str, dict[str, str]] = {}
    for r in heads:
        found.setdefault(r["file"], {})[r["value"].split(None, 1)[0]] = r["value"]
    bare = lines.where((F.col("value") != "") & ~F.col("value").startswith("#")).select("file").distinct().collect()
    if missing := [r["file"] for r in bare if "#fields" not in found.get(r["file"], {})]:
        raise ValueError(f"{path}: data without a #fields line in {missing[0]}")
    layouts: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for file, lines_ in found.items():
        if "#fields" in lines_:
            separator = lines_.get("#separator", "#separator \\x09").split(None, 1)[1].encode().decode("unicode_escape")
            fields = lines_["#fields"].split(separator if separator in lines_["#fields"] else "\t")[1:]
            layouts.setdefault((separator, tuple(fields)), []).append(file)
    if not layouts:
        raise ValueError(f"{path}: data without a #fields line")
    return layouts


def read_tsv(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED) -> tuple[DataFrame, DataFrame]:
    """All fields as strings by name, and the lines whose width differs from their file's header.

    Files with other fields, or in another order, are read by their own header; a field that a file lacks is null.
    """
    lines = spark.read.text(path).withColumn("file", F.input_file_name())
    layouts = _headers(lines, path)
    names = list(dict.fromkeys(f for _, fields in layouts for f in fields))
    if missing := [f for f in required if any(f not in fields for _, fields in layouts)]:
        raise ValueError(f"{path}: no field {', '.join(missing)}")
    data = lines.where((F.col("value") != "") & ~F.col("value").startswith("#"))
    good, bad = [], []
    for (separator, fields), files in layouts.items():
        mine = data
        if len(layouts) > 1:
            mine = data.join(F.broadcast(spark.createDataFrame([(f,) for f in files], "file string")), "file", "left_semi")
        mine = mine.withColumn("parts", F.split("value", "\\Q" + separator + "\\E", -1))
        fits = F.size("parts") == len(fields)
        place = {f: i for i, f in enumerate(fields)}
        good.append(mine.where(fits).select(*((F.col("parts")[place[f]] if f in place else F.lit(None).cast("string")).alias(f) for f in names)))
        bad.append(mine.where(~fits).select("value"))
    return reduce(DataFrame.unionByName, good), reduce(DataFrame.unionByName, bad)


def read_json(spark: SparkSession, path: str, fields: tuple[str, ...] = REQUIRED) -> tuple[DataFrame, DataFrame]:
    """The named fields as strings, and the lines that are no JSON objects."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("m", F.from_json("value", "map<string,string>"))
    return parsed.where(F.col("m").isNotNull()).select(*(F.col("m").getItem(f).alias(f) for f in fields)), parsed.where(F.col("m").isNull()).select("value")


def _number(c: Column) -> Column:
    return F.coalesce(F.when(~F.trim(c).isin(*UNSET), F.trim(c).try_cast("double")), F.lit(0.0))


def _bad(c: Column) -> Column:
    """An unset or unparseable number, which counts as 0."""
    return (c.isNull() | F.trim(c).isin(*UNSET) | F.trim(c).try_cast("double").isNull()).cast("int")


def _text(c: Column) -> Column:
    return F.when(c.isNull() | (F.trim(c) == ""), "-").otherwise(c)


def connections(raw: DataFrame) -> DataFrame:
    """Connection records; ``bad_numbers`` counts the numbers of a row that were taken as 0."""
    col = lambda f: F.col(f"`{f}`")
    numbers = ("ts", "duration", "orig_pkts", "resp_pkts")
    ts = F.floor(_number(col("ts")) * 1e6 + 0.5)
    out = raw.select(
        ts.alias("ts_us"),
        _text(col("id.orig_h")).alias("src_ip"),
        _text(col("id.resp_h")).alias("dst_ip"),
        _text(col("id.resp_p")).alias("dst_port"),
        _text(col("conn_state")).alias("conn_state"),
        rounded(_number(col("duration"))).alias("duration"),
        _number(col("orig_pkts")).alias("orig_pkts"),
        _number(col("resp_pkts")).alias("resp_pkts"),
        _text(col("history")).alias("history"),
        sum((_bad(col(f)) for f in numbers), F.lit(0)).alias("bad_numbers"),
    )
    return out


def conn_log(spark: SparkSession, path: str, fmt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Connection records of a log of either format, and its rejected lines."""
    raw, rejected = (read_json if (fmt or sniff(spark, path)) == "json" else read_tsv)(spark, path)
    return connections(raw), rejected


def follow(spark: SparkSession, path: str, fields: list[str], separator: str = "\t") -> DataFrame:
    """A stream of connection records from files that appear in a folder (whole files, not a byte tail)."""
    lines = spark.readStream.text(path).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    parts = lines.select(F.split("value", "\\Q" + separator + "\\E", -1).alias("parts")).where(F.size("parts") == len(fields))
    return connections(parts.select(*(F.col("parts")[i].alias(f) for i, f in enumerate(fields))))


def parsed_lines(lines: DataFrame, fields: tuple[str, ...] = REQUIRED) -> DataFrame:
    """The named fields as strings and ``rejected``, from lines (value, header) of either format; each TSV line by its own file's header."""
    data = lines.where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    head = F.from_json("header", "separator string, fields array<string>")
    rows = data.withColumn("head", head).withColumn("json", F.when(F.ltrim("value").startswith("{"), F.from_json("value", "map<string,string>")))
    rows = rows.withColumn("parts", F.when(~F.ltrim("value").startswith("{"), F.split("value", F.concat(F.lit("\\Q"), F.col("head.separator"), F.lit("\\E")), -1)))
    fits = F.coalesce(F.size("parts") == F.size("head.fields"), F.lit(False))
    tsv = lambda f: F.get("parts", F.array_position("head.fields", f).cast("int") - 1)
    return rows.select(
        *(F.when(F.col("json").isNotNull(), F.col("json").getItem(f)).when(fits & F.array_contains("head.fields", f), tsv(f)).alias(f) for f in fields),
        (F.col("json").isNull() & ~fits).alias("rejected"),
    )


def tail(spark: SparkSession, path: str, from_start: bool = True) -> DataFrame:
    """A stream of connection records from a growing log of either format, line by line.

    Every micro-batch's progress has the observed metrics ``tail``: lines, and those that were rejected.
    """
    rows = parsed_lines(tails.lines(spark, path, from_start)).observe("tail", F.count(F.lit(1)).alias("lines"), F.count_if("rejected").alias("rejected"))
    return connections(rows.where(~F.col("rejected")))


def rejected_lines(query: StreamingQuery) -> int:
    """Lines that a running tail has rejected so far, by the progress that the query still holds."""
    return sum((p["observedMetrics"].get("tail") or {"rejected": 0})["rejected"] for p in query.recentProgress)


def data_quality(records: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: records, records with bad numbers, bad numbers, and rejected lines."""
    kept = records.select("bad_numbers", F.lit(False).alias("rejected"))
    both = kept.unionByName(rejected.select(F.lit(0).alias("bad_numbers"), F.lit(True).alias("rejected")))
    return both.agg(
        F.count_if(~F.col("rejected")).alias("records"),
        F.count_if(F.col("bad_numbers") > 0).alias("records_with_bad_numbers"),
        F.coalesce(F.sum("bad_numbers"), F.lit(0)).alias("bad_numbers"),
        F.count_if("rejected").alias("rejected_lines"),
    )


def c2_flows(raw: DataFrame) -> DataFrame:
    """Flow records of beacon units from a raw log: lower-cased protocol, ``local_orig`` T/F/1/0 or null."""
    col = lambda f: F.col(f"`{f}`") if f in raw.columns else F.lit(None).cast("string")
    local = F.upper(F.trim(col("local_orig")))
    return raw.select(
        F.floor(col("ts").try_cast("double") * 1e6 + 0.5).alias("ts_us"),
        col("id.orig_h").alias("orig_h"),
        col("id.resp_h").alias("resp_h"),
        col("id.resp_p").try_cast("long").alias("resp_p"),
        F.lower(F.trim(col("proto"))).alias("proto"),
        *(_number(col(f)).alias(f) for f in ("orig_pkts", "resp_pkts")),
        F.when(local.isin("T", "TRUE", "1"), True).when(local.isin("F", "FALSE", "0"), False).alias("local_orig"),
        *(_number(col(f)).alias(f) for f in ("duration", "orig_ip_bytes", "resp_ip_bytes")),
        col("uid").alias("uid"),
    ).where(F.col("ts_us").isNotNull())


def first_flows(flows: DataFrame, most: int | None = None) -> DataFrame:
    """Flows in time order, ties in order of arrival, at most so many. The order is for the cap; features don't need it."""
    out = flows.withColumn("_arrival", F.monotonically_increasing_id()).orderBy("ts_us", "_arrival")
    return (out.limit(most) if most else out).drop("_arrival")


def binetflow(raw: DataFrame) -> DataFrame:
    """Flow records of beacon units from a bidirectional flow export."""
    port = next(c for c in ("Dport_n", "Dport") if c in raw.columns)
    time = next(c for c in ("ts", "StartTime") if c in raw.columns)
    return raw.select(
        F.coalesce(F.floor(F.col(time).try_cast("double") * 1e6 + 0.5), F.unix_micros(F.try_to_timestamp(F.col(time).cast("string")))).alias("ts_us"),
        F.col("SrcAddr").alias("orig_h"),
        F.col("DstAddr").alias("resp_h"),
        F.col(port).try_cast("long").alias("resp_p"),
        F.lower(F.trim("Proto")).alias("proto"),
        _number(F.col("SrcPkts").cast("string")).alias("orig_pkts"),
        _number(F.col("DstPkts").cast("string")).alias("resp_pkts"),
        F.lit(None).cast("boolean").alias("local_orig"),
    ).where(F.col("ts_us").isNotNull())
