"""Alert analytics: statistics, pages, timelines, rankings, and reports.

Times are compared with an explicit ``as_of_us``; nothing reads the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trafficlens.functions.numeric import or_zero, rounded
from trafficlens.schemas import SEVERITIES, THREATS

MINUTE_US = 60_000_000


def severity_rank(severity: Column | None = None) -> Column:
    s = F.col("severity") if severity is None else severity
    return F.when(s == "CRITICAL", 3).when(s == "HIGH", 2).when(s == "MEDIUM", 1).otherwise(0)


def threat_table(spark: SparkSession) -> DataFrame:
    """The threat classes in display order, with label and code."""
    return spark.createDataFrame([(i, k, *v) for i, (k, v) in enumerate(THREATS.items())], "ordinal int, threat_class string, label string, code string")


def described(alerts: DataFrame) -> DataFrame:
    """Alerts with their class's label and code; an unknown class is its own label."""
    t = F.broadcast(threat_table(alerts.sparkSession))
    return alerts.join(t, "threat_class", "left").withColumns({"label": F.coalesce("label", "threat_class"), "code": F.coalesce("code", F.lit("?"))})


def recent(alerts: DataFrame, as_of_us: int, seconds: int) -> DataFrame:
    """Alerts of the last so many seconds before ``as_of_us``."""
    return alerts.where((F.col("ts_us") >= as_of_us - seconds * 1_000_000) & (F.col("ts_us") <= as_of_us))


def counts_by(alerts: DataFrame, column: str, default: str = "UNKNOWN") -> DataFrame:
    return alerts.groupBy(F.coalesce(column, F.lit(default)).alias(column)).agg(F.count("*").alias("n"))


def class_by_severity(alerts: DataFrame) -> DataFrame:
    """Counts of each class by severity, mean confidence, and distinct sources."""
    return alerts.groupBy("threat_class").agg(
        *(F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES),
        F.count("*").alias("total"),
        rounded(F.avg("confidence")).alias("avg_confidence"),
        F.count_distinct("src_ip").alias("sources"),
    )


def totals(alerts: DataFrame, as_of_us: int, start_us: int) -> DataFrame:
    """One row: alerts, alerts a minute since the start, and uptime."""
    minutes = (as_of_us - start_us) / 60e6
    return alerts.agg(F.count("*").alias("total_alerts")).select(
        "total_alerts", rounded(F.col("total_alerts") / max(minutes, 1e-9), 2).alias("alerts_per_minute"), F.lit((as_of_us - start_us) // 1_000_000).cast("long").alias("uptime_seconds")
    )


def top_sources(alerts: DataFrame, k: int = 20) -> DataFrame:
    return counts_by(alerts, "src_ip", "unknown").orderBy(F.desc("n"), "src_ip").limit(k)


def page(alerts: DataFrame, number: int = 1, size: int = 50, threat_class: str | None = None, severity: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A page of the newest alerts (ties by id), and the count of all that match."""
    if number < 1 or not 1 <= size <= 500:
        raise ValueError("pages start at 1 and hold 1 to 500 alerts")
    out = filtered(alerts, threat_class=threat_class, severity=severity)
    return out.orderBy(F.desc("ts_us"), "alert_id").offset((number - 1) * size).limit(size), out.agg(F.count("*").alias("total"))


def newest_by_arrival(alerts: DataFrame, n: int = 20) -> DataFrame:
    if not 1 <= n <= 100:
        raise ValueError("1 to 100 alerts")
    return alerts.orderBy(F.desc("seq")).limit(n)


def filtered(alerts: DataFrame, query: str = "", threat_class: str | None = None, severity: str | None = None, critical_only: bool = False) -> DataFrame:
    """Ledger filters: scope, class, severity, and a substring of the shown fields."""
    out = alerts
    if critical_only:
        out = out.where(F.col("severity") == "CRITICAL")
    if threat_class:
        out = out.where(F.col("threat_class") == threat_class)
    if severity:
        out = out.where(F.col("severity") == severity)
    if q := query.strip().lower():
        out = out.where(F.lower(F.concat_ws(" ", "src_ip", "dst_ip", flow_id(), "threat_class", "src_port", "dst_port")).contains(q))
    return out


def flow_id() -> Column:
    return F.concat(F.col("src_ip"), F.lit(":"), F.col("src_port"), F.lit("-"), F.col("dst_ip"), F.lit(":"), F.col("dst_port"))


def filter_summary(threat_class: str | None = None, severity: str | None = None) -> str:
    parts = [f"Type: {THREATS.get(threat_class, (threat_class,))[0]}" if threat_class else "", f"Severity: {severity.capitalize()}" if severity else ""]
    return " · ".join(p for p in parts if p) or "All threats"


def timeline(alerts: DataFrame, as_of_us: int, minutes: int = 5, bucket_s: int = 10) -> DataFrame:
    """Counts of each class and in total in buckets of the last minutes."""
    if not 1 <= minutes <= 60:
        raise ValueError("1 to 60 minutes")
    bucket = (F.floor(F.col("ts_us") / (bucket_s * 1_000_000)) * bucket_s).alias("bucket_s")
    return recent(alerts, as_of_us, minutes * 60).groupBy(bucket).agg(*(F.count_if(F.col("threat_class") == c).alias(c.lower()) for c in THREATS), F.count("*").alias("total"))


def minutes_zero_filled(alerts: DataFrame, as_of_us: int, minutes: int = 15) -> DataFrame:
    """Alerts in each minute of the last so many, both ends included, zeros too."""
    last, first = as_of_us // MINUTE_US, (as_of_us - minutes * MINUTE_US) // MINUTE_US
    grid = alerts.sparkSession.range(first, last + 1).withColumnRenamed("id", "minute")
    counts = alerts.select(F.floor(F.col("ts_us") / MINUTE_US).alias("minute")).where(F.col("minute").between(first, last)).groupBy("minute").agg(F.count("*").alias("n"))
    return grid.join(counts, "minute", "left").select("minute", F.coalesce("n", F.lit(0)).alias("n"))


def second_slots(alerts: DataFrame, as_of_us: int, seconds: int = 1800, slots: int = 34) -> DataFrame:
    """Counts by second of the newest slots in the live window."""
    second = F.floor(F.col("ts_us") / 1_000_000).alias("second")
    by = recent(alerts, as_of_us, seconds).groupBy(second).agg(*(F.count_if(F.col("threat_class") == c).alias(c.lower()) for c in THREATS), F.count("*").alias("total"))
    return by.orderBy(F.desc("second")).limit(slots)


def newest_stored(alerts: DataFrame, most: int = 10_000) -> DataFrame:
    """What a store of bounded size would still hold: the newest alerts by arrival."""
    return alerts.orderBy(F.desc("seq")).limit(most)


def second_groups(alerts: DataFrame, as_of_us: int, seconds: int = 1800, slots: int = 34, most: int = 10_000) -> DataFrame:
    """As ``second_slots``, but a slot is a run of alerts of one second in order of arrival, so a second can come again.

    Runs are told in one ordered pass over what the bounded store holds, at most ``most`` alerts.
    """
    rows = recent(newest_stored(alerts, most), as_of_us, seconds).withColumn("second", F.floor(F.col("ts_us") / 1_000_000))
    arrival = Window.orderBy("seq")
    opens = F.coalesce(F.col("second") != F.lag("second").over(arrival), F.lit(True))
    runs = rows.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(arrival))
    by = runs.groupBy("run", "second").agg(*(F.count_if(F.col("threat_class") == c).alias(c.lower()) for c in THREATS), F.count("*").alias("total"))
    return by.orderBy(F.desc("run")).limit(slots)


def peak_and_last(slots: DataFrame, order: str = "second") -> DataFrame:
    """One row: the greatest total of all slots, and the newest slot's."""
    return slots.agg(F.coalesce(F.max("total"), F.lit(0)).alias("peak"), F.coalesce(F.max_by("total", order), F.lit(0)).alias("last"))


def rate_deltas(ticks: DataFrame, order: str = "tick", total: str = "total") -> DataFrame:
    """Growth of a running total from tick to tick, at least 0. For one monitor's ticks: a single ordered series."""
    w = Window.orderBy(order)
    return ticks.withColumn("delta", F.greatest(F.col(total) - F.coalesce(F.lag(total).over(w), F.lit(0)), F.lit(0)))


def worst(alerts: DataFrame, n: int = 1) -> DataFrame:
    """By severity, then recency, then id."""
    return alerts.orderBy(F.desc(severity_rank()), F.desc("ts_us"), "alert_id").limit(n)


def status_level(alerts: DataFrame) -> DataFrame:
    """One row: counts and the level that they give."""
    n = {s: F.count_if(F.col("severity") == s) for s in ("CRITICAL", "HIGH", "MEDIUM")}
    level = F.when(F.col("critical") > 0, "attack").when((F.col("high") > 0) | (F.col("medium") > 2), "elevated").otherwise("clear")
    return alerts.agg(*(c.alias(s.lower()) for s, c in n.items())).withColumn("level", level)


def active_classes(alerts: DataFrame) -> DataFrame:
    """Classes with alerts, in display order."""
    return threat_table(alerts.sparkSession).join(alerts.select("threat_class").distinct(), "threat_class", "left_semi").orderBy("ordinal")


def source_risk(alerts: DataFrame) -> DataFrame:
    """min(round(6 x alerts + 40 x mean confidence), 100) of each source."""
    by = alerts.groupBy("src_ip").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean"))
    return by.select("src_ip", "n", F.least(F.floor(6 * F.col("n") + 40 * rounded(F.col("mean"), 9) + 0.5), F.lit(100)).cast("long").alias("risk"))


def radar(alerts: DataFrame, on: tuple[str, ...] = tuple(THREATS)) -> DataFrame:
    """Activity of each class's module: min(4 x alerts + (18 if it is on, else 4), 100)."""
    counts = threat_table(alerts.sparkSession).join(counts_by(alerts, "threat_class"), "threat_class", "left")
    base = F.when(F.col("threat_class").isin(*on), 18).otherwise(4)
    return counts.select("threat_class", F.least(4 * F.coalesce("n", F.lit(0)) + base, F.lit(100)).cast("long").alias("activity"))


def behavioural(evidence: Column, confidence: Column) -> tuple[Column, Column]:
    """Behavioural score from the spread of numeric evidence (an array of doubles), and the fused score."""
    spread = F.when(
        F.size(evidence) > 0,
        F.least(F.aggregate(evidence, F.lit(0.0), lambda acc, x: acc + F.log10(F.abs(x) + 10)) / (F.size(evidence) * 3), F.lit(1.0)),
    ).otherwise(0.5)
    score = F.least(0.55 * confidence + 0.45 * spread, F.lit(1.0))
    return score, 0.6 * confidence + 0.4 * score


def sentence() -> Column:
    """One plain sentence for an alert."""
    src, dst, kind = F.coalesce(F.nullif(F.col("src_ip"), F.lit("")), F.lit("an unknown host")), F.coalesce(F.nullif(F.col("dst_ip"), F.lit("")), F.lit("a target")), F.col("threat_class")

    def text(pattern: str, *args: Column) -> Column:
        return F.format_string(pattern, *args)

    # The sentences.
    return (
        F.when(kind == "DDoS", text("Traffic flood aimed at %s from %s.", dst, src))
        .when(kind == "PortScan", text("%s is scanning ports on %s.", src, dst))
        .when(kind == "DGA", text("%s is looking up suspicious auto-generated domains.", src))
        .when(kind == "C2_BEACONING", text("%s is beaconing to %s at regular intervals.", src, dst))
        .when(kind == "EncryptedMalware", text("Suspicious encrypted traffic from %s to %s.", src, dst))
        .when(kind == "DataExfiltration", text("Large upload from %s to %s — possible data theft.", src, dst))
        .otherwise(text("%s: %s → %s.", kind, src, dst))
    )


def ago(ts_us: Column, as_of_us: int) -> Column:
    """Relative time of an event."""
    s = F.greatest(F.floor((F.lit(as_of_us) - ts_us) / 1_000_000), F.lit(0))
    return (
        F.when(s < 5, "just now")
        .when(s < 60, F.concat(s.cast("string"), F.lit(" sec ago")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit(" min ago")))
        .otherwise(F.date_format(F.timestamp_micros(ts_us), "HH:mm:ss"))
    )


def uptime(seconds: Column) -> Column:
    """"3h 07m"."""
    return F.format_string("%dh %02dm", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60))


def compact(n: Column) -> Column:
    return F.when(n >= 1e6, F.format_string("%.1fM", n / 1e6)).when(n >= 1e4, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("string"))


def merged(history: DataFrame, live: DataFrame, cap: int = 5000) -> DataFrame:
    """Both lists without repeated ids (history wins), the newest ``cap`` of them."""
    both = history.withColumn("priority", F.lit(0)).unionByName(live.withColumn("priority", F.lit(1)))
    first = Window.partitionBy("alert_id").orderBy("priority", F.desc("ts_us"), F.desc("seq"))
    one = both.withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank", "priority")
    return one.orderBy(F.desc("ts_us"), "alert_id").limit(cap)


def ranged(df: DataFrame, column: str, parts: int = 256) -> DataFrame:
    """Adds range: ascending ranges of a number with about equally many rows each; equal values share one."""
    bounds = sorted(set(df.approxQuantile(column, [i / parts for i in range(1, parts)], 1 / (4 * parts))))
    return df.withColumn("range", F.size(F.filter(F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>"), lambda b: b <= F.col(column))))


def _before(ranges: DataFrame, sums: tuple[str, ...], descending: bool = False) -> DataFrame:
    """For each range its sums, those of all ranges before it, and of all: a table of a few hundred rows."""
    order = Window.orderBy(F.desc("range") if descending else "range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("range").agg(*(F.sum(c).alias(f"{c}_of_range") for c in sums))
    return totals.select(
        "*", *(F.coalesce(F.sum(f"{c}_of_range").over(order), F.lit(0)).alias(f"{c}_before") for c in sums), *(F.sum(f"{c}_of_range").over(Window.partitionBy()).alias(f"{c}_total") for c in sums)
    )


def latency_percentiles(samples: DataFrame, column: str) -> DataFrame:
    """Exact p50, p95 and p99 (linear), maximum and mean.

    Counts by value are added up by ranges; only the ranges that hold a wanted rank are ordered.
    """
    values = ranged(samples.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")), "v")
    counts = values.groupBy("range", "v").agg(F.count("*").alias("n"))
    about = _before(counts.withColumn("sum", F.col("v") * F.col("n")), ("n", "sum"))
    place = {n: p * (F.col("n_total") - 1) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))}
    sides = [F.struct(F.lit(n).alias("name"), x.cast("long").alias("rank"), weight.alias("weight")) for n, at in place.items() for x, weight in ((F.floor(at), 1 - (at - F.floor(at))), (F.ceil(at), at - F.floor(at)))]
    wanted = about.select("*", F.explode(F.array(*sides)).alias("w")).select("range", "n_before", "w.*", (F.col("sum_total") / F.col("n_total")).alias("mean"))
    wanted = wanted.join(about.select("range", "n_of_range"), "range").where((F.col("rank") >= F.col("n_before")) & (F.col("rank") < F.col("n_before") + F.col("n_of_range")))
    wanted = F.broadcast(wanted)
    inside = counts.join(F.broadcast(wanted.select("range").distinct()), "range", "left_semi").withColumn("to", F.sum("n").over(Window.partitionBy("range").orderBy("v")))
    hit = inside.join(wanted, "range").where((F.col("rank") < F.col("n_before") + F.col("to")) & (F.col("rank") >= F.col("n_before") + F.col("to") - F.col("n")))
    of = lambda n: rounded(F.sum(F.when(F.col("name") == n, F.col("v") * F.col("weight")))).alias(n)
    greatest = samples.agg(rounded(F.max(F.col(column).cast("double"))).alias("max"))
    return hit.agg(*map(of, place), rounded(F.max("mean")).alias("mean"), F.lit(0).alias("one")).join(greatest.withColumn("one", F.lit(0)), "one").select(*place, "max", "mean")


def best_threshold(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """The score threshold of greatest F1 on the precision-recall curve (ties: the lowest threshold).

    Counts are combined by distinct score, added up by ranges of scores, and ordered inside ranges.
    """
    by = scored.groupBy(F.col(score).cast("double").alias("threshold")).agg(F.sum(label).alias("pos"), F.count("*").alias("n"))
    ranges = ranged(by, "threshold")
    above = Window.partitionBy("range").orderBy(F.desc("threshold"))
    before = _before(ranges, ("pos", "n"), descending=True)
    curve = ranges.withColumns({"tp": F.sum("pos").over(above), "predicted": F.sum("n").over(above)}).join(F.broadcast(before), "range")
    curve = curve.withColumns({"tp": F.col("tp") + F.col("pos_before"), "predicted": F.col("predicted") + F.col("n_before")})
    curve = curve.withColumn("f1", rounded(or_zero(2 * F.col("tp") / (F.col("predicted") + F.col("pos_total")))))
    best = curve.agg(F.max(F.struct("f1", (-F.col("threshold")).alias("low"), (F.col("tp") / F.col("predicted")).alias("precision"))).alias("b"))
    return best.select((-F.col("b.low")).alias("threshold"), F.col("b.f1").alias("f1"), F.col("b.precision").alias("precision")).where("threshold is not null")


def report(alerts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts by severity, counts by class (most first), and all alerts by severity and recency."""
    return (
        counts_by(alerts, "severity"),
        counts_by(alerts, "threat_class").orderBy(F.desc("n"), "threat_class"),
        alerts.orderBy(F.desc(severity_rank()), F.desc("ts_us"), "alert_id"),
    )


def health(alerts: DataFrame, as_of_us: int, start_us: int) -> DataFrame:
    return alerts.agg(F.count("*").alias("total_alerts")).select(F.lit("healthy").alias("status"), F.lit((as_of_us - start_us) / 1e6).alias("uptime_seconds"), "total_alerts")
