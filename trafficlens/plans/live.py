"""The whole detection pipeline on packets, in batch or as a stream: flows, rules, claims, and one alert table.

Claims come first, then what they suppress. All detectors read the same assembled flows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trafficlens.operators import beacons, detect, domains, flows, portscan, tracking
from trafficlens.operators.models import Detector, domain_rows
from trafficlens.operators.training import VECTORS
from trafficlens.functions.numeric import severity
from trafficlens.schemas import WINDOW_US
from trafficlens.sources import sinks
from trafficlens.streaming import panes, windows


#: The probability at which a flow model's score alerts, where it isn't the artifact's own threshold
ALERT_AT = {"EncryptedMalware": 0.2826}


#: Scan windows of the live plan, and how long after its end one waits for records that end late
SCAN_S, SCAN_STRIDE_S, SCAN_WAIT_US = 10, 2, 3_000_000


class Models(NamedTuple):
    """Fitted detectors; without one, what only it can say is left out."""

    scan: Detector | None = None
    flows: dict[str, Detector] = {}
    domain: Detector | None = None


def alerts(packets: DataFrame, window_us: int = WINDOW_US, scan_model: Detector | None = None, flow_models: dict[str, Detector] | None = None, domain_model: Detector | None = None) -> DataFrame:
    """Alerts of all classes. Models are optional: rules run without them, and what only a model can say is left out.

    Connection records are flushed at the windows' boundaries. A scan window holds the records known by
    ``SCAN_WAIT_US`` after its end. A beacon alerts in each window in which it has new starts.
    """
    models = Models(scan_model, flow_models or {}, domain_model)
    scans = scan_decisions(scan_features(packets, window_us), models.scan)
    found, kept = window_alerts(packets, scan_claims(scans, window_us), window_us, models)
    return found.unionByName(scan_alerts(scans)).unionByName(beacon_alerts(beacons.histories(kept)))


def scan_rows(records: DataFrame) -> DataFrame:
    """Records dealt to the scan windows that could wait for them."""
    return portscan.dealt(records, SCAN_S, SCAN_STRIDE_S).where(F.col("known_us") <= F.col("start_us") + SCAN_S * 1_000_000 + SCAN_WAIT_US)


def scan_features(packets: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """Scan windows of a batch. A packet makes one record at most, so packets bound the rows that are dealt."""
    n = packets.count()
    return portscan.features(scan_rows(tracking.flushed_records(packets, window_us, most=n)), SCAN_S, most=n * -(-SCAN_S // SCAN_STRIDE_S))


def scan_decisions(features: DataFrame, model: Detector | None) -> DataFrame:
    scored = features.withColumn("probability", F.lit(None).cast("double")) if model is None else model.score(portscan.scan_candidates(features))
    return portscan.scan_decisions(scored)


def scan_claims(scans: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """A scan window claims its source in every detection window that it touches."""
    first, last = (F.floor(c / window_us) * window_us for c in (F.col("start_us"), F.col("end_us") - 1))
    return scans.select(F.explode(F.sequence(first, last, F.lit(window_us).cast("long"))).alias(detect.WINDOW), "src_ip").distinct()


def scan_alerts(scans: DataFrame) -> DataFrame:
    return portscan.pipeline_alerts(portscan.component_alerts(scans, "portscan-10s2s"))


def beacon_alerts(histories: DataFrame) -> DataFrame:
    return beacons.beacon_alerts(beacons.history_scores(histories), F.col(detect.WINDOW))


def window_alerts(packets: DataFrame, scanners: DataFrame, window_us: int = WINDOW_US, models: Models = Models()) -> tuple[DataFrame, DataFrame]:
    """What whole detection windows say by themselves: their alerts, and the connection starts that nobody has claimed.

    ``packets`` are all packets of some windows, ``scanners`` the sources that scans claim in them.
    """
    flow_rows = flows.assembled(packets, window_us)
    floods = detect.flood_decisions(detect.destination_load(flow_rows))
    sessions = detect.encrypted_sessions(flow_rows)
    starts = beacons.qualified_starts(beacons.connection_starts(packets, window_us), beacons.endpoint_summary(flow_rows))
    kept = detect.unclaimed(starts, detect.claims(floods, sessions, scanners))
    parts = [
        detect.flood_alerts(floods),
        detect.encrypted_session_alerts(sessions),
        detect.exfiltration_alerts(_exfiltration(flow_rows, models.flows.get("DataExfiltration"))),
    ]
    scoreable = flow_rows.where((F.col("total_packets") >= 3) & flows.to_one_host())
    for kind in ("DDoS", "EncryptedMalware"):
        if kind in models.flows:
            model = models.flows[kind]
            parts.append(detect.model_alerts(flow_rows, model.score(VECTORS[kind](scoreable)), kind, ALERT_AT.get(kind, model.contract.threshold)))
    if models.domain is not None and "dns_query" in packets.columns:
        parts.append(domain_alerts(domains.dns_queries(packets), models.domain))
    return reduce(DataFrame.unionByName, (p.select(parts[0].columns) for p in parts)), kept


def stream(
    packets: DataFrame, folder: str, models: Models = Models(), window_us: int = WINDOW_US, lateness_us: int = 5_000_000, limits: panes.Limits = panes.Limits(), once: bool = False
) -> tuple[StreamingQuery, Callable[[], StreamingQuery]]:
    """The whole plan on a stream of packets: the same alerts as ``alerts``, each once, under ``folder``.

    The first query has two chains under one watermark. One holds the packets of each detection window, dealt to ``DEALT``
    parts so that no flow or source is a hot key. The other makes records in order of time and from them scan windows. A detection window
    is held until all scan windows that touch it have closed, so when it comes out its claims are complete: those of this micro-batch, and of
    earlier ones, which each batch hands on to the next in ``folder``/claims. Its rules are then the batch's, on whole windows. What nobody
    has claimed goes to ``folder``/starts, which the second query reads to keep each endpoint's history. Its alerts come a trigger later.
    Everything is written by ``sinks.write_once``, so a replayed micro-batch changes nothing.

    Returns the first query and a function that starts the second one. Packets later than ``lateness_us`` may miss their records.
    A window's last alerts come once packets (or a tick row) are ``held_us`` + ``lateness_us`` past it.
    """
    spark = packets.sparkSession
    hold = held_us(window_us)
    timed = packets.withColumn("event_time", F.timestamp_micros("timestamp_us")).withWatermark("event_time", f"{lateness_us} microseconds")
    scans = panes.scan_windows(panes.records(timed, window_us), SCAN_S, SCAN_STRIDE_S, SCAN_WAIT_US, limits=limits)
    held = packets.withColumn("held", F.timestamp_micros(F.col("timestamp_us") + hold)).withWatermark("held", f"{lateness_us} microseconds")
    part = F.pmod(F.xxhash64("timestamp_us", "seq"), F.lit(DEALT)).alias("part")
    columns = [c for c in packets.columns if c not in ("event_time", "held")]
    closed = held.groupBy(F.window("held", f"{window_us} microseconds"), part).agg(F.collect_list(F.struct(*columns)).alias("packets"))
    both = scans.unionByName(closed.select(F.lit("packets").alias("kind"), (F.unix_micros("window.start") - hold).alias("start_us"), "packets"), allowMissingColumns=True)

    def handle(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        decided = scan_decisions(portscan.features_of_pairs(batch.where("kind = 'pair'"), SCAN_S), models.scan).persist()
        sinks.write_once(batch.where("kind in ('health', 'late')").select("kind", F.col("src_ip").alias("name"), "n"), f"{folder}/health", number)
        span = batch.where("kind = 'packets'").agg(F.min("start_us"), F.max("start_us")).first()
        claimed = scan_claims(decided, window_us)
        # the last batch's table has the claims on windows that were still held then
        claimed = claimed.unionByName(sinks.written(spark, f"{folder}/claims", number - 1, claimed.schema)).distinct()
        found = scan_alerts(decided)
        if span[0] is not None:
            rows = batch.where("kind = 'packets'").select(F.explode("packets").alias("p")).select("p.*")
            mine, kept = window_alerts(rows, claimed.where(F.col(detect.WINDOW).between(*span)), window_us, models)
            # an endpoint's starts are in one file, so no trigger of the second query gets half of them
            sinks.write_once(kept.repartition(*beacons.ENDPOINT), f"{folder}/starts", number)
            found = found.unionByName(mine)
            claimed = claimed.where(F.col(detect.WINDOW) > span[1])
        sinks.write_once(found, f"{folder}/alerts", number)
        sinks.write_once(claimed.coalesce(1), f"{folder}/claims", number)
        sinks.forget(spark, f"{folder}/claims", number - 2)
        decided.unpersist()
        batch.unpersist()

    first = windows.each_batch(both, handle, f"{folder}/checkpoints/windows", once)

    def judge(batch: DataFrame, number: int) -> None:
        sinks.write_once(beacon_alerts(batch.withColumn("gap_squares", F.col("gap_squares").cast("decimal(38,0)"))), f"{folder}/beacon_alerts", number)

    def second() -> StreamingQuery:
        starts = spark.readStream.schema(STARTS).parquet(f"{folder}/starts")
        return windows.each_batch(panes.beacon_histories(starts, window_us), judge, f"{folder}/checkpoints/beacons", once)

    return first, second


#: Parts that a held window's packets are dealt to
DEALT = 32
STARTS = "window_us long, src_ip string, dst_ip string, dst_port int, timestamp_us long, seq long, bytes long"


def held_us(window_us: int = WINDOW_US) -> int:
    """How long a detection window is held: until the scan windows that touch it have closed, in whole windows."""
    return -(-(SCAN_S * 1_000_000 + SCAN_WAIT_US) // window_us) * window_us


def streamed_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """All alerts that ``stream`` has written so far."""
    parts = [spark.read.parquet(f"{folder}/{name}").drop("batch") for name in ("alerts", "beacon_alerts")]
    return parts[0].unionByName(parts[1])


def stream_health(spark: SparkSession, folder: str) -> DataFrame:
    """The counters of the running stream's scan windows (name, n), summed over all micro-batches."""
    return spark.read.parquet(f"{folder}/health").where("kind = 'health'").groupBy("name").agg(F.sum("n").alias("n"))


def stream_late_sources(spark: SparkSession, folder: str, most: int = 5) -> DataFrame:
    """The sources with most late records."""
    return spark.read.parquet(f"{folder}/health").where("kind = 'late'").groupBy(F.col("name").alias("src_ip")).agg(F.sum("n").alias("late")).orderBy(F.desc("late"), "src_ip").limit(most)


def scan_stream(connections_: DataFrame, model: Detector, handle: Callable[[DataFrame, int], None], checkpoint: str, window_s: float = 10, stride_s: float = 2, lateness_s: float = 3, once: bool = False) -> StreamingQuery:
    """Port-scan alerts of a stream of connection records, chunk by chunk: each micro-batch's closed windows are scored and handed on."""

    def chunk(closed: DataFrame, number: int) -> None:
        scored = model.score(portscan.scan_candidates(windows.scan_features(closed, window_s)))
        handle(portscan.component_alerts(portscan.scan_decisions(scored), "portscan-stream"), number)

    return windows.each_batch(windows.closed_scan_windows(connections_, window_s, stride_s, lateness_s), chunk, checkpoint, once)


def _exfiltration(flow_rows: DataFrame, model: Detector | None) -> DataFrame:
    """Upload decisions; a model's score is what the volume rules lift."""
    if model is None:
        return detect.exfiltration_decisions(flow_rows)
    scored = model.score(VECTORS["DataExfiltration"](flow_rows.where(flows.to_one_host()))).select(*flows.KEY, "probability")
    return detect.exfiltration_decisions(flow_rows.join(scored, list(flows.KEY), "left"), F.coalesce("probability", F.lit(0.0)))


def domain_alerts(queries: DataFrame, model: Detector, threshold: float = 0.8) -> DataFrame:
    """An alert for each query of a name that the model calls generated."""
    scored = model.score(domain_rows(queries)).withColumn("confidence", F.col("probability")).where(F.col("confidence") >= threshold)
    rows = scored.withColumn(detect.WINDOW, F.col("timestamp_us")).withColumn("severity", severity("DGA", F.col("confidence")))
    evidence = {"domain": F.col("domain"), "entropy": F.round("entropy", 3), "sld_length": F.col("sld_length")}
    return detect.alert(rows, "DGA", evidence, dst_port=F.lit(53))
