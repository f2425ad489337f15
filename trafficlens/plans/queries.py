"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens import views
from trafficlens.functions import domains as D
from trafficlens.functions.numeric import rounded, severity_by_class
from trafficlens.operators import beacons, connections, detect, domains, flows, portscan, serving, tracking, training, units
from trafficlens.plans import live
from trafficlens.plans.oracle import AS_OF_US, START_US
from trafficlens.schemas import WINDOW_US

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Queries that SQL can't express, as it can't fit trees; tests hold the models to labelled traffic
NO_SQL = ("model_scores", "attack_model_scores", "portscan_model_alerts", "c2_model_scores", "attack_scan_scores", "attack_live_alerts")
ALERT = ("alert_id", "ts_us", "threat_class", "confidence", "severity", "src_ip", "dst_ip", "dst_port")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rounded_doubles(df: DataFrame) -> DataFrame:
    return df.select(*(rounded(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _flows(spark: SparkSession, d: str) -> DataFrame:
    return flows.assembled(views.packets(spark, d))


@query
def flow_key_agg(spark: SparkSession, d: str) -> DataFrame:
    return flows.keyed(views.packets(spark, d)).groupBy(*flows.KEY).agg(
        F.count("*").alias("packets"), F.sum("packet_len").alias("bytes"), F.min("timestamp_us").alias("start_us"), F.max("timestamp_us").alias("last_us")
    )


@query
def flow_direction_split(spark: SparkSession, d: str) -> DataFrame:
    return _flows(spark, d).select(*flows.KEY, "src_ip", "src_port", "dst_ip", "dst_port", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes")


@query
def flow_iat_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_doubles(
        _flows(spark, d).select(*flows.KEY, "fwd_gaps", "bwd_gaps", "fwd_gap_mean", "bwd_gap_mean", "fwd_gap_std", "bwd_gap_std", "gap_mean", "gap_std", "gap_max", "gap_min")
    )


@query
def flow_legacy_vector(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_doubles(flows.legacy_vector(_flows(spark, d)))


@query
def flow_ddos31(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_doubles(flows.flood_vector(_flows(spark, d)))


@query
def flow_exfil29(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_doubles(flows.exfiltration_vector(_flows(spark, d)))


@query
def flow_encmal31(spark: SparkSession, d: str) -> DataFrame:
    """Without the abstentions, which would leave none of the benchmark's flows; tests cover those."""
    return _rounded_doubles(flows.encrypted_vector(_flows(spark, d), abstain=False))


@query
def source_profile(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_doubles(detect.source_profile(views.packets(spark, d), WINDOW_US))


@query
def dst_flood_agg(spark: SparkSession, d: str) -> DataFrame:
    load = detect.destination_load(_flows(spark, d))
    return _rounded_doubles(load.select("window_us", "dst_ip", "packets", "bytes", "flows", "syn_count", "unique_dst_ports", "response_packets", "src_ip", "dst_port", "duration", "packet_rate"))


@query
def ddos_rule_alerts(spark: SparkSession, d: str) -> DataFrame:
    decided = detect.flood_decisions(detect.destination_load(_flows(spark, d)))
    return _rounded_doubles(decided.select("window_us", "dst_ip", "src_ip", "scan_shaped", "is_flood", "confidence", "severity"))


@query
def encmal_session_agg(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_doubles(detect.encrypted_sessions(_flows(spark, d)).drop("fwd_bytes_per_session"))


@query
def exfil_rule_alerts(spark: SparkSession, d: str) -> DataFrame:
    decided = detect.exfiltration_decisions(_flows(spark, d))
    return decided.select(*flows.KEY, "fwd_bytes", "bwd_bytes", rounded(F.col("up_down_ratio")).alias("up_down_ratio"), "confidence", "is_exfiltration", "severity")


@query
def endpoint_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_doubles(beacons.endpoint_summary(_flows(spark, d)))


@query
def syn_events(spark: SparkSession, d: str) -> DataFrame:
    return beacons.connection_starts(views.packets(spark, d))


@query
def c2_beacon_score(spark: SparkSession, d: str) -> DataFrame:
    events = views.table(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e8).alias("ts"), F.col("event_id").alias("seq"), F.floor("value").alias("bytes"))
    return _rounded_doubles(beacons.beacon_scores(events, ("user_id",)).select("user_id", "beacon_count", "n_gaps", "mean_interval", "cv", "confidence", "total_bytes", "is_beacon"))


def _claimed(flow_rows: DataFrame) -> DataFrame:
    return detect.claims(detect.flood_decisions(detect.destination_load(flow_rows)), detect.encrypted_sessions(flow_rows))


@query
def claimed_entities(spark: SparkSession, d: str) -> DataFrame:
    return _claimed(_flows(spark, d))


@query
def c2_after_suppression(spark: SparkSession, d: str) -> DataFrame:
    flow_rows = _flows(spark, d)
    kept = beacons.qualified_starts(beacons.connection_starts(views.packets(spark, d)), beacons.endpoint_summary(flow_rows))
    return detect.unclaimed(kept, _claimed(flow_rows)).select("window_us", *beacons.ENDPOINT, "timestamp_us", "seq", "bytes")


def _attack_flows(spark: SparkSession, d: str) -> DataFrame:
    return flows.assembled(views.attacks(spark, d))


@query
def attack_floods(spark: SparkSession, d: str) -> DataFrame:
    decided = detect.flood_decisions(detect.destination_load(_attack_flows(spark, d)))
    return _rounded_doubles(decided.select("window_us", "dst_ip", "src_ip", "scan_shaped", "is_flood", "confidence", "severity"))


@query
def attack_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_doubles(detect.encrypted_sessions(_attack_flows(spark, d)).drop("fwd_bytes_per_session"))


@query
def attack_uploads(spark: SparkSession, d: str) -> DataFrame:
    decided = detect.exfiltration_decisions(_attack_flows(spark, d))
    return decided.select(*flows.KEY, "fwd_bytes", "bwd_bytes", rounded(F.col("up_down_ratio")).alias("up_down_ratio"), "confidence", "is_exfiltration", "severity")


@query
def attack_claims(spark: SparkSession, d: str) -> DataFrame:
    return _claimed(_attack_flows(spark, d))


def _unclaimed_starts(spark: SparkSession, d: str) -> DataFrame:
    flow_rows = _attack_flows(spark, d)
    kept = beacons.qualified_starts(beacons.connection_starts(views.attacks(spark, d)), beacons.endpoint_summary(flow_rows))
    return detect.unclaimed(kept, _claimed(flow_rows)).select("window_us", *beacons.ENDPOINT, "timestamp_us", "seq", "bytes")


@query
def attack_unclaimed_starts(spark: SparkSession, d: str) -> DataFrame:
    return _unclaimed_starts(spark, d)


@query
def attack_beacons(spark: SparkSession, d: str) -> DataFrame:
    events = _unclaimed_starts(spark, d).withColumn("ts", F.col("timestamp_us") / 1e6)
    return _rounded_doubles(beacons.beacon_scores(events).select(*beacons.ENDPOINT, "beacon_count", "n_gaps", "mean_interval", "cv", "confidence", "total_bytes", "is_beacon"))


@query
def attack_connections(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_doubles(connections.records(views.attacks(spark, d)))


@query
def dga_safe_names(spark: SparkSession, d: str) -> DataFrame:
    return views.named_hosts(spark, d).select("seq", "domain", D.is_safe(F.col("domain")).alias("is_safe"))


@query
def portscan_windows_30_10(spark: SparkSession, d: str) -> DataFrame:
    return portscan.window_features(views.connections(spark, d), 30, 10)


@query
def portscan_windows_10_2(spark: SparkSession, d: str) -> DataFrame:
    return portscan.window_features(views.connections(spark, d), 10, 2)


@query
def portscan_entropy(spark: SparkSession, d: str) -> DataFrame:
    return portscan.fan_out(portscan.dealt(views.connections(spark, d), 30, 10)).select(*portscan.KEY, "dst_port_entropy")


@query
def portscan_distinct_max(spark: SparkSession, d: str) -> DataFrame:
    return portscan.fan_out(portscan.dealt(views.connections(spark, d), 30, 10)).select(*portscan.KEY, "max_ports_to_single_host", "max_hosts_on_single_port")


@query
def portscan_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Windows that the port rule passes on to the model."""
    return portscan.scan_candidates(portscan.window_features(views.connections(spark, d), 30, 10)).select(*portscan.KEY, "unique_dst_ports", "failed_connections", "scan_rate")


@query
def portscan_model_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Scan alerts of the fitted, calibrated model of 30 s windows. SQL can't fit trees; tests hold the model to labelled windows."""
    model = training.scan_detector(spark, 30, 10)
    hits = portscan.scan_decisions(model.score(portscan.scan_candidates(portscan.window_features(views.connections(spark, d), 30, 10))))
    return hits.select(*portscan.KEY, "unique_dst_ports", "failed_connections", "scan_rate", "confidence", "severity")


def _units(spark: SparkSession, d: str, window: int, stride: int | None = None) -> DataFrame:
    rows = units.prepared(views.c2_flows(spark, d))
    return units.unit_features(rows, window, stride, units.origin_us(rows) if stride else None)


@query
def c2_units_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d, 60)


@query
def c2_units_60_10(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d, 60, 10)


@query
def c2_units_300_60(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d, 300, 60)


@query
def c2_ext_features(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d, 60).select(*units.UNIT, *units.EXTENDED[len(units.BASE) :])


@query
def c2_fanin_fanout(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d, 60).select(*units.UNIT, "endpoint_host_fanin", "host_endpoint_fanout")


def _domain_columns(spark: SparkSession, d: str, columns: dict[str, Column]) -> DataFrame:
    return _rounded_doubles(views.domains(spark, d).select("seq", "domain", *(c.alias(n) for n, c in columns.items())))


@query
def dga_char_ratios(spark: SparkSession, d: str) -> DataFrame:
    return _domain_columns(spark, d, D.ratios(F.col("domain")))


@query
def dga_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _domain_columns(spark, d, D.entropies(F.col("domain")))


@query
def dga_consonant_run(spark: SparkSession, d: str) -> DataFrame:
    return _domain_columns(spark, d, {"max_consonant_run": D.longest_consonant_run(F.col("domain"))})


@query
def dga_bigram_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _domain_columns(spark, d, {"common_bigram_ratio": D.common_bigram_ratio(F.col("domain"))})


@query
def dga_transitions(spark: SparkSession, d: str) -> DataFrame:
    return _domain_columns(spark, d, {"digit_alpha_transitions": D.digit_transitions(F.col("domain"))} | D.ends(F.col("domain")))


@query
def dga_safe_domain(spark: SparkSession, d: str) -> DataFrame:
    return _domain_columns(spark, d, {"is_safe": D.is_safe(F.col("domain"))})


@query
def dga_ngram_vocab(spark: SparkSession, d: str) -> DataFrame:
    return domains.ngram_vocabulary(views.domains(spark, d))


@query
def alert_stats_by_class(spark: SparkSession, d: str) -> DataFrame:
    return serving.class_by_severity(views.alerts(spark, d))


@query
def alert_stats_by_severity(spark: SparkSession, d: str) -> DataFrame:
    return serving.counts_by(views.alerts(spark, d), "severity")


@query
def alert_totals(spark: SparkSession, d: str) -> DataFrame:
    return serving.totals(views.alerts(spark, d), AS_OF_US, START_US)


@query
def alert_top_sources(spark: SparkSession, d: str) -> DataFrame:
    return serving.top_sources(views.alerts(spark, d))


@query
def alert_page(spark: SparkSession, d: str) -> DataFrame:
    return serving.page(views.alerts(spark, d), 2, 50, severity="HIGH")[0].select(*ALERT)


@query
def alert_recent(spark: SparkSession, d: str) -> DataFrame:
    return serving.newest_by_arrival(views.alerts(spark, d)).select(*ALERT)


@query
def alert_timeline_10s(spark: SparkSession, d: str) -> DataFrame:
    return serving.timeline(views.alerts(spark, d), AS_OF_US, 60)


@query
def alert_minute_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    return serving.minutes_zero_filled(views.alerts(spark, d), AS_OF_US)


@query
def alert_second_slots(spark: SparkSession, d: str) -> DataFrame:
    return serving.second_slots(views.alerts(spark, d), AS_OF_US)


@query
def alert_search(spark: SparkSession, d: str) -> DataFrame:
    return serving.filtered(views.alerts(spark, d), "113.1", severity="CRITICAL").select(*ALERT)


@query
def alert_worst(spark: SparkSession, d: str) -> DataFrame:
    return serving.worst(views.alerts(spark, d), 10).select(*ALERT)


@query
def alert_status_level(spark: SparkSession, d: str) -> DataFrame:
    return serving.status_level(serving.recent(views.alerts(spark, d), AS_OF_US, 1800))


@query
def alert_active_classes(spark: SparkSession, d: str) -> DataFrame:
    return serving.active_classes(serving.recent(views.alerts(spark, d), AS_OF_US, 1800)).select("threat_class")


@query
def source_risk(spark: SparkSession, d: str) -> DataFrame:
    return serving.source_risk(views.alerts(spark, d))


@query
def alert_describe(spark: SparkSession, d: str) -> DataFrame:
    return views.alerts(spark, d).select("alert_id", serving.sentence().alias("sentence"), serving.ago(F.col("ts_us"), AS_OF_US).alias("ago"))


@query
def alert_dedup_merge(spark: SparkSession, d: str) -> DataFrame:
    """History is the alerts up to an instant, live those from a week before it on: together all, some of them in both."""
    alerts, at = views.alerts(spark, d), AS_OF_US - 14 * 86_400_000_000
    return serving.merged(alerts.where(F.col("ts_us") <= at), alerts.where(F.col("ts_us") > at - 7 * 86_400_000_000)).select(*ALERT)


@query
def severity_bands(spark: SparkSession, d: str) -> DataFrame:
    return views.alerts(spark, d).select("alert_id", severity_by_class(F.col("threat_class"), F.col("confidence")).alias("band"))


@query
def conn_state_histogram(spark: SparkSession, d: str) -> DataFrame:
    return portscan.state_histogram(views.connections(spark, d))


@query
def conn_state_from_packets(spark: SparkSession, d: str) -> DataFrame:
    return _rounded_doubles(connections.records(views.packets(spark, d)))


@query
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return serving.latency_percentiles(views.table(spark, d, "events"), "value")


@query
def pr_curve_best_f1(spark: SparkSession, d: str) -> DataFrame:
    label = (F.col("severity").isin("CRITICAL", "HIGH") & (F.col("threat_class") != "DGA")).cast("int")
    return _rounded_doubles(serving.best_threshold(views.alerts(spark, d).select(F.col("confidence").alias("score"), label.alias("label"))))


@query
def radar_activity(spark: SparkSession, d: str) -> DataFrame:
    return serving.radar(views.alerts(spark, d))


@query
def behavioural_score(spark: SparkSession, d: str) -> DataFrame:
    """With the port and the confidence in percent as the numeric evidence."""
    score, fused = serving.behavioural(F.array(F.col("dst_port").cast("double"), 100 * F.col("confidence")), F.col("confidence"))
    return views.alerts(spark, d).select("alert_id", rounded(score).alias("behavioural"), rounded(fused).alias("fused"))


@query
def c2_model_scores(spark: SparkSession, d: str) -> DataFrame:
    """Units of both timescales under the fitted model of each."""
    rows = units.prepared(views.c2_flows(spark, d))
    at = units.origin_us(rows)
    fitted = training.unit_detectors(spark)
    parts = []
    for name, window, stride in units.TIMESCALES:
        scored = fitted[window].score(units.unit_features(rows, window, stride, at))
        parts.append(scored.select(*units.UNIT, F.lit(name).alias("detector_id"), rounded(F.col("probability")).alias("probability"), "is_attack"))
    return parts[0].unionByName(parts[1])


def _model_scores(flow_rows: DataFrame) -> DataFrame:
    """One chain of scores over the same rows: no flow is assembled twice and nothing is joined."""
    kinds, fitted = list(training.COLUMNS), training.flow_detectors(flow_rows.sparkSession)
    out = flow_rows.withColumn("scoreable", (F.col("total_packets") >= 3) & flows.to_one_host())
    for kind, vector in training.COLUMNS.items():
        among, features = vector()
        scored = fitted[kind].score(out.select(F.struct("*").alias("_flow"), (F.col("scoreable") & among).alias("_among"), *features))
        out = scored.select("_flow.*", F.when(F.col("_among"), F.col("probability")).alias(kind), (F.col("_among") & F.col("is_attack")).alias(f"is_{kind}"))
    name, best = detect.arbitrated({kind: F.coalesce(kind, F.lit(0.0)) for kind in kinds})
    attack = F.greatest(*(F.col(f"is_{kind}") for kind in kinds))
    return _rounded_doubles(out.select(*flows.KEY, *kinds, F.when(attack, name).otherwise("benign").alias("threat"), best.alias("confidence")))


@query
def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """Each flow under the fitted detectors on their own vectors (null: abstains), and the class of the greatest score."""
    return _model_scores(_flows(spark, d))


@query
def attack_model_scores(spark: SparkSession, d: str) -> DataFrame:
    return _model_scores(_attack_flows(spark, d))


@query
def attack_scan_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate window of the attacks' records under the fitted scan model, and what it alerts."""
    windows = live.scan_features(views.attacks(spark, d))
    scored = training.scan_detector(spark, live.SCAN_S, live.SCAN_STRIDE_S).score(portscan.scan_candidates(windows))
    return scored.select("src_ip", "start_us", "unique_dst_ports", "connection_attempts", rounded(F.col("probability"), 4).alias("probability"), (rounded(F.col("probability"), 4) >= portscan.ALERT_AT).alias("alerts"))


@query
def attack_flushed_records(spark: SparkSession, d: str) -> DataFrame:
    """Connection records of the attacks with boundary flushes, and when each is known."""
    return _rounded_doubles(tracking.flushed_records(views.attacks(spark, d), WINDOW_US))


@query
def attack_live_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of the whole live plan on the attacks' packets, with the fitted scan model."""
    found = live.alerts(views.attacks(spark, d), scan_model=training.scan_detector(spark, live.SCAN_S, live.SCAN_STRIDE_S))
    return found.select("alert_id", "timestamp", "threat_class", "confidence", "severity", "src_ip", "dst_ip", "src_port", "dst_port", "flow_id")
