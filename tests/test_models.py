"""Fitted detectors: calibration, artifacts, and their contract."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficlens.operators import models, portscan, training, units
from trafficlens.operators.flows import KEY
from trafficlens.plans import live
from trafficlens.sources import synthetic

FLOOD, UPLOAD = "DDoS", "DataExfiltration"


@pytest.fixture(scope="module")
def detector(spark):
    rows = training.flow_rows(spark, UPLOAD, 200, 100)
    return models.fit(rows, UPLOAD, training.features_of(rows), KEY, trees=5, depth=3, folds=2)


def test_scores_are_calibrated_and_right(spark, detector):
    scored = detector.score(training.flow_rows(spark, UPLOAD, 200, 100, first=10_000)).cache()
    m = models.metrics(scored, detector.contract.threshold).first()
    assert m["f1"] > 0.95 and m["tp"] + m["fn"] == 100
    p, y = (list(x) for x in zip(*((r["probability"], r["label"]) for r in scored.collect()), strict=True))
    pairs = [(a > b) + 0.5 * (a == b) for a, i in zip(p, y, strict=True) if i for b, j in zip(p, y, strict=True) if not j]
    assert models.auc(scored) == pytest.approx(sum(pairs) / len(pairs))
    assert scored.where(~F.col("probability").between(0, 1)).count() == 0


def test_probabilities_equal_a_plain_walk_of_the_trees(spark, detector, tmp_path):
    """Every tree walked by its saved nodes, the margins summed, and the isotonic steps interpolated by hand."""
    rows = training.flow_rows(spark, UPLOAD, 60, 60, first=20_000).cache()
    boosted = detector.model.stages[-1]
    boosted.write().overwrite().save(str(tmp_path / "trees"))
    trees = {}
    for r in spark.read.parquet(str(tmp_path / "trees" / "data")).select("treeID", "nodeData.*").collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r

    def walked(tree, x):
        node = tree[0]
        while node["leftChild"] >= 0:
            split = node["split"]
            node = tree[node["leftChild"] if x[split["featureIndex"]] <= split["leftCategoriesOrThreshold"][0] else node["rightChild"]]
        return node["prediction"]

    steps, levels = (list(map(float, v.toArray())) for v in (detector.calibration.boundaries, detector.calibration.predictions))
    got = detector.score(rows).select("probability", *detector.contract.features).collect()
    assert len(trees) == 5 and len(got) == rows.count()
    for r in got:
        x = [float(r[f]) for f in detector.contract.features]
        margin = sum(w * walked(trees[k], x) for k, w in enumerate(boosted.treeWeights))
        assert r["probability"] == pytest.approx(np.interp(1 / (1 + math.exp(-2 * margin)), steps, levels), abs=1e-9)


def test_artifact_round_trip(spark, detector, tmp_path):
    models.save(detector, str(tmp_path / "a"), spark)
    again = models.load(spark, str(tmp_path / "a"), detector.contract.features)
    assert again.contract == detector.contract
    rows = training.flow_rows(spark, UPLOAD, 20, 20)
    assert detector.score(rows).select(*KEY, "probability").sort(*KEY).collect() == again.score(rows).select(*KEY, "probability").sort(*KEY).collect()
    with pytest.raises(ValueError, match="order"):
        models.load(spark, str(tmp_path / "a"), detector.contract.features[::-1])


@pytest.mark.parametrize("change", [{"calibration": "none"}, {"format": 9}, {"features": ("a", "a")}, {"features": ("src_ip",)}, {"window_s": 10.0, "stride_s": 20.0}, {"threshold": 2.0}])
def test_contract_is_enforced(change):
    good = models.Contract("x", ("a", "b"), 0.5)
    models.validate(good)
    with pytest.raises(ValueError):
        models.validate(replace(good, **change))


def test_domain_model(spark):
    odd = synthetic.lookups(spark, 60).select(F.col("dns_query").alias("domain"), F.lit(1).alias("label"))
    words = ["mail", "shop", "news", "photos", "travel", "cloud", "garden", "music", "weather", "school"]
    plain = spark.createDataFrame([(f"{a}{b}.com", 0) for a in words for b in words[:6]], "domain string, label int")
    detector = models.fit_domains(odd.unionByName(plain), folds=2, trees=3, depth=3)
    scored = detector.score(models.domain_rows(spark.createDataFrame([("schoolnews.com",), ("x9kq2z7bd4kxq1.info",)], "domain string")))
    p = {r["domain"]: r["probability"] for r in scored.collect()}
    assert p["x9kq2z7bd4kxq1.info"] > 0.8 > 0.2 > p["schoolnews.com"]


def test_corpus_digest_ignores_order(spark):
    a = training.flow_rows(spark, FLOOD, 20, 10)
    assert models.corpus_digest(a) == models.corpus_digest(a.orderBy(F.desc("window_us"))) != models.corpus_digest(a.where("window_us > 0"))


@pytest.mark.parametrize(("kind", "scale"), [("forest", False), ("boosted", True)])
def test_forest_and_scaled_features(spark, kind, scale):
    rows = training.flow_rows(spark, FLOOD, 150, 80).cache()
    detector = models.fit(rows, FLOOD, training.features_of(rows), KEY, trees=4, depth=3, folds=2, kind=kind, scale=scale)
    unseen = training.flow_rows(spark, FLOOD, 100, 50, first=10_000)
    assert models.metrics(detector.score(unseen), detector.contract.threshold).first()["f1"] > 0.95


def test_ngrams_of_whole_names(spark):
    r = models.domain_rows(spark.createDataFrame([("ab.io",)], "domain string"), 2, 4, whole=True).first()
    assert "ab.i" in r["ngrams"] and ".i" in r["ngrams"]


@pytest.mark.parametrize("kind", list(training.VECTORS))
def test_flow_detectors_on_unseen_flows(spark, kind):
    rows = training.flow_rows(spark, kind, 200, 100)
    labels = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert set(labels) == {0, 1} and min(labels.values()) > 50 and "label" not in training.features_of(rows)
    detector = training.flow_detector(spark, kind, trees=5, depth=3, folds=2)
    assert training.flow_detector(spark, kind) is detector
    threshold = live.ALERT_AT.get(kind, detector.contract.threshold)
    m = models.metrics(detector.score(training.flow_rows(spark, kind, 200, 100, first=50_000)), threshold).first()
    assert m["f1"] > 0.9
    other = training.unseen_metrics(detector, spark, kind, threshold, 200, 100).first()
    # Recall on profiles that training has not seen is far lower (README); 0.3 lies under the 0.38 of the worst of these small models.
    assert other["fpr"] <= 0.02 and other["tp"] >= 0.3 * (other["tp"] + other["fn"]) > 0


def test_unseen_profiles_share_no_port_with_those_of_training():
    ports = lambda sides: {p for side in sides for profile in side for p in profile["ports"]}
    for kind, sides in synthetic.UNSEEN.items():
        assert len(ports(sides) - ports(synthetic.PROFILES[kind])) >= 0.8 * len(ports(sides)) and kind in training.SIZES


def test_scan_detector(spark):
    detector = training.scan_detector(spark, 30, 10, trees=5, depth=3, folds=2)
    assert (detector.contract.window_s, detector.contract.stride_s, detector.contract.features) == (30.0, 10.0, portscan.FEATURES)
    scored = detector.score(training.scan_rows(spark, first=50_000)).cache()
    assert models.metrics(scored, detector.contract.threshold).first()["f1"] > 0.9
    decided = portscan.scan_decisions(scored)
    assert decided.where("label = 0").count() == 0 < decided.where("label = 1").count()


def test_unit_detector(spark):
    detector = training.unit_detector(spark, 60, trees=5, depth=3, folds=2)
    scored = detector.score(training.unit_rows(spark, 60, first=50_000))
    assert models.metrics(scored, detector.contract.threshold).first()["f1"] > 0.9
    alerts = units.unit_alerts(scored.withColumn("flow_id", F.array(F.lit("C1"))), "c2-fast", "fast", detector.contract.threshold)
    assert alerts.count() > 50


def test_held_out_keeps_shares(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    train, test = models.held_out(rows, "id")
    assert test.where("label = 1").count() == 25 and test.where("label = 0").count() == 225 and train.count() == 750 and train.join(test, "id").count() == 0
