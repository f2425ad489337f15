"""Fits take the same few partitions on every session and run side by side."""

from __future__ import annotations

from threading import Barrier

import pytest

from trafficlens.operators import models, portscan, training, units


@pytest.fixture
def many_shuffles(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    training.forget()
    yield
    training.forget()
    for k, v in old.items():
        spark.conf.set(k, v)


def test_training_rows_have_few_partitions_whatever_the_session(spark, monkeypatch, many_shuffles):
    seen = []
    monkeypatch.setattr(models, "fit", lambda rows, *a, **k: seen.append(rows.rdd.getNumPartitions()))
    monkeypatch.setattr(training, "scan_rows", lambda s, *a: s.range(50).selectExpr("string(id) as src_ip", "id as start_us").repartition("src_ip"))
    monkeypatch.setattr(training, "unit_rows", lambda s, *a: s.range(50).selectExpr("id as start_us", "'h' as orig_h", "'r' as resp_h", "1L as resp_p", "'tcp' as proto").repartition("start_us"))
    training.scan_detector(spark, 30, 10)
    assert set(training.unit_detectors(spark)) == {w for _, w, _ in units.TIMESCALES}
    assert seen == [training.PARTS] * 3


def test_folds_are_fitted_side_by_side(spark, monkeypatch):
    """Three folds and the whole meet at a barrier, which fits one after another never would."""
    meet, real = Barrier(4, timeout=60), models.Pipeline.fit

    def fit(self, rows, *args):
        meet.wait()
        return real(self, rows, *args)

    monkeypatch.setattr(models.Pipeline, "fit", fit)
    rows = spark.range(200).selectExpr("string(id) as src_ip", "id as start_us", "double(id % 2) + double(id) / 1000 as x", "int(id % 2) as label")
    detector = models.fit(rows, "made", ("x",), portscan.KEY, trees=2, depth=1)
    assert detector.score(rows).where("is_attack != (label = 1)").count() == 0
