"""Rows that are dealt to overlapping windows come to tasks of a bounded size."""

from __future__ import annotations

import pytest

from tests.conftest import SF_DIR, rows
from trafficlens import views
from trafficlens.operators import portscan, tracking
from trafficlens.plans import live
from trafficlens.plans.oracle import ORACLE_SQL
from trafficlens.plans.queries import QUERIES
from trafficlens.schemas import WINDOW_US


def test_tasks_grow_with_the_dealt_rows(spark, monkeypatch):
    flows = views.connections(spark, SF_DIR)
    monkeypatch.setattr(portscan, "TASK_ROWS", 1000)
    least = flows.count() * 5 // 1000
    assert portscan.dealt_in_buckets(flows, ("src_ip",), 10, 2).rdd.getNumPartitions() >= least


@pytest.mark.parametrize("name", ["portscan_windows_10_2", "portscan_windows_30_10", "portscan_candidates"])
def test_many_tasks_equal_sql(spark, duck, monkeypatch, name):
    monkeypatch.setattr(portscan, "TASK_ROWS", 1000)
    assert rows(QUERIES[name](spark, SF_DIR).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())


def test_live_scan_windows_are_sized_by_packets(spark, monkeypatch):
    packets = views.attacks(spark, SF_DIR)
    plain = portscan.features(live.scan_rows(tracking.flushed_records(packets, WINDOW_US)), live.SCAN_S)
    monkeypatch.setattr(portscan, "TASK_ROWS", 100)
    sized = live.scan_features(packets)
    assert sized.rdd.getNumPartitions() >= packets.count() * 5 // 100 and rows(sized.toPandas()) == rows(plain.toPandas())
