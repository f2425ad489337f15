"""Units are shuffled once, by host; their fan-in comes from bits of panes."""

from __future__ import annotations

import pytest

from tests.conftest import SF_DIR, rows
from trafficlens.operators import portscan, units
from trafficlens.plans.oracle import ORACLE_SQL
from trafficlens.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["c2_units_60_10", "c2_units_300_60", "c2_units_tumbling"])
def test_many_tasks_equal_sql(spark, duck, monkeypatch, name):
    monkeypatch.setattr(portscan, "TASK_ROWS", 1000)
    assert rows(QUERIES[name](spark, SF_DIR).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())


def _flows(spark):
    """Hosts and endpoints, some without a name, over panes before and after the origin."""
    made = spark.range(3000).selectExpr(
        "(xxhash64(id, 't') % 400) * 1000000 + 3 as ts_us", "nullif('h' || pmod(xxhash64(id, 'h'), 7), 'h0') as orig_h", "nullif('e' || pmod(xxhash64(id, 'e'), 5), 'e0') as resp_h",
        "pmod(id, 2) as resp_p", "'tcp' as proto", "id % 9 as orig_pkts", "id % 4 as duration",
    )
    return units.prepared(made)


@pytest.mark.parametrize(("window", "stride"), [(60, 10), (300, 60), (60, 60), (64, 2), (70, 2), (25, 10)])
def test_pairs_are_the_units_of_the_dealt_rows(spark, window, stride):
    """Bits of panes, at most 32 to a window, and dealt rows otherwise."""
    flows = _flows(spark)
    want = portscan.dealt(flows, window, stride, origin_us=7).select(*units.UNIT).distinct()
    got = units._pairs(flows, window, stride, 7).select(*units.UNIT)
    assert rows(got.toPandas()) == rows(want.toPandas())


def test_units_are_shuffled_once(spark):
    plan = units.unit_features(_flows(spark), 60, 10, 0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_many_endpoints_are_joined_without_broadcast(spark, monkeypatch):
    few = units.unit_features(_flows(spark), 60, 10, 0).toPandas()
    monkeypatch.setattr(units, "MOST_ENDPOINTS", 3)
    many = units.unit_features(_flows(spark), 60, 10, 0).toPandas()
    assert len(few) > 100 and few.notna()[["orig_h", "resp_h"]].all(axis=None) and rows(few) == rows(many)
