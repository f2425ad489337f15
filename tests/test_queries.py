"""Every registered traffic query against its SQL on the benchmark tables."""

from __future__ import annotations

import pytest

from tests.conftest import SF_DIR, rows
from trafficlens.plans.oracle import ORACLE_SQL
from trafficlens.operators import training
from trafficlens.plans.queries import NO_SQL, QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL) | set(NO_SQL) and not set(ORACLE_SQL) & set(NO_SQL)


@pytest.mark.parametrize(("name", "flows"), [("model_scores", "flow_direction_split"), ("attack_model_scores", None)])
def test_model_scores_cover_all_flows(spark, duck, name, flows):
    got = QUERIES[name](spark, SF_DIR).collect()
    assert {r["threat"] for r in got} <= {*training.VECTORS, "benign"}
    for r in got:
        known = [r[k] for k in training.VECTORS if r[k] is not None]
        assert all(0 <= p <= 1 for p in known) and r["confidence"] == max(known, default=0)
    if flows:
        assert len(got) == len(duck.sql(ORACLE_SQL[flows]).fetchall())
    else:
        assert {"benign", "DataExfiltration"} <= {r["threat"] for r in got}


def test_scan_alerts_are_candidates(spark, duck):
    got = {(r["src_ip"], r["start_us"]) for r in QUERIES["portscan_model_alerts"](spark, SF_DIR).collect()}
    assert got <= {r[:2] for r in duck.sql("select src_ip, start_us from (" + ORACLE_SQL["portscan_candidates"] + ")").fetchall()}


def test_scan_model_alerts_on_a_part_of_the_candidates(spark):
    """All scanners alert, of 10 ports or of 40; servers whose answers go to as many ports are candidates too, and none alerts."""
    got = QUERIES["attack_scan_scores"](spark, SF_DIR).collect()
    alerts = [r for r in got if r["alerts"]]
    assert got and 0.05 * len(got) <= len(alerts) <= 0.95 * len(got)
    assert all(r["alerts"] == (r["probability"] >= 0.6) and r["unique_dst_ports"] >= 10 for r in got)
    assert all(r["alerts"] == r["src_ip"].startswith("10.7.") for r in got)


def test_live_alerts_of_the_attacks(spark):
    got = QUERIES["attack_live_alerts"](spark, SF_DIR).collect()
    assert {r["threat_class"] for r in got} == {"DDoS", "PortScan", "DataExfiltration", "C2_BEACONING", "EncryptedMalware"}
    assert len({r["alert_id"] for r in got}) == len(got)
    # the second beacon of a block calls a server that the sessions claim
    assert all(r["dst_ip"] == "198.51.100.66" for r in got if r["threat_class"] == "C2_BEACONING")


def test_unit_scores(spark):
    got = QUERIES["c2_model_scores"](spark, SF_DIR).collect()
    assert {r["detector_id"] for r in got} == {"fast", "deep"} and all(0 <= r["probability"] <= 1 for r in got)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF_DIR).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize(
    ("name", "hit"),
    [("attack_floods", "is_flood"), ("attack_floods", "scan_shaped"), ("attack_sessions", "is_encrypted_malware"), ("attack_uploads", "is_exfiltration"), ("attack_beacons", "is_beacon"), ("dga_safe_names", "is_safe")],
)
def test_rules_fire_and_abstain(duck, name, hit):
    """Each rule has both outcomes on its view, each in at least one row of twenty."""
    n, hits = duck.sql(f"select count(*), count(*) filter ({hit}) from ({ORACLE_SQL[name]})").fetchall()[0]
    assert 0.05 * n <= hits <= 0.95 * n


def test_claims_suppress_starts(duck):
    claimed = duck.sql(f"select kind, count(*) from ({ORACLE_SQL['attack_claims']}) group by 1").fetchall()
    assert {k for k, n in claimed if n} == {"dst", "src"}
    kept = duck.sql(f"select count(*) from ({ORACLE_SQL['attack_unclaimed_starts']})").fetchall()[0][0]
    every = duck.sql("select count(*) from events where event_id % 500 >= 430 and (event_id % 500 - 430) % 21 % 3 = 0").fetchall()[0][0]
    assert 0 < kept < every
