"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 6) -> Column:
    """Half-up rounding that does the same on every engine."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def ratio(a: Column, b: Column) -> Column:
    """a / max(b, 1)."""
    return a / F.greatest(b, F.lit(1))


def or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def banded(score: Column, bands: tuple[tuple[float, str], ...], below: str) -> Column:
    """The first band whose bound the score reaches."""
    out = F.when(score >= bands[0][0], bands[0][1])
    for bound, name in bands[1:]:
        out = out.when(score >= bound, name)
    return out.otherwise(below)


# Lower bounds of CRITICAL, HIGH and MEDIUM for each rule or model.
BANDS = {
    "PortScan": (0.98, 0.90, 0.80),
    "DDoS": (0.97, 0.93, 0.0),
    "DDoSModel": (0.99, 0.95, 0.90),
    "DataExfiltration": (0.99, 0.95, 0.90),
    "EncryptedMalware": (0.95, 0.85, 0.70),
    "C2_BEACONING": (0.95, 0.85, 0.75),
    "DGA": (0.95, 0.90, 0.80),
}


def severity(kind: str, score: Column) -> Column:
    """Severity of a score under a class's bands."""
    return banded(score, tuple(zip(BANDS[kind], ("CRITICAL", "HIGH", "MEDIUM"), strict=True)), "LOW")


def severity_by_class(threat_class: Column, score: Column) -> Column:
    """Severity for rows of several classes; an unknown class uses the DGA bands."""
    out = F.when(threat_class == "PortScan", severity("PortScan", score))
    for kind in ("DDoS", "DataExfiltration", "EncryptedMalware", "C2_BEACONING"):
        out = out.when(threat_class == kind, severity(kind, score))
    return out.otherwise(severity("DGA", score))
