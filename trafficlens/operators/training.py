"""Training of the detectors on the vectors that they later score.

Labelled traffic is made as packets, connections or flow records and goes through the same
operators as live traffic, so a feature means the same in training and in scoring. A detector that
was fitted is kept for the application; ``models.save`` and ``models.load`` keep it for longer.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.operators import flows, models, portscan, units
from trafficlens.schemas import WINDOW_US
from trafficlens.sources import synthetic

#: The vector of each flow class
VECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"DDoS": flows.flood_vector, "DataExfiltration": flows.exfiltration_vector, "EncryptedMalware": flows.encrypted_vector}
#: The same as which flows it has and its features
COLUMNS: dict[str, Callable[[], flows.Vector]] = {"DDoS": flows.flood_columns, "DataExfiltration": flows.exfiltration_columns, "EncryptedMalware": flows.encrypted_columns}
#: Benign and attacking flows that each class is fitted on
SIZES = {"DDoS": (20_000, 10_000), "DataExfiltration": (20_000, 10_000), "EncryptedMalware": (30_000, 15_000)}
#: Partitions of the training rows. They are 45,000 at most, and every level of every tree is a job over them
PARTS = 4
_fitted: dict[tuple[str, str], models.Detector] = {}


def features_of(vector: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in vector.columns if c not in (*flows.KEY, "label"))


def flow_rows(spark: SparkSession, kind: str, benign: int = 1000, attack: int = 500, first: int = 0, profiles: dict = synthetic.PROFILES) -> DataFrame:
    """Vectors of made-up flows of a class, with label: attacks are in odd windows."""
    vector = VECTORS[kind](flows.assembled(synthetic.labelled_packets(spark, kind, benign, attack, first, profiles)))
    return vector.withColumn("label", (F.col("window_us") / WINDOW_US % 2).cast("int"))


def scan_rows(spark: SparkSession, window_s: float = 30, stride_s: float = 10, benign: int = 400, attack: int = 200, first: int = 0) -> DataFrame:
    """Scan windows of made-up sources, with label."""
    made = synthetic.labelled_connections(spark, benign, attack, first)
    windows = portscan.window_features(made, window_s, stride_s)
    return windows.withColumn("label", F.col("src_ip").startswith("10.61.").cast("int"))


def unit_rows(spark: SparkSession, window_s: int, benign: int = 400, attack: int = 200, first: int = 0) -> DataFrame:
    """Tumbling units of made-up hosts, with label."""
    made = units.prepared(synthetic.labelled_beacons(spark, window_s, benign, attack, first))
    return units.unit_features(made, window_s).withColumn("label", F.col("orig_h").startswith("10.71.").cast("int"))


def _kept(spark: SparkSession, name: str, fit: Callable[[], models.Detector]) -> models.Detector:
    key = (spark.sparkContext.applicationId, name)
    if key not in _fitted:
        _fitted[key] = fit()
    return _fitted[key]


def prepared(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Training rows in ``PARTS`` partitions and one order, whatever the session's shuffles: fits are as fast and give the same on every cluster."""
    return rows.repartition(PARTS, *key).sortWithinPartitions(*key)


def _fit(rows: DataFrame, name: str, features: Sequence[str], key: Sequence[str], **options: object) -> models.Detector:
    rows = prepared(rows, key).cache()
    rows.count()  # else the fits side by side would each make them
    try:
        return models.fit(rows, name, features, key, **options)
    finally:
        rows.unpersist()


def flow_detector(spark: SparkSession, kind: str, **options: int) -> models.Detector:
    """A detector of a flow class on its own vector, fitted on ``SIZES`` flows."""

    def fit() -> models.Detector:
        rows = flow_rows(spark, kind, *SIZES[kind])
        return _fit(rows, kind, features_of(rows), flows.KEY, **options)

    return _kept(spark, kind, fit)


def flow_detectors(spark: SparkSession, **options: int) -> dict[str, models.Detector]:
    """The detectors of all flow classes, fitted side by side."""
    fits = [partial(flow_detector, spark, kind, **options) for kind in SIZES]
    return dict(zip(SIZES, models.at_once(spark, fits), strict=True))


def unseen_metrics(detector: models.Detector, spark: SparkSession, kind: str, threshold: float, benign: int = 1000, attack: int = 500) -> DataFrame:
    """How a detector fares on flows of profiles that it was not fitted on (``synthetic.UNSEEN``), in one row."""
    rows = flow_rows(spark, kind, benign, attack, 200_000, synthetic.UNSEEN)
    return models.metrics(detector.score(rows), threshold)


def scan_detector(spark: SparkSession, window_s: float = 30, stride_s: float = 10, **options: int) -> models.Detector:
    """A detector of scan windows of a geometry."""
    fit = lambda: _fit(scan_rows(spark, window_s, stride_s), "PortScan", portscan.FEATURES, portscan.KEY, window_s=float(window_s), stride_s=float(stride_s), **options)
    return _kept(spark, f"PortScan-{window_s}-{stride_s}", fit)


def unit_detector(spark: SparkSession, window_s: int, **options: int) -> models.Detector:
    """A detector of beacon units of a timescale; missing values are imputed."""
    fit = lambda: _fit(unit_rows(spark, window_s), "C2_BEACONING", units.EXTENDED, units.UNIT, impute=True, window_s=float(window_s), **options)
    return _kept(spark, f"C2-{window_s}", fit)


def unit_detectors(spark: SparkSession, **options: int) -> dict[int, models.Detector]:
    """The detectors of both timescales by window, fitted side by side."""
    sizes = [window for _, window, _ in units.TIMESCALES]
    return dict(zip(sizes, models.at_once(spark, [partial(unit_detector, spark, window, **options) for window in sizes]), strict=True))


def forget() -> None:
    """Drop all kept detectors."""
    _fitted.clear()
