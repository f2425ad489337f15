"""Fitted detectors: gradient-boosted trees with cross-fitted, calibrated scores.

``fit`` predicts every row by models that haven't seen it, calibrates those scores by
isotonic regression, picks the threshold of greatest F1, and refits on all rows. An
artifact is a folder with the pipeline, the calibration and a JSON sidecar; ``load``
refuses one whose contract doesn't match. A missing artifact means abstention: no score.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import CountVectorizer, Imputer, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.functions import domains as D
from trafficlens.operators.serving import best_threshold

FORMAT = 1
#: Columns that identify a row and must never be features
IDENTIFIERS = frozenset({"src_ip", "dst_ip", "orig_h", "resp_h", "flow_key", "flow_id", "uid", "window_us", "start_us"})


@dataclass(frozen=True)
class Contract:
    """What an artifact promises."""

    name: str
    features: tuple[str, ...]
    threshold: float
    calibration: str = "isotonic"
    format: int = FORMAT
    version: str = "1.0.0"
    window_s: float | None = None
    stride_s: float | None = None


@dataclass
class Detector:
    contract: Contract
    model: PipelineModel
    calibration: IsotonicRegressionModel

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probability`` and ``is_attack``; rows keep all their columns."""
        raw = _raw(self.model, df)
        scored = self.calibration.setPredictionCol("probability").transform(raw).drop("raw_score")
        return scored.withColumn("is_attack", F.col("probability") >= self.contract.threshold)


def check_features(features: Sequence[str]) -> None:
    """Features are distinct and identify nobody."""
    if len(set(features)) != len(features) or not features:
        raise ValueError("features repeat or are missing")
    if leaked := IDENTIFIERS & set(features):
        raise ValueError(f"identifiers as features: {sorted(leaked)}")


def _raw(model: PipelineModel, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    added = [c for c in out.columns if c not in df.columns]
    return out.withColumn("raw_score", vector_to_array("probability")[1]).drop(*added)


def _classifier(kind: str, trees: int, depth: int, seed: int) -> GBTClassifier | RandomForestClassifier:
    """Boosted trees ("boosted") or a random forest ("forest") on ``feature_vector``."""
    if kind == "forest":
        return RandomForestClassifier(featuresCol="feature_vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)
    if kind != "boosted":
        raise ValueError(f"no classifier {kind}")
    return GBTClassifier(featuresCol="feature_vector", labelCol="label", maxIter=trees, maxDepth=depth, seed=seed)


def _pipeline(features: Sequence[str], trees: int, depth: int, impute: bool, seed: int, kind: str = "boosted", scale: bool = False) -> Pipeline:
    names = [f"{f}__imputed" for f in features] if impute else list(features)
    stages = [Imputer(strategy="median", inputCols=list(features), outputCols=names)] if impute else []
    stages += [VectorAssembler(inputCols=names, outputCol="unscaled" if scale else "feature_vector")]
    stages += [StandardScaler(inputCol="unscaled", outputCol="feature_vector", withMean=True)] if scale else []
    return Pipeline(stages=[*stages, _classifier(kind, trees, depth, seed)])


def fold(n: int, *key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), *key), F.lit(n))


def at_once(spark: SparkSession, jobs: Sequence[Callable[[], object]]) -> list:
    """Results of independent jobs that run side by side: a fit is many small jobs one after another, which leave most cores idle."""
    with ThreadPool(len(jobs)) as pool:
        return pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs])


def cross_scores(rows: DataFrame, fitted: Sequence[PipelineModel], *key: str) -> DataFrame:
    """raw_score of every row by the model that was fitted on the other folds."""
    parts = [_raw(model, rows.where(fold(len(fitted), *key) == k)) for k, model in enumerate(fitted)]
    return reduce(DataFrame.unionByName, parts)


def fit(rows: DataFrame, name: str, features: Sequence[str], key: Sequence[str] = ("id",), trees: int = 20, depth: int = 5, folds: int = 3, impute: bool = False, seed: int = 42, kind: str = "boosted", scale: bool = False, **geometry: float) -> Detector:
    """A calibrated detector from rows with ``label`` 0/1: boosted trees or a forest, on scaled features if asked."""
    check_features(features)
    pipeline = _pipeline(features, trees, depth, impute, seed, kind, scale)
    return _calibrated(pipeline, rows, name, tuple(features), key, folds, **geometry)


def _calibrated(pipeline: Pipeline, rows: DataFrame, name: str, features: tuple[str, ...], key: Sequence[str], folds: int, **geometry: float) -> Detector:
    parts = [rows.where(fold(folds, *key) != k) for k in range(folds)]
    *fitted, whole = at_once(rows.sparkSession, [partial(pipeline.fit, part) for part in (*parts, rows)])
    held = cross_scores(rows, fitted, *key).select(F.col("label").cast("double").alias("label"), "raw_score").cache()
    calibration = IsotonicRegression(featuresCol="raw_score", labelCol="label", predictionCol="probability").fit(held)
    scored = calibration.transform(held)
    best = best_threshold(scored, "probability", "label").first()
    held.unpersist()
    return Detector(Contract(name, features, float(best["threshold"]), **geometry), whole, calibration)


def metrics(scored: DataFrame, threshold: float, score: str = "probability", label: str = "label") -> DataFrame:
    """One row: confusion counts, accuracy, F1 and false-positive rate at a threshold."""
    hit, true = F.col(score) >= threshold, F.col(label) == 1
    counts = scored.agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return counts.select(
        "*",
        ((F.col("tp") + F.col("tn")) / total).alias("accuracy"),
        (2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1))).alias("f1"),
        (F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1))).alias("fpr"),
    )


def auc(scored: DataFrame, score: str = "probability", label: str = "label") -> float:
    """Area under the ROC curve."""
    rows = scored.select(F.col(score).cast("double").alias("score"), F.col(label).cast("double").alias("label"))
    return BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label").evaluate(rows)


def held_out(rows: DataFrame, key: str, label: str = "label", share: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Training and test rows: the same share of each label goes to the test, by hash order of the key."""
    h = F.xxhash64(F.lit("held-out"), F.col(label), key)
    cuts = rows.groupBy(label).agg(F.percentile(h, share).alias("_cut")).withColumnRenamed(label, "_label")
    told = rows.join(cuts, F.col(label).eqNullSafe(F.col("_label"))).withColumn("_test", h <= F.col("_cut"))
    return tuple(told.where(test).select(rows.columns) for test in (~F.col("_test"), F.col("_test")))


def domain_pipeline(vocabulary: int = 200, trees: int = 20, depth: int = 5, seed: int = 42) -> Pipeline:
    """19 character statistics and counts of frequent character 2- and 3-grams of the first label."""
    names = [*D.statistics(F.col("domain"))]
    return Pipeline(
        stages=[
            SQLTransformer(statement="SELECT * FROM __THIS__"),
            CountVectorizer(inputCol="ngrams", outputCol="ngram_counts", vocabSize=vocabulary),
            VectorAssembler(inputCols=[*names, "ngram_counts"], outputCol="feature_vector"),
            _classifier("boosted", trees, depth, seed),
        ]
    )


def domain_rows(df: DataFrame, least: int = 2, most: int = 3, whole: bool = False) -> DataFrame:
    """Domains with the columns that the domain pipeline reads; n-grams of the first label or the whole name."""
    stats = {n: c.cast("double").alias(n) for n, c in D.statistics(F.col("domain")).items()}
    text = F.col("domain") if whole else D.label(F.col("domain"))
    return df.select("*", *stats.values(), D.character_ngrams(text, least, most).alias("ngrams"))


def fit_domains(labelled: DataFrame, folds: int = 3, **options: int) -> Detector:
    """A detector of generated names from rows (domain, label)."""
    rows = domain_rows(labelled)
    return _calibrated(domain_pipeline(**options), rows, "dga", (*D.statistics(F.col("domain")), "ngrams"), ("domain",), folds)


def save(detector: Detector, path: str, spark: SparkSession) -> None:
    """Pipeline, calibration and sidecar under one path."""
    detector.model.write().overwrite().save(f"{path}/model")
    detector.calibration.write().overwrite().save(f"{path}/calibration")
    sidecar = json.dumps(asdict(detector.contract), sort_keys=True)
    spark.createDataFrame([(sidecar,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/contract")


def validate(contract: Contract, features: Sequence[str] | None = None) -> None:
    """Raise unless an artifact's contract is one that may emit a confidence."""
    check_features(contract.features)
    if contract.format != FORMAT:
        raise ValueError(f"artifact format {contract.format}")
    if contract.calibration not in ("isotonic", "sigmoid"):
        raise ValueError("an uncalibrated model may not emit a confidence")
    if features is not None and tuple(features) != tuple(contract.features):
        raise ValueError("feature order differs from the artifact's")
    if contract.window_s is not None and not 0 < (contract.stride_s or contract.window_s) <= contract.window_s:
        raise ValueError("a stride must be positive and no longer than the window")
    if not 0 <= contract.threshold <= 1:
        raise ValueError("a threshold lies between 0 and 1")


def load(spark: SparkSession, path: str, features: Sequence[str] | None = None) -> Detector:
    raw = json.loads(spark.read.text(f"{path}/contract").first()["value"])
    contract = Contract(**(raw | {"features": tuple(raw["features"])}))
    validate(contract, features)
    return Detector(contract, PipelineModel.load(f"{path}/model"), IsotonicRegressionModel.load(f"{path}/calibration"))


def corpus_digest(rows: DataFrame) -> str:
    """A fingerprint of training rows that doesn't depend on their order."""
    one = rows.select(F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256).alias("h"))
    parts = one.agg(F.count("*").alias("n"), *(F.sum(F.conv(F.substring("h", k, 8), 16, 10).cast("long")).alias(f"s{k}") for k in (1, 9, 17, 25)))
    return parts.select(F.sha2(F.concat_ws("-", *parts.columns), 256).alias("d")).first()["d"]
