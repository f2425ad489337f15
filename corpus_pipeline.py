"""Corpus pipeline: quality, near-duplicates, repeated passages, benchmark passages, mixture.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and
returns a DataFrame, which ``run`` writes to the shared folder and reads again as the
next stage's ``docs``. All but the last return the columns of ``documents``.

Cases: every stage has its operator's rules for nulls, empty and very long texts, ties and
repeated rows; an empty table stays empty through all stages; columns beyond
those of ``documents`` are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm import decontaminate, mixture, quality, simhash, substrings
from trafficlens.llm.queries import table
from trafficlens.llm.scratch import keep

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that importance resampling towards good text doesn't draw go."""
    return quality.filtered(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least id."""
    return simhash.survivors(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every word inside a repeated window of 35 words goes; documents stay, with n_chars of what is left."""
    cut = substrings.remove_repeats(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    found = decontaminate.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.contaminated()).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes: doc_id, source, size, source_size, target, taken of each document."""
    return mixture.taken(docs.select(*COLUMNS))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("mixture", mixed),
]

#: SQL has no hashed n-gram models, SimHash or drawn permutations; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
