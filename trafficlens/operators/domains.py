"""Domain-name operators: queries worth scoring, and n-gram vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.functions import domains as D


def dns_queries(packets: DataFrame) -> DataFrame:
    """Query names of packets that are not answers and not safe."""
    eligible = (F.coalesce(F.length("dns_query"), F.lit(0)) > 0) & ~((F.col("src_port") == 53) & (F.col("dst_port") != 53))
    return packets.where(eligible & ~D.is_safe(F.col("dns_query"))).select(F.col("dns_query").alias("domain"), "src_ip", "dst_ip", "timestamp_us")


def scored_features(domains: DataFrame, column: str = "domain") -> DataFrame:
    return domains.select("*", *(c.alias(n) for n, c in D.statistics(F.col(column)).items()))


def ngram_vocabulary(domains: DataFrame, size: int = 200, least: int = 2, most: int = 3, column: str = "domain") -> DataFrame:
    """The ``size`` n-grams of first labels in most rows; ties in n-gram order."""
    grams = domains.select(F.explode(F.array_distinct(D.character_ngrams(D.label(F.col(column)), least, most))).alias("ngram"))
    return grams.groupBy("ngram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ngram").limit(size)
