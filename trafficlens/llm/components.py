"""Connected components over an edge table, in rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.scratch import drop, keep

MAX_ROUNDS = 60


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def stars(edges: DataFrame) -> DataFrame:
    """(a, b) edges of any components to (a, root) for every node but the roots, the least nodes.

    A large star ties a node's greater neighbours to its least neighbour, a small
    star its lesser ones; both only regroup edges, so their number never grows. Each
    round is written to the shared folder, which cuts the lineage, and the one before is
    dropped. The least neighbours are written as well: a join then deals both sides
    anew, so adaptive skew handling can split a node of many edges.
    """
    both = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = keep(both.distinct(), "edges")
    seen = _digest(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            return now.select("a", F.col("b").alias("root"))
        each = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = keep(each.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = each.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        large = keep(large.distinct(), "large")
        least_large = keep(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least_large, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        last, now = now, keep(small.select("e.a", "e.b").where("a != b").distinct(), "edges")
        before, seen = seen, _digest(now)
        drop(last, least, large, least_large)
        if before == seen:
            return now.select("a", F.col("b").alias("root"))
    raise RuntimeError("components did not settle")
