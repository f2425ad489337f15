"""Training data from files: flow tables with a header, and lists of host names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names that a list gives at most
MOST_NAMES = 10_000


def flow_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with header; spaces around its column names go."""
    raw = spark.read.csv(path, header=True, inferSchema=True)
    return raw.toDF(*(c.strip() for c in raw.columns))


def name_list(spark: SparkSession, path: str, most: int = MOST_NAMES, ranked: bool = False) -> DataFrame:
    """The first names of a list, one a line; of ``ranked`` lines ("1,name") what follows the last comma."""
    lines = spark.read.text(path).select(F.trim("value").alias("domain"), F.monotonically_increasing_id().alias("line")).where("domain <> ''")
    name = F.substring_index("domain", ",", -1) if ranked else F.col("domain")
    return lines.orderBy("line").limit(most).select(name.alias("domain"))
