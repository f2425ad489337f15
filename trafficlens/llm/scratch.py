"""Shared scratch tables: where a job cuts its lineage.

Executors can vanish at any time, so an intermediate result that several later
steps read is written as Parquet into the folder the cluster shares
(``spark.checkpoint.dir``) and read back. Nothing here uses a machine-local
folder unless the session runs in local mode without that setting, as in tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def keep(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a scratch table and return the table as written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Remove scratch tables that ``keep`` returned and that no later job reads."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
