"""Intermediate tables in the folder that the driver and all executors share.

A written table cuts the lineage: what a lost executor held of it can be read again by any other.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of our own if driver and executors are one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spanquarry.shared.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanquarry-")
        spark.conf.set("spanquarry.shared.dir", found)
        atexit.register(shutil.rmtree, found[7:], True)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to at most ``BATCH_ROWS`` rows: whole texts make the default of 10,000
    rows tens of MB, held by the JVM and by the worker of every task at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


class Scratch:
    """Tables of one query below one folder of the shared directory."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` as Parquet and returns the table read back."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once, for plans that read it several times."""
    return Scratch(df.sparkSession, name).save(df, name)
