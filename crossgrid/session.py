"""Session helpers: lazy table access, shared scratch folders, one-row parameter attachment."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


class Tables:
    """Lazy access to the parquet tables of one directory: ``Tables(spark, dir).lineitem``."""

    def __init__(self, spark: SparkSession, sf_dir: str, conditions: dict | None = None):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.conditions = dict(conditions or {})

    def where(self, **conditions) -> Tables:
        """The same tables, some of them filtered: ``where(lineitem=condition)``."""
        return Tables(self.spark, self.sf_dir, self.conditions | conditions)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return table.filter(self.conditions[name]) if name in self.conditions else table


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only where the session names none (a local test session) is a folder of our own set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="crossgrid-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back.

    Used where a result feeds several branches; it survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, label: str) -> DataFrame:
    """An aggregated table for one side of a join, written once (when this is called). Its size in bytes is then known,
    and Spark chooses the join by its own threshold."""
    return materialize(df, label)


def attach_params(df: DataFrame, params: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (the result of a global aggregate) to every row.

    The right side has exactly one row by construction, so broadcasting it is bounded.
    """
    left = df.withColumn("_one", F.lit(1))
    right = params.withColumn("_one", F.lit(1))
    return left.join(F.broadcast(right), "_one").drop("_one")


def rounded(col, digits: int = 6):
    """Round for output; ``+ 0.0`` turns a negative zero into zero."""
    if isinstance(col, str):
        col = F.col(col)
    return F.round(col.cast("double"), digits) + F.lit(0.0)
