"""Small helpers that the operators share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; all other characters stay, unlike lower()."""
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once a row, however often the body or its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local session may do without the setting."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not sc.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "checkpoints")).rstrip("/")


#: Spark then drops the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with reliable files in the cluster's shared spark.checkpoint.dir.

    Where the setting is absent in a local session (tests) a folder below the warehouse is used.  Once
    the files are written nothing reads the shuffles behind them again, so these go at once and do
    not wait on the executors' disks for the driver to collect its garbage.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


#: bytes of a batch that a Python worker gets at once; a single longer text is a batch of its own
BATCH = 8 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df, after bounding the session's Arrow batches by bytes, as 10,000 texts of any length have no bound.

    A smaller setting of the session stays.
    """
    conf = df.sparkSession.conf
    if int(str(conf.get(_BYTES, "67108864")).rstrip("bB")) > BATCH:
        conf.set(_BYTES, str(BATCH))
    return df


def fresh(name: str) -> str:
    """A column name that clashes with no column of a caller."""
    return f"_{name}_{uuid.uuid4().hex[:8]}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
