"""Session defaults and reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ready(spark: SparkSession) -> SparkSession:
    """Settings that every plan of this package relies on."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def _checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="hazeline-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors see."""
    _checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write the rows once as a table in the shared checkpoint folder and go on from there.

    Used where a plan depends on *where* a row was placed (range placement), where a small
    table is read many times, or between iterations: a lost executor re-reads the same rows
    instead of recomputing them. Parquet keeps column pruning and pushdown for later reads.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for the small state of an iteration (a row per model)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Broadcast hint for a (written) table of at most `rows` rows; a larger one is left to an ordinary join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
