"""Session helpers: table loading, checkpoints and the size check behind every broadcast."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes, that an operator broadcasts; beyond it the same join is a shuffle join.
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; one of the local file system is set only for a local master, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if not context.getCheckpointDir():
            context.setCheckpointDir(configured)
        return configured
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="leafmill-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """As ``cut_lineage``; the shuffle files that it took are removed as soon as the copy is written, by Spark versions that can."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        return cut_lineage(df.select("*"))  # a query takes the setting when it is made
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner remove the checkpoints and shuffle files of what is no longer referred to, which else stay until
    the driver happens to collect its garbage; those of the last query stay until the next call."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if ``rows * row_bytes`` is within ``limit``, else unchanged."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def small_side(df: DataFrame, row_bytes: int = 128, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df``, written to the checkpoint folder and counted, with a broadcast hint if it is small: a side of distinct keys
    that rows of any skew are joined with where they lie."""
    held = cut_lineage(df)
    return broadcast_if_small(held, held.count(), row_bytes, limit)
