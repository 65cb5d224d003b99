"""Session and small plan helpers shared by every module."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(cores: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("korrel")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data directory, a Parquet file or a directory of them."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a temporary one only where that is unset and the
    master is local, as in tests."""
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + os.path.join(tempfile.gettempdir(), "korrel-checkpoints")
    spark.sparkContext.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder: computed once, lineage cut, survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder, for tables that a query writes and reads again. It is deleted when
    the driver ends, as the frame that reads it may be used until then."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    try:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    except Exception:  # the session is gone already, or another attempt deleted the folder
        pass


def release(spark: SparkSession) -> None:
    """Shuffle files of frames that nothing refers to any more are freed; else they stay until the driver happens to
    collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Broadcast hint only after counting: beyond max_rows the frame is returned without a hint and the planner
    chooses a shuffle join."""
    rows = df.select(F.lit(1)).limit(max_rows + 1).count()
    return F.broadcast(df) if rows <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a small input has fewer partitions than there are cores and much is computed on each
    row; an input of many files is left as it is, so nothing is shuffled at scale."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
