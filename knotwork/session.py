"""Session settings and the shared folder where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the operators are tuned for; on a cluster, leave `master` to spark-submit."""
    b = (
        SparkSession.builder.appName("knotwork")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master).config("spark.driver.host", "127.0.0.1").config("spark.ui.enabled", "false")
        b = b.config("spark.driver.memory", os.environ.get("KNOTWORK_DRIVER_MEMORY", "8g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Only where none is set, as in local tests, one is made."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="knotwork-")
        sc.setCheckpointDir(named)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and read back from the shared folder: it survives the loss of executors and has no lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """`df` computed once, as by `cut`, but written by columns and compressed: rows with texts take a fraction of the disk.

    The files go when the application ends. The shuffle files that led to it are let go at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    at = f"{ensure_checkpoint_dir(spark)}/kept-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    schema = df.schema
    del df
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(at)
