"""Session settings the operators rely on, and reliable lineage cuts."""
from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(cores: str = "*", **extra) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no Python stack per expression
        .config("spark.driver.memory", "8g")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's shared checkpoint folder, so that every later reader sees
    the same rows even when executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share. Only a local session, where there is one machine,
    may do without; a cluster without one is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def with_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row table (a global aggregate) to every row."""
    return df.join(F.broadcast(one_row), F.lit(True), "inner")
