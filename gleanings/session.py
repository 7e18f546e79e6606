"""Session settings that every job of this library expects."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gleanings")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GLEANINGS_DRIVER_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the given tables: a Parquet file, or a folder of them, named after the table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that the session names (spark.checkpoint.dir, or SparkContext.setCheckpointDir).

    In local mode, where driver and executors are one process, a session that names no folder gets a temporary one; on a cluster that is an error.
    The files stay until the folder is cleared.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share: intermediate tables are written there")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-checkpoint-')}")
        folder = spark.sparkContext.getCheckpointDir()
    return f"{folder}/gleanings-{uuid.uuid4().hex}"


def written(df: DataFrame, rows_a_file: int = 0, by: list[str] | None = None) -> DataFrame:
    """df as Parquet at a scratch() path, read back: its lineage is cut, and a lost executor costs no recomputation. rows_a_file: at most, 0 for any number. by: columns of which each value has a folder."""
    path = scratch(df.sparkSession)
    (df.write.partitionBy(*by) if by else df.write).option("maxRecordsPerFile", rows_a_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
