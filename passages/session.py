"""Session settings for local runs; a cluster's own settings win where they are set."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .schema import EngineError


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution and UTC timestamps."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under spark.checkpoint.dir, or in local mode a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise EngineError(401, "set a path or spark.checkpoint.dir that the driver and all executors share")
    return tempfile.mkdtemp(prefix=f"passages-{name}-")


def spread(rows: DataFrame) -> DataFrame:
    """rows in as many partitions as there are cores, if a table of few splits has fewer; large tables stay as they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    splits = rows._jdf.queryExecution().toRdd().getNumPartitions()
    return rows.repartition(cores) if splits < cores else rows
