"""SparkSession helpers.

On a cluster the session is created by the platform; ``configure`` only fills
settings that are still unset, so cluster-wide values always win. The session
time zone is never touched.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

# Settings every report relies on. AQE re-plans joins and coalesces shuffle
# partitions at runtime; skew-join splits a hot join key across tasks.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply DEFAULTS where the session has no value yet."""
    conf = spark.conf
    for key, value in DEFAULTS.items():
        if conf.get(key, None) is None:
            conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share (``spark.checkpoint.dir``); in a local session that names none, the warehouse."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return named or spark.conf.get("spark.sql.warehouse.dir")


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "dunning", master: str | None = None) -> SparkSession:
    """A local session for tests and the bench (UI off, no extra ports)."""
    spark = (
        SparkSession.builder.master(master or f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
