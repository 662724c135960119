"""A session with the settings the plans are written for; any other session works too."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution joins small partitions, splits skewed ones and picks joins by measured sizes.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "lectern", master: str | None = None, checkpoint_dir: str | None = None, **settings: str) -> SparkSession:
    """``checkpoint_dir`` must be a folder that all executors share."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | settings)
    if master:
        builder = builder.master(master)
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder.getOrCreate()
