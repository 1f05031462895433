"""Reliable lineage cuts for the few plans that need a fixed intermediate result."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; only a local[...] session may fall back to a temp folder."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known:
        return known
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="seriesloom-")
    sc.setCheckpointDir(configured)
    return configured


#: Removes a query's shuffle files when it is over, not when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder, so that a lost executor never changes its rows.

    The shuffle files that led to it go at once. A frame heeds the setting under which it was made, so ``df`` is made anew:
    what else reads ``df`` keeps its own.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.set(CLEAN_UP, before)
