"""Writers: panels and features by split, reports, and small settings files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def write_frame(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    """Columnar table, partitioned where asked; the train/val/test outputs are ``partition_by=("split",)``."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return path


def read_frame(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(df: DataFrame, path: str, form: str = "csv") -> str:
    """A scorecard: a few rows, so one file."""
    w = df.coalesce(1).write.mode("overwrite")
    w.option("header", True).csv(path) if form == "csv" else w.parquet(path)
    return path


def bucketed(df: DataFrame, table: str, key: str, buckets: int, order: str) -> None:
    """A panel stored by series, so that later windows and joins on the key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key, order).saveAsTable(table)


def write_settings(spark: SparkSession, path: str, content: dict) -> None:
    """Settings as one JSON row."""
    spark.createDataFrame([(json.dumps(content, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_settings(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])
