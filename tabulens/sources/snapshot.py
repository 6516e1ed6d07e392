"""Parquet snapshots of the active dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
