"""Reading the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder; columns are pruned and filters
    pushed down by what is selected from it."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
