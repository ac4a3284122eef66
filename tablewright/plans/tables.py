"""Reading the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, table_name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table_name}.parquet")
