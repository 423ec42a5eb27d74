"""Parquet tables of a folder as DataFrames, and their projection to records ``(id, content)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_records(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """Any table with a key and a text as records; null texts become empty, null keys are left out."""
    return df.select(
        F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(content_col), F.lit("")).alias("content")
    ).where(F.col("id").isNotNull())
