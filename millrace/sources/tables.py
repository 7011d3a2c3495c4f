"""Table scans and record output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A lazy table scan; filters and column lists reach the files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_rows(df: DataFrame, name: str = "body") -> DataFrame:
    """One JSON document a row; null fields are left out."""
    return df.select(F.to_json(F.struct("*")).alias(name))


def long_features(df: DataFrame, row_id: str, vector: str, *others: str) -> DataFrame:
    """(row_id, pos, value double, others): the long form of a feature matrix."""
    return df.select(row_id, F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "value"), *others)
