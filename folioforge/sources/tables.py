"""Tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table in `folder/name.parquet`, a file or a folder of files."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
