"""Ranks in a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import materialize


def collated(text: Column) -> Column:
    """Text in French dictionary order: accents tell apart, case doesn't."""
    return F.collate(F.lower(text), "fr")


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with the place of each row, from 1, in an order that should be total; rows that tie take any order among themselves.

    The sort spreads ranges over partitions; a row's place is its place in its partition after the rows of those before it.
    Only one number per partition is brought together. A column of df called like the new one is an error.
    """
    if name in df.columns:
        raise ValueError(f"{name} is a column already")
    placed = materialize(df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ranked")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias(name))
