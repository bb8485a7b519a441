"""Rows that keep arriving: the variant store and the table of latest records follow a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.operators.authority import upsert_variants


def latest_records(rows: DataFrame) -> DataFrame:
    """Streaming aggregation: of each id the row with the latest loaded_at (then the largest row_idx). Use with outputMode('update')."""
    last = F.max_by(F.struct("row_idx", "type_entite", "intermarc", "loaded_at"), F.struct("loaded_at", "row_idx"))
    return rows.groupBy("id_entitelrm").agg(last.alias("r")).select("id_entitelrm", "r.*")


def monthly_arrivals(rows: DataFrame, late: str = "30 days") -> DataFrame:
    """Rows per 30-day window and type, with a watermark for late rows."""
    return rows.withWatermark("loaded_at", late).groupBy(F.window("loaded_at", "30 days"), "type_entite").agg(F.count(F.lit(1)).alias("n"))


def follow_variants(stream: DataFrame, store_path: str, checkpoint: str) -> StreamingQuery:
    """Add each batch of variants (ark, variant, ord) to the store. The store is written beside the old one under the batch's
    number and read from the latest, so a batch that is run again after a failure changes nothing."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = f"{store_path}/{number - 1}"
        empty = batch.select("ark", "variant", "ord").limit(0)
        store = spark.read.parquet(old) if number else empty
        upsert_variants(store, batch).write.mode("overwrite").parquet(f"{store_path}/{number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
