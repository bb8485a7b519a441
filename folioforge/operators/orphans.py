"""References to records that don't exist, that were deleted, or that came later.

Method: skew-aware split. References are pre-aggregated per key and period; pairs so frequent that
a shuffle would pile them up in one task are checked against the records by broadcast, the rest by a
shuffle join; the two results are united.

A pair is heavy if it holds more than 1/heavy_share of all references, so there are never more than
heavy_share of them, whatever the data: that bounds what is broadcast. All other pairs hold fewer rows
than that share, which bounds the rows that meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.record import ark, clean_ark, parse_zones
from folioforge.session import materialize

#: The zones whose $3 points to another record.
REFERENCE_ZONES = ("140", "150", "700", "701", "702", "710", "711", "712", "740", "750")
MONTH = "yyyy-MM"


def records_by_key(rows: DataFrame) -> DataFrame:
    """What is known of each record under each of its keys: kind ('ark' or 'id'), key, first_period,
    deleted. `rows` has id, ark, loaded_at and deleted; rows of one id belong to one record, rows
    without an id to the record of their ARK. Times that are null count for nothing."""
    owner = F.coalesce(F.concat(F.lit("i"), "id"), F.concat(F.lit("a"), "ark"))
    one = (
        rows.withColumn("_owner", owner)
        .filter("_owner is not null")
        .groupBy("_owner")
        .agg(F.min("loaded_at").alias("first"), F.max("deleted").alias("deleted"), F.collect_set("ark").alias("arks"), F.max("id").alias("id"))
    )
    keys = F.concat(
        F.transform("arks", lambda a: F.struct(F.lit("ark").alias("kind"), a.alias("key"))),
        F.when(F.col("id").isNotNull(), F.array(F.struct(F.lit("id").alias("kind"), F.col("id").alias("key")))).otherwise(F.array()),
    )
    return (
        one.select(F.explode(keys).alias("k"), "first", "deleted")
        .groupBy("k.kind", "k.key")
        .agg(F.date_format(F.min("first"), MONTH).alias("first_period"), F.max("deleted").alias("deleted"))
    )


def _orphan_pairs(pairs: DataFrame, records: DataFrame) -> DataFrame:
    late = F.coalesce(F.col("first_period") > F.col("period"), F.lit(False))
    reason = F.when(F.col("deleted").isNull(), "missing").when(F.col("deleted"), "deleted").when(late, "later")
    return pairs.join(records, ["kind", "key"], "left").select("kind", "key", "period", reason.alias("reason")).filter("reason is not null")


def find_orphans(refs: DataFrame, records: DataFrame, heavy_share: int = 512) -> tuple[DataFrame, DataFrame]:
    """(cases, report): cases has src_table, src_row, ref, period and reason of each reference to no
    record; report counts them by table, period and reason.

    refs: src_table, src_row, kind, key, period; records: see records_by_key. The reason is missing,
    deleted or later (the record's first row came in a later period). A null key is no reference; a
    null period can't be compared and only counts as missing or deleted. References that stand twice
    are reported once.
    """
    refs = materialize(refs.filter("key is not null").select("src_table", "src_row", "kind", "key", "period"), "refs")
    records = materialize(records.select("kind", "key", "first_period", "deleted"), "records")
    pairs = materialize(refs.groupBy("kind", "key", "period").agg(F.count(F.lit(1)).alias("n")), "pairs")
    total = pairs.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") > max(total / heavy_share, 1000)
    few, many = pairs.filter(heavy), pairs.filter(~heavy)
    # Of the records, those of the heavy pairs are no more than the pairs themselves: both sides are small.
    hot = records.join(F.broadcast(few.select("kind", "key").distinct()), ["kind", "key"], "left_semi")
    bad_few = _orphan_pairs(few, F.broadcast(hot))
    bad_many = _orphan_pairs(many, records)

    def rows(bad: DataFrame, hot_side: bool) -> DataFrame:
        b = bad.select(*(F.col(c).alias(f"_{c}") for c in ("kind", "key", "period")), "reason")
        on = (F.col("kind") == F.col("_kind")) & (F.col("key") == F.col("_key")) & F.col("period").eqNullSafe(F.col("_period"))
        return refs.join(F.broadcast(b) if hot_side else b, on).select("src_table", "src_row", F.col("key").alias("ref"), "period", "reason")

    cases = rows(bad_few, True).unionByName(rows(bad_many, False)).dropDuplicates(["src_table", "src_row", "ref", "period"])
    report = cases.groupBy("src_table", "period", "reason").agg(F.count(F.lit(1)).alias("n"))
    return cases, report


def catalogue_references(entities: DataFrame, authorities: DataFrame, edges: DataFrame, detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(refs, records) of the catalogue's tables, ready for find_orphans: `$3` subfields of entity
    records by ARK, relations and detections by id. The entity table is parsed once."""
    zones = parse_zones(F.col("intermarc"))
    wanted = F.filter(F.col("zones"), lambda z: z["code"].isin(*REFERENCE_ZONES))
    found = F.flatten(F.transform(wanted, lambda z: F.transform(F.filter(F.coalesce(z["sousZones"], F.array()), lambda s: s["code"] == F.concat(z["code"], F.lit("$3"))), lambda s: clean_ark(s["valeur"]))))
    parsed = entities.select("row_idx", "id_entitelrm", "loaded_at", F.col("deleted_at").isNotNull().alias("deleted"), zones.alias("zones"))
    slim = materialize(
        parsed.select("row_idx", F.col("id_entitelrm").alias("id"), clean_ark(ark(F.col("zones"))).alias("ark"), "loaded_at", "deleted", F.array_distinct(F.array_compact(found)).alias("refs")),
        "entities",
    )
    month = lambda c: F.date_format(c, MONTH)
    refs = (
        slim.select(F.lit("test_honorific").alias("src_table"), F.col("row_idx").alias("src_row"), F.lit("ark").alias("kind"), F.explode("refs").alias("key"), month("loaded_at").alias("period"))
        .unionByName(
            edges.select(
                F.lit("entitelrm_entitelrm").alias("src_table"), F.col("edge_id").alias("src_row"), F.lit("id").alias("kind"),
                F.explode(F.array_distinct(F.array(F.col("id_entitelrm_source").cast("string"), F.col("id_entitelrm_destination").cast("string")))).alias("key"), month("loaded_at").alias("period"),
            )
        )
        .unionByName(detections.select(F.lit("detection_record").alias("src_table"), F.col("detection_id").alias("src_row"), F.lit("id").alias("kind"), F.col("id_entitelrm").alias("key"), month("detected_at").alias("period")))
    )
    core = authorities.select(F.col("id_entitelrm").alias("id"), clean_ark(ark(parse_zones(F.col("intermarc")))).alias("ark"), "loaded_at", F.lit(False).alias("deleted"))
    return refs, records_by_key(slim.select("id", "ark", "loaded_at", "deleted").unionByName(core))
