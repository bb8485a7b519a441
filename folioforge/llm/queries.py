"""Queries of the problems of this package, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.components import connected_components
from folioforge.llm.confusables import same_look
from folioforge.llm.fusion import best_members, fused_records
from folioforge.llm.leakage import find_leaks
from folioforge.llm.names import link_names, merged, pairs_of
from folioforge.llm.packing import pack, token_counts
from folioforge.llm.sentences import sentences
from folioforge.llm.sql import ORACLE  # noqa: F401
from folioforge.operators.record import CLUSTER_NOTE, ark, clean_ark, first, parse_zones, zone_values, zones_of
from folioforge.session import materialize
from folioforge.sources.tables import table


def _mentions(*words: str) -> str:
    """SQL condition: the record's text may hold one of the words, plainly or with JSON escapes of ASCII."""
    plain = " or ".join(f"contains(intermarc, '{w}')" for w in words)
    return rf"({plain} or intermarc rlike r'\\u00[2-7]')"


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    detections = table(spark, folder, "detection_record").filter("title is not null and id_entitelrm is not null").select("detection_id", "id_entitelrm", "title")
    records = table(spark, folder, "test_honorific").filter(_mentions("150$a"))
    titles = records.select("id_entitelrm", first(parse_zones(F.col("intermarc")), "150", "a").alias("own")).filter("own <> ''")
    pairs = detections.join(titles, "id_entitelrm").filter("title <> own").select("detection_id", "title", "own").distinct()
    return same_look(pairs, "title", "own").select("detection_id").distinct()


def catalogue_names(spark: SparkSession, folder: str) -> DataFrame:
    """The names of the ARKs of the name store: its variants and the headings 100/400/110/410 of their records."""
    store = table(spark, folder, "nes_variant").select(clean_ark(F.col("ark")).alias("key"), F.col("variant").alias("text")).filter("key is not null").distinct()
    records = table(spark, folder, "test_honorific").filter(_mentions("100$", "110$", "400$", "410$")).select("intermarc").unionByName(table(spark, folder, "authority_core").select("intermarc"))
    zones = records.select(parse_zones(F.col("intermarc")).alias("zones"))
    heads = F.filter(F.col("zones"), lambda z: z["code"].isin("100", "400", "110", "410"))
    part = lambda z, s: F.try_element_at(zone_values(z, F.concat(z["code"], F.lit(s))), F.lit(1))
    rows = zones.select(clean_ark(ark(F.col("zones"))).alias("key"), F.explode(F.transform(heads, lambda z: F.struct(
        F.concat_ws(" ", part(z, "$a"), part(z, "$m")).alias("text"), F.when(z["code"].isin("100", "400"), "person").otherwise("body").alias("kind"), part(z, "$d").alias("years"), z["code"].isin("100", "110").alias("head")
    ))).alias("n")).select("key", "n.*")
    rows = materialize(rows, "headings")
    own = merged(rows, store.select("key").distinct(), "key", "left_semi")
    bodies = own.select("key", "kind").distinct()
    known = merged(store, bodies, "key", "left").select("key", "text", "kind", F.lit(None).cast("string").alias("years"), F.lit(False).alias("head"))
    return own.unionByName(known)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    links, groups = link_names(catalogue_names(spark, folder))
    return pairs_of(groups, links).select(F.col("a").alias("ark_a"), F.col("b").alias("ark_b"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The group of each ARK that stands for an entity with several ARKs, and how many links it has."""
    links, groups = link_names(catalogue_names(spark, folder))
    each = links.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    return merged(groups, each, "key").select(F.col("key").alias("ark"), F.col("root").alias("group_ark"), "sure", "n_links")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    best = best_members(table(spark, folder, "cluster_result"), table(spark, folder, "test_honorific"), table(spark, folder, "provenance_level"))
    return best.filter("dominant").select("cluster_id", "best_id")


def p5_representatives(spark: SparkSession, folder: str) -> DataFrame:
    best = best_members(table(spark, folder, "cluster_result"), table(spark, folder, "test_honorific"), table(spark, folder, "provenance_level"))
    return best.select("cluster_id", "best_id", F.round("support", 6).alias("support"), "dominant", "n_members")


def p5_fused(spark: SparkSession, folder: str) -> DataFrame:
    fused = fused_records(table(spark, folder, "cluster_result"), table(spark, folder, "test_honorific"), table(spark, folder, "provenance_level"))
    return fused.select("cluster_id", "field", "value", F.round("posterior", 6).alias("posterior"), "n_values")


def match_links(spark: SparkSession, folder: str) -> DataFrame:
    """The links between ARKs (a, b) of cluster results and of script-made 90F zones."""
    results = table(spark, folder, "cluster_result").select(clean_ark(F.col("anchor_ark")).alias("a"), F.explode("clustered_arks").alias("b")).select("a", clean_ark(F.col("b")).alias("b"))
    bare = lambda v: F.lower(F.btrim(v, F.lit(" \t")))
    script = F.filter(zones_of(F.col("zones"), "90F"), lambda z: F.exists(zone_values(z, "90F$q"), lambda v: F.coalesce(bare(v) == CLUSTER_NOTE.lower(), F.lit(False))))
    targets = F.flatten(F.transform(script, lambda z: zone_values(z, "90F$a")))
    records = table(spark, folder, "test_honorific").filter(_mentions("90F")).select(parse_zones(F.col("intermarc")).alias("zones"))
    zones = records.select(clean_ark(ark(F.col("zones"))).alias("a"), F.explode(targets).alias("b")).select("a", clean_ark(F.col("b")).alias("b"))
    return results.unionByName(zones)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return connected_components(match_links(spark, folder)).select(F.col("node").alias("ark"), F.col("root").alias("group_ark"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences(table(spark, folder, "documents").select("doc_id", "text"))


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(token_counts(table(spark, folder, "documents")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item")).select("doc_id", "item_id")


QUERIES = {f.__name__: f for f in (p2_found, p4_found, p4_groups, p5_found, p5_representatives, p5_fused, p7_found, p8_packing, p9_found, p10_found)}
