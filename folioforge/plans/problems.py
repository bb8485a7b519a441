"""Queries of the general problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.operators.flatten import flatten_subfields
from folioforge.operators.orphans import catalogue_references, find_orphans
from folioforge.operators.parse_errors import reject_rows
from folioforge.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return reject_rows(table(spark, folder, "raw_entity_line")).select("line_id")


def p1_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return reject_rows(table(spark, folder, "raw_entity_line"))


def _orphans(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return find_orphans(*catalogue_references(*(table(spark, folder, t) for t in ("test_honorific", "authority_core", "entitelrm_entitelrm", "detection_record"))))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder)[0].select("src_table", "src_row", "ref", "period")


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder)[1]


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return flatten_subfields(table(spark, folder, "test_honorific"), ["row_idx"]).select("row_idx", "zone_pos", "sub_pos")


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p3_found, p3_report, p6_found)}
