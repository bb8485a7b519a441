"""The neighbourhood of a set of works: expressions, manifestations and whatever their records mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hop(ids: DataFrame, edges: DataFrame, code: str) -> DataFrame:
    """Distinct ids with a relation of this code to one of ids (column id BIGINT). A semi join: the edges' side is
    filtered, never multiplied."""
    hit = edges.filter(F.col("codesouszone") == code).join(ids.select(F.col("id").alias("id_entitelrm_destination")), "id_entitelrm_destination", "left_semi")
    return hit.select(F.col("id_entitelrm_source").alias("id")).filter("id is not null").distinct()


def base_ids(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """The works, the expressions that refer to them by 750$3 and the manifestations that refer to those by 740$3."""
    one = hop(ids, edges, "750$3")
    return ids.unionByName(one).unionByName(hop(one, edges, "740$3")).distinct()


def rows_of(ids: DataFrame, entities: DataFrame, limit: int | None = None) -> DataFrame:
    """The entity rows of ids; limit is an aid for looking at a few."""
    out = entities.join(ids.select(F.col("id").cast("string").alias("id_entitelrm")), "id_entitelrm", "left_semi")
    return out.limit(limit) if limit is not None else out


def ark_mentions(text: Column) -> Column:
    """The parts after `cb` of all ARKs of the catalogue that a text mentions, in order, with repetitions."""
    return F.regexp_extract_all(text, F.lit(r"(?i)ark:/12148/cb([0-9a-z]+)"), F.lit(1))


def mentioned_ids(rows: DataFrame) -> DataFrame:
    """Distinct ids (BIGINT) that the records of rows mention: the last character, a check sign, is dropped; what isn't
    a number then is no id."""
    part = rows.select(F.explode(ark_mentions(F.col("intermarc"))).alias("x")).distinct()
    return part.select(F.expr("try_cast(substring(x, 1, length(x) - 1) AS BIGINT)").alias("id")).filter("id is not null").distinct()


def neighbourhood(ids: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """The entity rows of the base ids and of what their records mention, by id."""
    base = base_ids(ids, edges)
    every = base.unionByName(mentioned_ids(rows_of(base, entities))).distinct()
    return rows_of(every, entities)


def stage_counts(ids: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(stage, n) of each step of the extraction."""
    one = hop(ids, edges, "750$3")
    two = hop(one, edges, "740$3")
    base = base_ids(ids, edges)
    stages = {"ids": ids, "hop_750": one, "hop_740": two, "base_ids": base, "base_rows": rows_of(base, entities), "mentioned": mentioned_ids(rows_of(base, entities))}
    out = None
    for name, df in stages.items():
        one_row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        out = one_row if out is None else out.unionByName(one_row)
    return out
