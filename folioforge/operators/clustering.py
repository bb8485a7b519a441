"""Clustering of works and of their expressions.

Works of one group key and one normalised title form a cluster. All its state is the group: one
shuffle on (c015, c700, title_key), no pairs. The anchor is the member without an illustration suffix
with the smallest id as text; members keep row order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators import entities as E
from folioforge.operators.record import ZONES
from folioforge.session import materialize

KEYS = ["c015", "c700", "title_key"]


def work_anchors(works: DataFrame) -> DataFrame:
    """(c015, c700, title_key, anchor_id, anchor_ark, n, first_row, key_row) of each group of two works and more. key_row is
    the first row of the works of (c015, c700): clusters come in order of (key_row, first_row). Works without key or
    title are in none. One aggregation of the works; the second one only sees groups."""
    able = works.filter("c015 is not null and c700 is not null and title_key <> ''")
    best = F.min_by(F.struct("id", "ark"), F.struct("suffix", "id", "row_idx"))
    groups = able.groupBy(*KEYS).agg(best.alias("a"), F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first_row"))
    # A join, not a window: the groups of a prolific author must not meet in one task.
    groups = materialize(groups, "groups")
    keys = groups.groupBy("c015", "c700").agg(F.min("first_row").alias("key_row"))
    return groups.filter("n > 1").join(keys, ["c015", "c700"]).select(*KEYS, F.col("a.id").alias("anchor_id"), F.col("a.ark").alias("anchor_ark"), "n", "first_row", "key_row")


def work_groups(works: DataFrame) -> DataFrame:
    """(c015, c700, title_key, n, first_row, key_row) of groups of two works and more."""
    return work_anchors(works).drop("anchor_id", "anchor_ark")


def cluster_members(works: DataFrame) -> DataFrame:
    """(anchor_id, anchor_ark, member_id, member_ark, member_row, key_row, first_row): one row per clustered work other
    than its anchor; a missing ark of a member is ''. Groups of any size stay spread over their rows."""
    works = materialize(works, "works")  # narrow rows, read for the groups and for their members
    joined = works.join(work_anchors(works), KEYS).filter("id <> anchor_id")
    return joined.select("anchor_id", "anchor_ark", F.col("id").alias("member_id"), F.coalesce("ark", F.lit("")).alias("member_ark"), F.col("row_idx").alias("member_row"), "key_row", "first_row")


def linked_works(records: DataFrame, date: str) -> DataFrame:
    """(id, zones): the anchors with a 90F zone for each other member, in row order, after their own zones."""
    links = cluster_members(E.work_rows(records)).groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("member_row", "member_ark"))).alias("m"))
    anchors = E.of_type(records, E.WORK).join(links, F.col("id") == F.col("anchor_id"))
    return anchors.select("id", E.append_zones(F.col("zones"), F.transform("m", lambda m: E.link_zone(m["member_ark"], date))).cast(ZONES).alias("zones"))


def expression_pairs(records: DataFrame) -> DataFrame:
    """Expressions that may be linked: those of a cluster's anchor work with those of its other works whose
    signatures share a pair of 051$a and 041$a. The shared pair is the join key, so no pair of expressions is
    tried that doesn't share one."""
    members = cluster_members(E.work_rows(records))
    one, two = E.signature(F.col("zones"))
    signed = E.of_type(records, E.EXPRESSION).select("id", F.explode(one).alias("s051"), F.col("zones")).select("id", "s051", F.explode(two).alias("s041"))
    members = materialize(members, "members")
    owned = E.expression_works(records).withColumnRenamed("row_idx", "expr_row")
    anchor_side = (
        members.select("anchor_id", "anchor_ark", "key_row", "first_row").distinct().join(owned.withColumnRenamed("work_ark", "anchor_ark"), "anchor_ark").select("anchor_id", "key_row", "first_row", F.col("id").alias("a_id"), F.col("ark").alias("a_ark"), F.struct("expr_row", "ord").alias("a_ord"))
    )
    member_side = members.select("anchor_id", "member_ark", "member_row").filter("member_ark <> ''").join(owned.withColumnRenamed("work_ark", "member_ark"), "member_ark").select(
        F.col("anchor_id").alias("m_anchor"), "member_row", F.col("id").alias("c_id"), F.col("ark").alias("c_ark"), F.struct("expr_row", "ord").alias("c_ord")
    )
    a = anchor_side.join(signed.select(F.col("id").alias("a_id"), "s051", "s041"), "a_id")
    c = member_side.join(signed.select(F.col("id").alias("c_id"), F.col("s051").alias("c051"), F.col("s041").alias("c041")), "c_id")
    joined = a.join(c, (F.col("anchor_id") == F.col("m_anchor")) & (F.col("s051") == F.col("c051")) & (F.col("s041") == F.col("c041")) & (F.col("a_id") != F.col("c_id")))
    return joined.groupBy("anchor_id", "key_row", "first_row", "member_row", "a_id", "a_ark", "a_ord", "c_id", "c_ark", "c_ord").agg(F.count(F.lit(1)).alias("shared"))


def cluster_expressions(records: DataFrame) -> DataFrame:
    """(anchor_work_id, anchor_expression_id, expression_id, expression_ark): each candidate goes to the first
    anchor expression in order of cluster, member work, anchor expression, candidate. Candidates without an ARK, or
    already linked from that anchor expression, are left out.

    Where every candidate has its own ARK, the loop is a window over the candidate. Candidates that share an ARK
    fall through to a later anchor expression when the first has taken it: those few go through the loop itself,
    grouped by ARK.
    """
    linked = E.of_type(records, E.EXPRESSION).select(F.col("id").alias("a_id"), F.explode(F.transform(E.script_links(F.col("zones"), exact=False), lambda x: x["ark"])).alias("c_ark")).distinct()
    able = expression_pairs(records).filter("c_ark is not null and c_ark <> ''").join(linked, ["a_id", "c_ark"], "left_anti")
    able = able.select("c_ark", "c_id", "anchor_id", "a_id", "key_row", "first_row", "member_row", F.col("a_ord.expr_row").alias("a_row"), F.col("a_ord.ord").alias("a_n"), F.col("c_ord.expr_row").alias("c_row"), F.col("c_ord.ord").alias("c_n"))
    able = materialize(able, "pairs")
    shared = able.groupBy("c_ark").agg(F.count_distinct("c_id").alias("k")).filter("k > 1").select("c_ark")
    order = Window.partitionBy("c_id").orderBy(*ORDER)
    plain = able.join(shared, "c_ark", "left_anti").withColumn("n", F.row_number().over(order)).filter("n = 1").select("c_ark", "c_id", "anchor_id", "a_id")
    looped = able.join(shared, "c_ark", "left_semi").groupBy("c_ark").applyInPandas(_assign_in_turn, "c_ark string, c_id string, anchor_id string, a_id string")
    return plain.unionByName(looped).select(F.col("anchor_id").alias("anchor_work_id"), F.col("a_id").alias("anchor_expression_id"), F.col("c_id").alias("expression_id"), F.col("c_ark").alias("expression_ark"))


ORDER = ["key_row", "first_row", "member_row", "a_row", "a_n", "a_id", "c_row", "c_n", "c_id"]


def _assign_in_turn(pairs: pd.DataFrame) -> pd.DataFrame:
    """Candidates of one ARK in turn: each to the first anchor expression that doesn't have the ARK yet."""
    taken, placed, rows = set(), set(), []
    for r in pairs.sort_values(ORDER).itertuples():
        if r.a_id not in taken and r.c_id not in placed:
            taken.add(r.a_id)
            placed.add(r.c_id)
            rows.append((r.c_ark, r.c_id, r.anchor_id, r.a_id))
    return pd.DataFrame(rows, columns=["c_ark", "c_id", "anchor_id", "a_id"])
