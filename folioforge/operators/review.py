"""Clusters read back from the records that hold them, what they cover, and what is left.

Everything is in long format: one row per item or expression of a cluster, with its place. Frames are
joined by ARK or id; nothing is nested or collected per cluster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators import entities as E
from folioforge.operators import record as R


def display_title(zones):
    """All of the first 150 zone as text."""
    return R.first_zone_text(zones, "150")


def ark_index(records: DataFrame) -> DataFrame:
    """(ark, id, title) of records by each ARK of their 001 zones; of several records the last row counts."""
    own = F.array_distinct(F.filter(R.values(F.col("zones"), "001", "a"), lambda a: a != ""))
    return records.select("row_idx", "id", "zones", F.explode(own).alias("ark")).groupBy("ark").agg(F.max_by(F.struct("id", R.first(F.col("zones"), "150", "a").alias("title")), "row_idx").alias("r")).select("ark", "r.id", "r.title")


def cluster_items(curated: DataFrame, original: DataFrame) -> DataFrame:
    """(anchor_id, anchor_ark, anchor_row, ord, item_ark, date, item_id, item_title): each link of a work in 90F order.
    The target is looked up among the curated works, then among all original records; it may be unknown."""
    works = E.of_type(curated, E.WORK)
    links = works.select(F.col("id").alias("anchor_id"), F.coalesce("ark", F.lit("")).alias("anchor_ark"), F.col("row_idx").alias("anchor_row"), F.posexplode(E.script_links(F.col("zones"))).alias("ord", "l")).select("anchor_id", "anchor_ark", "anchor_row", "ord", F.col("l.ark").alias("item_ark"), F.col("l.date").alias("date"))
    known = works.filter("ark <> ''").groupBy("ark").agg(F.max_by(F.struct("id", display_title(F.col("zones")).alias("title")), "row_idx").alias("c")).select(F.col("ark").alias("item_ark"), "c")
    other = ark_index(original).select(F.col("ark").alias("item_ark"), F.struct("id", "title").alias("o"))
    out = links.join(known, "item_ark", "left").join(other, "item_ark", "left")
    pick = lambda f: F.when(F.col("c").isNotNull(), F.col(f"c.{f}")).otherwise(F.col(f"o.{f}"))
    return out.select("anchor_id", "anchor_ark", "anchor_row", "ord", "item_ark", "date", pick("id").alias("item_id"), pick("title").alias("item_title"))


def cluster_expressions(curated: DataFrame, items: DataFrame) -> DataFrame:
    """(anchor_id, role, ord, expression_id, expression_ark, work_ark): the anchor work's expressions ('anchor'), the targets of
    their links ('clustered', under their own first work) and the remaining expressions of the item works
    ('independent': with an ARK, not linked already, each once). ord sorts within a role."""
    edges = E.expression_works(curated).select(F.col("row_idx").alias("x_row"), F.col("ord").alias("x_ord"), F.col("id").alias("x_id"), F.col("ark").alias("x_ark"), "work_ark")
    anchors = items.select("anchor_id", "anchor_ark").distinct()
    own = anchors.join(edges, F.col("anchor_ark") == F.col("work_ark"))
    place = lambda *c: F.concat_ws(".", *[F.lpad(x.cast("string"), 12, "0") for x in c])
    anchor = own.select("anchor_id", F.lit("anchor").alias("role"), place(F.col("x_row"), F.col("x_ord")).alias("ord"), F.col("x_id").alias("expression_id"), F.coalesce("x_ark", "x_id").alias("expression_ark"), "work_ark")
    exprs = E.of_type(curated, E.EXPRESSION)
    links = exprs.select(F.col("id").alias("x_id"), F.posexplode(E.script_links(F.col("zones"))).alias("l_ord", "l")).select("x_id", "l_ord", F.col("l.ark").alias("t_ark"))
    target = exprs.filter("ark <> ''").groupBy("ark").agg(F.max_by(F.struct("id", F.try_element_at(E.work_arks(F.col("zones")), F.lit(1)).alias("w")), "row_idx").alias("t")).select(F.col("ark").alias("t_ark"), "t.id", "t.w")
    clustered = own.join(links, "x_id").join(target, "t_ark", "left").select(
        "anchor_id", F.lit("clustered").alias("role"), place(F.col("x_row"), F.col("x_ord"), F.col("l_ord")).alias("ord"), F.coalesce("id", "t_ark").alias("expression_id"), F.col("t_ark").alias("expression_ark"), F.coalesce("w", F.lit("")).alias("work_ark")
    )
    used = clustered.select("anchor_id", F.col("expression_ark").alias("x_ark")).distinct()
    free = items.select("anchor_id", F.col("ord").alias("i_ord"), F.col("item_ark").alias("work_ark")).join(edges.filter("x_ark <> ''"), "work_ark").join(used, ["anchor_id", "x_ark"], "left_anti")
    first = free.groupBy("anchor_id", "x_ark").agg(F.min(F.struct("i_ord", "x_row", "x_ord", "x_id", "work_ark")).alias("f"))
    independent = first.select("anchor_id", F.lit("independent").alias("role"), place(F.col("f.i_ord"), F.col("f.x_row"), F.col("f.x_ord")).alias("ord"), F.col("f.x_id").alias("expression_id"), F.col("x_ark").alias("expression_ark"), F.col("f.work_ark").alias("work_ark"))
    return anchor.unionByName(clustered).unionByName(independent)


def manifestations_of(records: DataFrame, expressions: DataFrame) -> DataFrame:
    """expressions (with expression_ark) with manifestation_id and manifestation_ark, a row per edge."""
    edges = E.manifestation_expressions(records).select(F.col("id").alias("manifestation_id"), F.col("ark").alias("manifestation_ark"), "expression_ark").filter("expression_ark <> ''")
    return expressions.join(edges, "expression_ark")


def coverage(items: DataFrame, expressions: DataFrame, curated: DataFrame) -> DataFrame:
    """(kind, key): what clusters cover: work_id, work_ark, expression_id, expression_ark, manifestation_id, manifestation_ark,
    and manifestation_of (expression ark and manifestation id)."""
    manifs = manifestations_of(curated, expressions.select("expression_ark").distinct())
    parts = [
        items.select(F.lit("work_id").alias("kind"), F.col("anchor_id").alias("key")),
        items.select(F.lit("work_id").alias("kind"), F.col("item_id").alias("key")),
        items.select(F.lit("work_ark").alias("kind"), F.col("anchor_ark").alias("key")),
        items.select(F.lit("work_ark").alias("kind"), F.col("item_ark").alias("key")),
        expressions.select(F.lit("expression_id").alias("kind"), F.col("expression_id").alias("key")),
        expressions.select(F.lit("expression_ark").alias("kind"), F.col("expression_ark").alias("key")),
        manifs.select(F.lit("manifestation_id").alias("kind"), F.col("manifestation_id").alias("key")),
        manifs.select(F.lit("manifestation_ark").alias("kind"), F.col("manifestation_ark").alias("key")),
        manifs.select(F.lit("manifestation_of").alias("kind"), F.concat_ws(" ", "expression_ark", "manifestation_id").alias("key")),
    ]
    return reduce(DataFrame.unionByName, parts).filter("key is not null and key <> ''").distinct()


def is_clustered(records: DataFrame, covered: DataFrame) -> DataFrame:
    """(id, type_norm, clustered) of works, expressions and manifestations: by id or ARK; a manifestation has to be covered under
    every expression it names as well."""
    keys = lambda kind, name: covered.filter(F.col("kind") == kind).select(F.col("key").alias(name), F.lit(True).alias(f"has_{name}"))
    slim = records.select("row_idx", "id", "ark", "type_norm")
    out = []
    for kind, short in ((E.WORK, "work"), (E.EXPRESSION, "expression"), (E.MANIFESTATION, "manifestation")):
        df = E.of_type(slim, kind).join(keys(f"{short}_id", "id"), "id", "left").join(keys(f"{short}_ark", "ark"), "ark", "left")
        hit = F.coalesce("has_id", F.lit(False)) | F.coalesce("has_ark", F.lit(False))
        if kind == E.MANIFESTATION:
            edges = E.manifestation_expressions(records).filter("expression_ark <> ''").select("row_idx", F.concat_ws(" ", "expression_ark", "id").alias("pair"))
            open_ = edges.join(keys("manifestation_of", "pair"), "pair", "left").groupBy("row_idx").agg(F.bool_and(F.coalesce("has_pair", F.lit(False))).alias("all_in"))
            df = df.join(open_, "row_idx", "left")
            hit = hit & F.coalesce("all_in", F.lit(True))
        out.append(df.select("id", "type_norm", hit.alias("clustered")))
    return reduce(DataFrame.unionByName, out)


def work_counts(expressions: DataFrame, curated: DataFrame) -> DataFrame:
    """(anchor_id, work_ark, expressions, manifestations) of each work in a cluster; a clustered expression counts under
    its own first work."""
    per_ark = E.manifestation_expressions(curated).groupBy("expression_ark").agg(F.count(F.lit(1)).alias("m"))
    counted = expressions.filter("work_ark <> ''").join(per_ark, "expression_ark", "left")
    return counted.groupBy("anchor_id", "work_ark").agg(F.count(F.lit(1)).alias("expressions"), F.sum(F.coalesce("m", F.lit(0))).alias("manifestations"))


def unclustered_counts(works: DataFrame, records: DataFrame) -> DataFrame:
    """(id, expressions, manifestations) of each of works by the relations of records, each edge counted."""
    per_ark = E.manifestation_expressions(records).groupBy(F.col("expression_ark").alias("x_ark")).agg(F.count(F.lit(1)).alias("m"))
    edges = E.expression_works(records).select("work_ark", F.col("ark").alias("x_ark")).join(per_ark, "x_ark", "left")
    per_work = edges.groupBy(F.col("work_ark").alias("ark")).agg(F.count(F.lit(1)).alias("x"), F.sum(F.coalesce("m", F.lit(0))).alias("m"))
    return works.join(per_work, "ark", "left").select("id", F.coalesce("x", F.lit(0)).alias("expressions"), F.coalesce("m", F.lit(0)).alias("manifestations"))


#: Zones of general relationships by type.
RELATIONSHIPS = {
    E.WORK: ("500", "501", "506", "509", "50N", "54T", "550", "551", "552", "553", "554", "555", "556", "557", "559", "55A", "55B", "55C", "55E", "55F", "55M", "55P", "55R", "55S", "55Z"),
    E.EXPRESSION: ("501", "506", "509", "50N", "540", "541", "542", "543", "544", "547", "54C", "54P", "54T"),
    E.MANIFESTATION: ("501", "506", "509", "50N", "530", "531", "532", "533", "534", "535", "536", "537", "538", "53M"),
}


def relationship_counts(records: DataFrame, zones_by_type: dict[str, tuple[str, ...]] = RELATIONSHIPS) -> DataFrame:
    """(id, n): the distinct trimmed $3 of the relationship zones of each record's type; 0 for other types."""
    def related(codes: tuple[str, ...]) -> Column:
        mine = F.filter(F.col("zones"), lambda z: z["code"].isin(*codes))
        targets = lambda z: F.filter(F.coalesce(z["sousZones"], F.array()), lambda s: s["code"] == F.concat(z["code"], F.lit("$3")))
        arks = F.flatten(F.transform(mine, lambda z: F.transform(targets(z), lambda s: F.trim(F.coalesce(s["valeur"], F.lit(""))))))
        return F.coalesce(F.size(F.array_distinct(F.filter(arks, lambda a: a != ""))), F.lit(0))

    n = F.lit(0)
    for kind, codes in zones_by_type.items():
        n = F.when(F.col("type_norm") == kind, related(codes)).otherwise(n)
    return records.select("id", n.cast("long").alias("n"))


def merged(curated: DataFrame, original: DataFrame) -> DataFrame:
    """The records of both, curated ones first where both have an id; `source` tells which."""
    both = curated.withColumn("source", F.lit("curated")).unionByName(original.withColumn("source", F.lit("original")))
    keep = both.groupBy("id").agg(F.min("source").alias("source"))
    return both.join(keep, ["id", "source"], "left_semi")


def differences(curated: DataFrame, baseline: DataFrame) -> DataFrame:
    """(id, change) of records whose zones differ from the baseline's, were added or removed."""
    a = curated.select("id", E.serialize(F.col("zones")).alias("a"))
    b = baseline.select("id", E.serialize(F.col("zones")).alias("b"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "id", "full").select("id", change.alias("change")).filter("change is not null")


def key_problems(rows: DataFrame) -> DataFrame:
    """(problem, n): rows whose id stands again, whose ARK another id has, without zones, without type."""
    r = E.index_records(rows)
    again = r.groupBy("id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    shared = r.filter("ark is not null").groupBy("ark").agg(F.count_distinct("id").alias("k")).filter("k > 1")
    parts = {"repeated id": again, "ARK of several ids": shared, "no zones": r.filter("zones is null"), "no type": r.filter("type_norm is null")}
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("problem"), "n") for k, df in parts.items()])


def cluster_of_works(items: DataFrame) -> DataFrame:
    """(kind, key, anchor_id): the first cluster, in order of anchors, that each work is in, by its id and by its ARK."""
    pick = lambda kind, c, place: items.select(F.lit(kind).alias("kind"), F.col(c).alias("key"), "anchor_id", F.struct("anchor_row", F.lit(place).alias("p")).alias("k"))
    every = pick("id", "anchor_id", 0).unionByName(pick("id", "item_id", 1)).unionByName(pick("ark", "anchor_ark", 0)).unionByName(pick("ark", "item_ark", 1))
    return every.filter("key <> ''").groupBy("kind", "key").agg(F.min_by("anchor_id", "k").alias("anchor_id"))


def cluster_of_expressions(items: DataFrame, expressions: DataFrame) -> DataFrame:
    """(kind, key, anchor_id, role): the first cluster that each expression is in, by its id and by its ARK; within a cluster the
    anchor's own expressions come first, then clustered, then independent ones."""
    anchors = items.select("anchor_id", "anchor_row").distinct()
    rank = F.when(F.col("role") == "anchor", 0).when(F.col("role") == "clustered", 1).otherwise(2)
    placed = expressions.join(anchors, "anchor_id").select("anchor_id", "role", "expression_id", "expression_ark", F.struct("anchor_row", rank.alias("r")).alias("k"))
    pick = lambda kind, c: placed.select(F.lit(kind).alias("kind"), F.col(c).alias("key"), F.struct("anchor_id", "role").alias("v"), "k")
    every = pick("id", "expression_id").unionByName(pick("ark", "expression_ark")).filter("key <> ''")
    return every.groupBy("kind", "key").agg(F.min_by("v", "k").alias("v")).select("kind", "key", "v.anchor_id", "v.role")


def equal_where_given(df: DataFrame, **wanted: object) -> DataFrame:
    """The rows that equal what is wanted in each column; None stands for anything."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(f"`{column}`") == value)
    return df


def apply_decisions(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """items with `accepted` by decisions (anchor_id, item_ark, accepted); undecided ones are accepted, a rejected one loses its date."""
    d = decisions.select("anchor_id", "item_ark", F.col("accepted").alias("_a"))
    out = items.join(d, ["anchor_id", "item_ark"], "left").withColumn("accepted", F.coalesce("_a", F.lit(True))).drop("_a")
    return out.withColumn("date", F.when(F.col("accepted"), F.col("date")))


def apply_to_expressions(expressions: DataFrame, items: DataFrame) -> DataFrame:
    """The clustered expressions with `accepted`: those of a rejected item's work are rejected with it."""
    rejected = items.filter("not accepted").select("anchor_id", F.col("item_ark").alias("work_ark"), F.lit(False).alias("_a")).distinct()
    return expressions.filter("role = 'clustered'").join(rejected, ["anchor_id", "work_ark"], "left").withColumn("accepted", F.coalesce("_a", F.lit(True))).drop("_a")


def primary_expressions(expressions: DataFrame) -> DataFrame:
    """(anchor_id, work_ark, expression_id): the first expression of each work in a cluster: the anchor's own first, then
    clustered, then independent ones."""
    rank = F.when(F.col("role") == "anchor", 0).when(F.col("role") == "clustered", 1).otherwise(2)
    order = Window.partitionBy("anchor_id", "work_ark").orderBy(rank, "ord", "expression_id")
    return expressions.filter("work_ark <> ''").withColumn("n", F.row_number().over(order)).filter("n = 1").select("anchor_id", "work_ark", "expression_id")
