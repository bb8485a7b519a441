"""Entity rows as a dataset: parsed, typed, in delivery order; accessors of works, expressions, manifestations.

Row order is part of the semantics (which cluster or member comes first), so every frame carries
row_idx. Ids are meant to be unique; where a record stands several times the last row counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import has_suffix, normalize_title
from folioforge.operators import record as R

WORK, EXPRESSION, MANIFESTATION = "oeuvre", "expression", "manifestation"


def last_rows(rows: DataFrame, slim: DataFrame | None = None) -> DataFrame:
    """Of each id the row with the largest row_idx. What is joined on row_idx is shuffled as it is: where only parts of the records
    are needed, give them as slim (row_idx and more, of the same rows)."""
    keep = rows.groupBy("id_entitelrm").agg(F.max("row_idx").alias("row_idx")).select("row_idx")
    return (rows if slim is None else slim).join(keep, "row_idx", "left_semi")


def first_rows(rows: DataFrame, slim: DataFrame | None = None) -> DataFrame:
    keep = rows.groupBy("id_entitelrm").agg(F.min("row_idx").alias("row_idx")).select("row_idx")
    return (rows if slim is None else slim).join(keep, "row_idx", "left_semi")


def index_records(rows: DataFrame, codes: tuple[str, ...] | None = None) -> DataFrame:
    """row_idx, id, type_norm, ark (first 001$a), zones (of these codes, if any are given). Null or broken records have null zones and
    ark."""
    every = _index(rows)
    if codes is None:
        return every
    return every.withColumn("zones", F.filter("zones", lambda z: z["code"].isin(*codes)) if codes else F.when(F.col("zones").isNotNull(), F.array().cast(R.ZONES)))


def _index(rows: DataFrame) -> DataFrame:
    return (
        rows.withColumn("zones", R.parse_zones(F.col("intermarc")))
        .select("row_idx", F.col("id_entitelrm").alias("id"), R.normalize_type(F.col("type_entite")).alias("type_norm"), "zones")
        .select("row_idx", "id", "type_norm", R.ark(F.col("zones")).alias("ark"), "zones")
    )


def of_type(records: DataFrame, kind: str) -> DataFrame:
    return records.filter(F.col("type_norm") == kind)


def group_key(zones: Column) -> Column:
    """(c015, c700): first 015$c and first 700$3; null if either is missing or empty."""
    a, b = R.first(zones, "015", "c"), R.first(zones, "700", "3")
    return F.when((a != "") & (b != ""), F.struct(a.alias("c015"), b.alias("c700")))


def work_rows(records: DataFrame) -> DataFrame:
    """Works with what clustering needs: row_idx, id, ark, c015, c700, title, title_key, suffix."""
    z = F.col("zones")
    key = group_key(z)
    return of_type(records, WORK).select(
        "row_idx", "id", "ark", key["c015"].alias("c015"), key["c700"].alias("c700"),
        R.first(z, "150", "a").alias("title"), normalize_title(R.first(z, "150", "a")).alias("title_key"), has_suffix(R.first(z, "150", "a")).alias("suffix"),
    )


def work_arks(zones: Column) -> Column:
    """The works of an expression: all 140$3, or all 750$3 if it has no 140$3."""
    own = R.values(zones, "140", "3")
    return F.when(F.size(own) > 0, own).otherwise(R.values(zones, "750", "3"))


def expression_works(records: DataFrame) -> DataFrame:
    """(row_idx, id, ark, ord, work_ark): an edge per work of an expression, doubles kept."""
    return of_type(records, EXPRESSION).select("row_idx", "id", "ark", F.posexplode(work_arks(F.col("zones"))).alias("ord", "work_ark"))


def manifestation_expressions(records: DataFrame) -> DataFrame:
    """(row_idx, id, ark, ord, expression_ark): an edge per 740$3 of a manifestation."""
    return of_type(records, MANIFESTATION).select("row_idx", "id", "ark", F.posexplode(R.values(F.col("zones"), "740", "3")).alias("ord", "expression_ark"))


def signature(zones: Column) -> tuple[Column, Column]:
    """The two factors of an expression's signature: distinct 051$a and 041$a. It has one only if both are filled."""
    return F.array_distinct(R.values(zones, "051", "a")), F.array_distinct(R.values(zones, "041", "a"))


def _note(zone: Column) -> Column:
    return F.try_element_at(R.zone_values(zone, "90F$q"), F.lit(1))


def _target(zone: Column) -> Column:
    return F.try_element_at(R.zone_values(zone, "90F$a"), F.lit(1))


def script_links(zones: Column, exact: bool = True) -> Column:
    """Targets and dates of the script's 90F zones, in order: exact note, or in any case."""
    note = R.CLUSTER_NOTE
    wanted = (lambda z: _note(z) == note) if exact else (lambda z: F.lower(_note(z)) == note.lower())
    found = F.filter(R.zones_of(zones, "90F"), lambda z: F.coalesce(wanted(z) & (_target(z) != ""), F.lit(False)))
    return F.transform(found, lambda z: F.struct(_target(z).alias("ark"), F.try_element_at(R.zone_values(z, "90F$d"), F.lit(1)).alias("date")))


def link_zone(ark: Column, date: str) -> Column:
    """A 90F zone that links to ark."""
    sub = lambda letter, v: F.struct(F.lit(f"90F${letter}").alias("code"), v.alias("valeur"))
    return F.struct(F.lit("90F").alias("code"), F.array(sub("a", ark), sub("q", F.lit(R.CLUSTER_NOTE)), sub("d", F.lit(date))).alias("sousZones"))


def append_zones(zones: Column, more: Column) -> Column:
    return F.concat(F.coalesce(zones, F.array().cast(R.ZONES)), more)


def rebuild_links(zones: Column, arks: Column, date: str) -> Column:
    """Zones with the script's 90F zones replaced by links to arks; others keep their order, the new ones come last."""
    kept = F.filter(zones, lambda z: ~((z["code"] == "90F") & F.coalesce(_note(z) == R.CLUSTER_NOTE, F.lit(False))))
    return append_zones(kept, F.transform(arks, lambda a: link_zone(a, date)))


def move_parent(zones: Column, old: Column, new: Column) -> Column:
    """Zones of a manifestation with every 740$3 = old made new; if there is none, its first 740$3."""
    hit = F.exists(R.values(zones, "740", "3"), lambda v: v == old)
    change = lambda s, yes: F.struct(s["code"].alias("code"), F.when(yes, new).otherwise(s["valeur"]).alias("valeur"))
    each = F.transform(zones, lambda z: F.struct(z["code"].alias("code"), F.transform(z["sousZones"], lambda s: change(s, (z["code"] == "740") & (s["code"] == "740$3") & (s["valeur"] == old))).alias("sousZones")))
    at = F.array_position(F.transform(zones, lambda z: F.coalesce((z["code"] == "740") & F.exists(z["sousZones"], lambda s: s["code"] == "740$3"), F.lit(False))), True)
    first = F.transform(
        zones,
        lambda z, i: F.struct(
            z["code"].alias("code"),
            F.transform(z["sousZones"], lambda s, k: change(s, (i + 1 == at) & (k + 1 == F.array_position(F.transform(z["sousZones"], lambda x: x["code"] == "740$3"), True)))).alias("sousZones"),
        ),
    )
    return F.when(hit, each).otherwise(first)


def serialize(zones: Column) -> Column:
    """JSON text of zones with `, ` and `: ` as separators, non-ASCII kept, null values as empty text."""
    # The text of a list of one, without its brackets: the built-in writer escapes quotes, backslashes and control characters.
    text = lambda c: F.to_json(F.array(F.coalesce(c, F.lit(""))))
    q = lambda c: F.substring(text(c), F.lit(2), F.length(text(c)) - 2)
    sub = lambda s: F.concat(F.lit('{"code": '), q(s["code"]), F.lit(', "valeur": '), q(s["valeur"]), F.lit("}"))
    zone = lambda z: F.concat(F.lit('{"code": '), q(z["code"]), F.lit(', "sousZones": ['), F.array_join(F.transform(F.coalesce(z["sousZones"], F.array()), sub), ", "), F.lit("]}"))
    return F.concat(F.lit('{"zones": ['), F.array_join(F.transform(F.coalesce(zones, F.array().cast(R.ZONES)), zone), ", "), F.lit("]}"))
