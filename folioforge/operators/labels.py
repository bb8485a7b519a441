"""Labels of ARKs, agents' names, and records as readable text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators import record as R

#: Zones of agents, and the subfields of a name in a record's own zone.
AGENT_ZONES = ("700", "701", "702", "710", "711", "712")
NAME_PARTS = ("a", "b", "c", "d", "f", "g", "h", "m", "n", "p", "q")
_ANY_ARK = r"ark:/[^\s]+"


def label(type_norm: Column, zones: Column) -> Column:
    """What a record is called, by its type; null where its type or the field is missing."""
    person = F.concat_ws(" ", R.first_filled(zones, "100", "a"), R.first_filled(zones, "100", "m"))
    dewey = F.concat_ws(" — ", R.first_filled(zones, "186", "i"), R.first_filled(zones, "186", "a"))
    by_type = {
        "oeuvre": R.first_filled(zones, "150", "a"),
        "identite publique de personne": F.when(person != "", person),
        "collectivite": R.first_filled(zones, "110", "a"),
        "manifestation": R.first_filled(zones, "245", "a"),
        "expression": F.coalesce(R.first_filled(zones, "150", "a"), R.first_filled(zones, "245", "a")),
        "valeur controlee": R.first_filled(zones, "169", "a"),
        "marque": R.first_filled(zones, "163", "a"),
        "concept dewey": F.when(dewey != "", dewey),
    }
    out = None
    for kind, value in by_type.items():
        out = F.when(type_norm == kind, value) if out is None else out.when(type_norm == kind, value)
    return out


def ark_labels(records: DataFrame) -> DataFrame:
    """(ark, id, label) of each record with an ARK and a label; of records that share an ARK the last row counts."""
    named = records.select(R.clean_ark(F.col("ark")).alias("ark"), "id", label(F.col("type_norm"), F.col("zones")).alias("label"), "row_idx").filter("ark is not null and label is not null")
    return named.groupBy("ark").agg(F.max_by(F.struct("id", "label"), "row_idx").alias("r")).select("ark", F.col("r.id").alias("id"), F.col("r.label").alias("label"))


def agent_names(records: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, ord, name): the agents of each record in order of its agent zones: the zone's own name parts, or else the
    label of the first record its $0 or $3 leads to. Each name once, at its first place."""
    zones = F.filter(F.col("zones"), lambda z: z["code"].isin(*AGENT_ZONES))
    letter = lambda s: F.lower(F.substring_index(s["code"], "$", -1))
    filled = lambda z: F.filter(F.coalesce(z["sousZones"], F.array()), lambda s: F.trim(F.coalesce(s["valeur"], F.lit(""))) != "")
    own = lambda z: F.array_join(F.transform(F.filter(filled(z), lambda s: letter(s).isin(*NAME_PARTS)), lambda s: F.trim(s["valeur"])), " ")
    refs = lambda z: F.transform(F.filter(filled(z), lambda s: letter(s).isin("0", "3")), lambda s: R.clean_ark(s["valeur"]))
    rows = records.select("id", "row_idx", F.posexplode(F.transform(zones, lambda z: F.struct(own(z).alias("own"), refs(z).alias("refs")))).alias("ord", "z"))
    links = rows.select("id", "row_idx", "ord", F.col("z.own").alias("own"), F.posexplode_outer("z.refs").alias("ref_ord", "ref"))
    known = links.join(labels.select(F.col("ark").alias("ref"), "label"), "ref", "left")
    named = known.groupBy("id", "row_idx", "ord").agg(F.max("own").alias("own"), F.min_by("label", F.when(F.col("label").isNotNull(), F.col("ref_ord"))).alias("found"))
    names = named.select("id", "ord", F.when(F.col("own") != "", F.col("own")).otherwise(F.col("found")).alias("name")).filter("name is not null")
    return names.groupBy("id", "name").agg(F.min("ord").alias("ord"))


def decorate(rows: DataFrame, text: str, labels: DataFrame, key: str) -> DataFrame:
    """(key, text): each ARK that a text mentions replaced by its label, where there is one. Longer ARKs go first, so that
    none is replaced inside another."""
    found = rows.select(key, text, F.explode_outer(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(_ANY_ARK), F.lit(0)))).alias("token"))
    known = found.join(labels.select(F.col("ark").alias("_ark"), "label"), R.clean_ark(F.col("token")) == F.col("_ark"), "left")
    pairs = known.groupBy(key, text).agg(F.sort_array(F.collect_list(F.when(F.col("label").isNotNull(), F.struct((-F.length("token")).alias("n"), "token", "label")))).alias("p"))
    return pairs.select(key, F.aggregate("p", F.col(text), lambda t, p: F.replace(t, p["token"], p["label"])).alias("text"))


def pretty_print(zones: Column) -> Column:
    """One line per zone: its code and `$x value` of each subfield."""
    sub = lambda s: F.concat(F.lit(" $"), F.substring_index(s["code"], "$", -1), F.lit(" "), F.coalesce(s["valeur"], F.lit("")))
    return F.array_join(F.transform(F.filter(zones, lambda z: z.isNotNull()), lambda z: F.concat(z["code"], F.array_join(F.transform(F.filter(F.coalesce(z["sousZones"], F.array()), lambda s: s.isNotNull()), sub), ""))), "\n")


def parse_pretty(text: Column) -> Column:
    """Zones from the text of pretty_print. Not lossless for values that hold ` $` or line breaks; an empty line is none."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")

    def zone(line: Column) -> Column:
        parts = F.split(line, r" \$")
        code = F.trim(parts[0])
        subs = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.struct(F.concat(code, F.lit("$"), F.regexp_extract(p, r"^(\S+)", 1)).alias("code"), F.regexp_extract(p, r"(?s)^\S+ (.*)$", 1).alias("valeur")))
        return F.struct(code.alias("code"), subs.alias("sousZones"))

    return F.transform(lines, zone)


def ark_to_id(ark: Column) -> Column:
    """What stands between the last `/cb` and the last character; null if that is nothing."""
    return F.nullif(F.regexp_extract(ark, r"(?i)^.*/cb(.+).$", 1), F.lit(""))


def internal_id(ark: Column) -> Column:
    """The looser reading: after the first `cb`, letters and digits only, without the last; null if nothing is left."""
    at = F.instr(F.lower(ark), "cb")
    tail = F.regexp_replace(F.substring(ark, at + 2, F.length(ark)), "[^0-9A-Za-z]", "")
    return F.when((at > 0) & (F.length(tail) > 1), F.substring(tail, F.lit(1), F.length(tail) - 1))
