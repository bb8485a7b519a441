"""Columns over the nested record: zones, subfields and what is read from them.

A record is STRUCT<zones: ARRAY<STRUCT<code, sousZones: ARRAY<STRUCT<code, valeur>>>>>; zones and
subfields are ordered and repeatable. All accessors are higher-order functions, so they stay in the
JVM and no record is shuffled to read from it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONES = "array<struct<code:string,sousZones:array<struct<code:string,valeur:string>>>>"
CLUSTER_NOTE = "Clusterisation script"
BLANKS = " \t"


def _as_list(text: Column) -> Column:
    """JSON text of a list; a lone object becomes a list of one, anything else null."""
    return F.when(text.startswith("{"), F.concat(F.lit("["), text, F.lit("]"))).when(text.startswith("["), text)


def parse_zones(intermarc: Column) -> Column:
    """The zones of JSON record text, or null if there are none.

    Records that fit the schema take one typed parse. Only those that stray from it (a lone object for
    a list, a scalar among the objects) are parsed again level by level, where what isn't an object
    becomes a null element and keeps its place. A byte-order mark is ignored. Null, broken JSON and
    JSON that isn't an object give null. `valeur` is text: numbers and booleans as written, null for
    null or missing.
    """
    text = F.ltrim(F.regexp_replace(intermarc, r"^\uFEFF", ""))
    typed = F.from_json(text, f"zones {ZONES}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    raw = F.from_json(_as_list(F.from_json(text, "zones string")["zones"]), "array<string>")

    def subfields(zone: Column) -> Column:
        parts = F.from_json(_as_list(zone["sousZones"]), "array<string>")
        return F.transform(parts, lambda s: F.when(s.startswith("{"), F.from_json(s, "code string, valeur string")))

    def zone(z: Column) -> Column:
        z = F.from_json(z, "code string, sousZones string")
        return F.struct(z["code"].alias("code"), subfields(z).alias("sousZones"))

    loose = F.transform(raw, lambda z: F.when(z.startswith("{"), zone(z)))
    return F.when(text.startswith("{"), F.when(typed["_bad"].isNull(), typed["zones"]).otherwise(loose))


def zones_of(zones: Column, code: str) -> Column:
    """The zones with a code, in order."""
    return F.filter(zones, lambda z: z["code"] == code)


def zone_values(zone: Column, code: str) -> Column:
    """The values of a subfield within one zone; null for a value that is null or missing."""
    return F.transform(F.filter(F.coalesce(zone["sousZones"], F.array()), lambda s: s["code"] == code), lambda s: s["valeur"])


def values(zones: Column, zone: str, letter: str) -> Column:
    """All values of zone$letter, in zone order; an absent value is ''."""
    found = F.transform(zones_of(zones, zone), lambda z: F.transform(zone_values(z, f"{zone}${letter}"), lambda v: F.coalesce(v, F.lit(""))))
    return F.coalesce(F.flatten(found), F.array().cast("array<string>"))


def first(zones: Column, zone: str, letter: str) -> Column:
    """The first value of zone$letter over all zones of that code, or null."""
    return F.try_element_at(values(zones, zone, letter), F.lit(1))


def first_filled(zones: Column, zone: str, letter: str) -> Column:
    """The first non-empty value, where each zone offers only its first matching subfield."""
    heads = F.transform(zones_of(zones, zone), lambda z: F.try_element_at(zone_values(z, f"{zone}${letter}"), F.lit(1)))
    return F.try_element_at(F.filter(heads, lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(1))


def ark(zones: Column) -> Column:
    return first(zones, "001", "a")


def clean_ark(value: Column) -> Column:
    """An ARK in lower case without outer blanks (spaces, tabs); null if nothing is left."""
    bare = F.lower(F.btrim(value, F.lit(BLANKS)))
    return F.when(bare != "", bare)


def zone_text(zone: Column) -> Column:
    """All non-empty trimmed subfield values of a zone, joined; white space collapsed; null if empty."""
    parts = F.filter(F.transform(F.coalesce(zone["sousZones"], F.array()), lambda s: F.trim(F.coalesce(s["valeur"], F.lit("")))), lambda v: v != "")
    text = F.trim(F.regexp_replace(F.array_join(parts, " "), r"\s+", " "))
    return F.when(text != "", text)


def first_zone_text(zones: Column, code: str) -> Column:
    """zone_text of the first zone with a code."""
    return zone_text(F.try_element_at(zones_of(zones, code), F.lit(1)))


def normalize_type(kind: Column) -> Column:
    """Entity type without accents, ligatures, case or outer blanks: `Œuvre ` -> `oeuvre`."""
    from folioforge.functions.text import fold

    return F.trim(F.lower(fold(kind)))
