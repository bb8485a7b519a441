"""Nested records as related flat tables.

Method: higher-order SQL projection. Nested transforms attach the ancestors' keys and places, flatten
joins the arrays of one record, and one inline per target table emits its rows. There is no join and
no shuffle: each table is a projection of one scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.record import parse_zones

_ZONE_ROWS = """
flatten(array(transform(_zones, (z, i) -> named_struct(
    'zone_pos', cast(i as int), 'code', z.code, 'n_subfields', coalesce(size(filter(z.sousZones, s -> s is not null)), 0), '_is', z is not null))))
"""
_SUBFIELD_ROWS = """
flatten(transform(_zones, (z, i) -> transform(coalesce(z.sousZones, array()), (s, j) -> named_struct(
    'zone_pos', cast(i as int), 'sub_pos', cast(j as int), 'zone_code', z.code, 'code', s.code, 'valeur', s.valeur, '_is', s is not null))))
"""


def _rows(df: DataFrame, keys: list[str], intermarc: str, rows: str, names: list[str]) -> DataFrame:
    keyed = df.select(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)], parse_zones(F.col(f"`{intermarc}`")).alias("_zones"))
    flat = keyed.select(*[f"_key{i}" for i in range(len(keys))], F.expr(f"inline(filter({rows}, x -> x._is))"))
    return flat.select(*[F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)], *names)


def flatten_zones(df: DataFrame, keys: list[str], intermarc: str = "intermarc") -> DataFrame:
    """One row per zone object: the record's keys, zone_pos (place in `zones`, from 0), code and the
    number of its subfield objects. Zones without subfields keep their row."""
    return _rows(df, keys, intermarc, _ZONE_ROWS, ["zone_pos", "code", "n_subfields"])


def flatten_subfields(df: DataFrame, keys: list[str], intermarc: str = "intermarc") -> DataFrame:
    """One row per subfield object: the record's keys, zone_pos and sub_pos (places from 0), the
    zone's code, the subfield's code and its value.

    (keys, zone_pos) leads to the row of flatten_zones, the keys to the record. A lone object counts
    as a list of one; elements that aren't objects keep their place but give no row; a subfield
    without `valeur` gives a row with null. Null, empty and broken records give no rows; records that
    stand twice give their rows twice (keys are carried, not checked). Columns of df other than the
    keys are not touched, whatever their names; keys must not be named like the columns added.
    """
    return _rows(df, keys, intermarc, _SUBFIELD_ROWS, ["zone_pos", "sub_pos", "zone_code", "code", "valeur"])


def flatten_records(df: DataFrame, keys: list[str], intermarc: str = "intermarc") -> dict[str, DataFrame]:
    """The related tables: records (keys and number of zones), zones, subfields."""
    zones = parse_zones(F.col(f"`{intermarc}`"))
    records = df.select(*[F.col(f"`{k}`") for k in keys], F.coalesce(F.size(F.filter(zones, lambda z: z.isNotNull())), F.lit(0)).alias("n_zones"))
    return {"records": records, "zones": flatten_zones(df, keys, intermarc), "subfields": flatten_subfields(df, keys, intermarc)}
