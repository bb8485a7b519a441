"""Entity files: `;` separated, `"` quoted, doubled quotes, records over several lines."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.entities import serialize
from folioforge.operators.record import parse_zones
from folioforge.session import ship

REQUIRED = ("id_entitelrm", "type_entite", "intermarc")
OPTIONS = {"sep": ";", "quote": '"', "escape": '"', "multiLine": True, "header": True, "maxCharsPerColumn": -1, "encoding": "UTF-8"}


def normal_header(name: str) -> str:
    """A header without byte-order mark, control characters and quotes, in lower case."""
    name = unicodedata.normalize("NFKC", re.sub(r"[\x00-\x1f\x7f﻿]", "", name))
    return name.strip().strip("\"'").strip().lower()


def resolve_headers(columns: list[str]) -> dict[str, str]:
    """Required column -> the first column of that normal name; KeyError names the columns there are."""
    found: dict[str, str] = {}
    for i, c in enumerate(columns):
        name = normal_header(c)
        # Spark tells repeated headers apart by their places.
        if name not in REQUIRED and name.endswith(str(i)) and name.removesuffix(str(i)) in REQUIRED:
            name = name.removesuffix(str(i))
        found.setdefault(name, c)
    missing = [r for r in REQUIRED if r not in found]
    if missing:
        raise KeyError(f"no column {', '.join(missing)} among {', '.join(columns)}")
    return {r: found[r] for r in REQUIRED}


def guess_delimiter(first_line: str) -> str:
    """`;` or `,`, whichever stands more often; `;` on a tie."""
    return "," if first_line.count(",") > first_line.count(";") else ";"


def delimiter_of(line: Column) -> Column:
    """guess_delimiter as an expression."""
    times = lambda sign: F.length(line) - F.length(F.replace(line, F.lit(sign), F.lit("")))
    return F.when(times(",") > times(";"), ",").otherwise(";")


def read_entities(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """row_idx, id_entitelrm, type_entite, intermarc and the file's other columns. Rows without the three are skipped.

    A file with records over several lines is read by one task, so its rows keep their order; row_idx numbers
    them in order of the files. For large exports, write them as one record a line or as Parquet.
    """
    ship(spark)
    if sep is None:
        head = spark.read.text(path).limit(1).collect()
        sep = guess_delimiter(head[0][0]) if head else ";"
    raw = spark.read.options(**(OPTIONS | {"sep": sep})).csv(path)
    names = resolve_headers(raw.columns)
    own = {v: k for k, v in names.items()}
    out = raw.toDF(*[own.get(c, c) for c in raw.columns]).filter(" and ".join(f"{c} is not null" for c in REQUIRED))
    return out.select(F.monotonically_increasing_id().alias("row_idx"), *out.columns)


def with_updates(rows: DataFrame, updates: DataFrame) -> DataFrame:
    """rows as they are written: with the intermarc of updates (id, zones) where they have the id, with their own records written anew
    where they can be read, and as it stands where they can't."""
    new = updates.select(F.col("id").alias("id_entitelrm"), serialize(F.col("zones")).alias("_new"))
    zones = parse_zones(F.col("intermarc"))
    own = rows.withColumn("_zones", zones).withColumn("_own", F.when(F.col("_zones").isNotNull(), serialize(F.col("_zones"))))
    return own.join(new, "id_entitelrm", "left").withColumn("intermarc", F.coalesce("_new", "_own", "intermarc")).select(*rows.columns)


def write_entities(rows: DataFrame, path: str) -> None:
    """Write rows in order of row_idx as one CSV folder, values quoted only where they must be."""
    rows.orderBy("row_idx").drop("row_idx").write.mode("overwrite").options(sep=";", quote='"', escape='"', header=True, quoteAll=False, emptyValue="").csv(path)
