"""Lists of ARKs, and records fetched by ARK through a client that the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ANY_ARK = r"(?i)ark:/[0-9]+/[A-Za-z0-9]+"


def found_arks(text: Column, pattern: str = ANY_ARK) -> Column:
    """Every ARK in a text, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def distinct_in_order(*sources: DataFrame) -> DataFrame:
    """(ark, ord): the values of sources (ark, ord) one after the other, trimmed, empty ones dropped, each at its first place."""
    both = None
    for i, df in enumerate(sources):
        one = df.select(F.trim("ark").alias("ark"), F.struct(F.lit(i).alias("source"), F.col("ord").cast("long").alias("ord")).alias("k")).filter("ark <> ''")
        both = one if both is None else both.unionByName(one)
    first = both.groupBy("ark").agg(F.min("k").alias("k"))
    return first.select("ark", F.col("k.source").cast("long").alias("source"), F.col("k.ord").alias("ord"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(ark, ord) of a text file with one ARK a line."""
    return distinct_in_order(spark.read.text(path).select(F.col("value").alias("ark"), F.monotonically_increasing_id().alias("ord"))).select("ark", "ord")


def write_list(arks: DataFrame, path: str) -> None:
    arks.orderBy("ord").select("ark").write.mode("overwrite").text(path)


def fetch(arks: DataFrame, client: Callable[[str], tuple[int, str]], cache: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(ark, http_code, body, cached, error) of each ARK: from the cache (ark, http_code, body) if it is there, else by client.

    Nothing is fetched without a client; failures become rows with an error and don't end the job.
    """
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    wanted = arks.select("ark").distinct() if limit is None else arks.orderBy("ord").select("ark").limit(limit)
    schema = "ark string, http_code int, body string, cached boolean, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ark in batch.column(0).to_pylist():
                try:
                    code, body = client(ark)
                    rows.append((ark, code, body, False, None))
                except Exception as e:  # a failed call is an outcome
                    rows.append((ark, None, None, False, str(e)))
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["ark", "http_code", "body", "cached", "error"])

    if cache is None:
        return wanted.mapInArrow(run, schema)
    kept = cache.join(wanted, "ark", "left_semi").select("ark", "http_code", "body", F.lit(True).alias("cached"), F.lit(None).cast("string").alias("error"))
    return kept.unionByName(wanted.join(cache, "ark", "left_anti").mapInArrow(run, schema))


def _names_of(xml: str | None) -> list[str]:
    try:
        fields = [f for f in ElementTree.fromstring(xml or "").iter() if f.tag.rpartition("}")[2] == "datafield"]
    except ElementTree.ParseError:
        return []
    names: dict[str, None] = {}
    for tag in ("200", "400"):
        for f in fields:
            if f.get("tag") == tag:
                parts = [(s.text or "").strip() for code in "abc" for s in f if s.tag.rpartition("}")[2] == "subfield" and s.get("code") == code]
                name = " ".join(p for p in parts if p)
                if name:
                    names[name] = None
    return list(names)


def marc_names(records: DataFrame, key: str = "ark", xml: str = "body") -> DataFrame:
    """(key, ord, variant): the names of authority records in MARCXchange: of each datafield 200, then 400, its subfields
    a, then b, then c, joined; each once. Broken XML and null have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, n) for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, n in enumerate(_names_of(x))]
            cols = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string()))], names=[key, "ord", "variant"])

    return records.select(key, xml).mapInArrow(run, f"{key} string, ord int, variant string")
