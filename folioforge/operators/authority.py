"""Names of agents: responsible ARKs, heading variants, honorifics, and the store that keeps variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators import record as R
from folioforge.operators.labels import AGENT_ZONES

#: Honorifics and their abbreviations.
HONORIFICS = (
    ("madame", "Mme"), ("monsieur", "M."), ("monsieur", "Mr"), ("mademoiselle", "Mlle"), ("monseigneur", "Mgr"), ("comtesse", "Ctesse"), ("comte", "Cte"), ("marquise", "Mqe"), ("marquis", "Mq"), ("docteur", "Dr"),
    ("professeur", "Pr"), ("capitaine", "Cne"), ("lieutenant", "Lt"), ("general", "Gal"), ("général", "Gal"), ("baron", "Bn"), ("baronne", "Bne"), ("commandant", "Cdt"),
)


def responsible_arks(zones: Column) -> Column:
    """Every ARK of the agent zones, in the order of the zone codes: any subfield's text from `ark:/12148/` to the next
    space, without closing brackets and stops; each once."""
    def of(code: str) -> Column:
        found = F.transform(R.zones_of(zones, code), lambda z: F.transform(F.coalesce(z["sousZones"], F.array()), lambda s: F.rtrim(F.regexp_extract(F.coalesce(s["valeur"], F.lit("")), r"(ark:/12148/\S*)", 1), F.lit(").,;"))))
        return F.coalesce(F.flatten(found), F.array().cast("array<string>"))

    return F.array_distinct(F.filter(F.concat(*[of(c) for c in AGENT_ZONES]), lambda a: a != ""))


def heading(value: Column) -> Column:
    """A name without outer ` ,;:` and runs of white space."""
    text = F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)[\s\x{200B}]+", " ")
    return F.btrim(text, F.lit(" ,;:"))


def name_variants(zones: Column) -> Column:
    """The forms of a person's name: of each 100, then 400 zone, every $a, `$a $m` and `$m $a`; each once."""
    def of(code: str) -> Column:
        def forms(z: Column) -> Column:
            last = F.filter(F.transform(R.zone_values(z, f"{code}$a"), heading), lambda v: v != "")
            given = F.filter(F.transform(R.zone_values(z, f"{code}$m"), heading), lambda v: v != "")
            return F.flatten(F.transform(last, lambda a: F.concat(F.array(a), F.flatten(F.transform(given, lambda m: F.array(F.concat_ws(" ", a, m), F.concat_ws(" ", m, a)))))))

        return F.coalesce(F.flatten(F.transform(R.zones_of(zones, code), forms)), F.array().cast("array<string>"))

    return F.array_distinct(F.concat(of("100"), of("400")))


def with_honorifics(variants: Column) -> Column:
    """The variants and, after them, each with one honorific abbreviated (whole words, any case); each once."""
    table = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(s).alias("short")) for t, s in HONORIFICS])

    def each(v: Column) -> Column:
        holds = F.filter(table, lambda h: F.contains(F.lower(v), h["term"]))
        return F.transform(holds, lambda h: F.regexp_replace(v, F.concat(F.lit(r"(?iuU)\b"), h["term"], F.lit(r"\b")), h["short"]))

    return F.array_distinct(F.concat(variants, F.flatten(F.transform(variants, each))))


def person_variants(records: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """(ark, variant, ord): the names under which each person's ARK is known: those of its own record, else those
    kept in a store (ark, variant, ord)."""
    own = records.select("row_idx", R.clean_ark(F.col("ark")).alias("ark"), name_variants(F.col("zones")).alias("v")).filter("ark is not null and size(v) > 0")
    last = own.groupBy("ark").agg(F.max_by("v", "row_idx").alias("own")).select("ark", with_honorifics(F.col("own")).alias("v"))
    local = last.select("ark", F.posexplode("v").alias("ord", "variant"))
    if store is None:
        return local.select("ark", "variant", "ord")
    kept = store.join(last.select("ark"), "ark", "left_anti").select("ark", "variant", "ord")
    return local.select("ark", "variant", "ord").unionByName(kept)


def upsert_variants(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store (ark, variant, ord) with new variants added: what it holds stays, each variant once, new ones after the old."""
    both = store.select("ark", "variant", "ord", F.lit(0).alias("new")).unionByName(new.select("ark", "variant", "ord", F.lit(1).alias("new")))
    first = both.filter("ark is not null and variant is not null").groupBy("ark", "variant").agg(F.min(F.struct("new", "ord")).alias("k"))
    order = F.row_number().over(Window.partitionBy("ark").orderBy("k", "variant")) - 1
    return first.select("ark", "variant", order.alias("ord"))
