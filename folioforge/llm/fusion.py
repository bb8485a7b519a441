"""The best representative of each duplicate group.

Method: Bayesian fusion with copy detection. Sources claim values for the fields of a group. Their accuracies and
their dependence are estimated together: sources that share values which are probably false are
probably copying, and the votes of a copier are discounted. Values with the highest posterior win.

Sources are known (the levels of provenance), so all that the estimate needs of an item (a field of
a group) is which sets of sources stand behind its values, and how many values each. Items with the same sets are counted
together; this histogram, not the claims, is what the estimate runs over. Up to N_FALSE values of a set items are told apart
by their number; those with more count together under their mean, so that the histogram stays small and no claim is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators.record import first, parse_zones
from folioforge.session import materialize

#: The number of false values that a field is taken to have, the a-priori chance of dependence, the share copied.
N_FALSE, DEPENDENT, COPIED = 10, 0.1, 0.8
#: Sets of sources are held as bits of a number.
MAX_SOURCES = 62


def _weight(mask: int, order: list[int], accuracy: list[float], copies: dict[tuple[int, int], float]) -> float:
    """The vote of a set of sources (as bits): of the more accurate sources first, each discounted by the chance that it copied
    from one counted before."""
    vote, seen = 0.0, []
    for s in order:
        if mask >> s & 1:
            alone = math.prod(1 - COPIED * copies.get((min(s, t), max(s, t)), 0.0) for t in seen)
            vote += alone * math.log(N_FALSE * accuracy[s] / (1 - accuracy[s]))
            seen.append(s)
    return vote


def _weights(masks: Iterable[int], accuracy: list[float], copies: dict[tuple[int, int], float]) -> dict[int, float]:
    """The votes of the sets of sources that occur."""
    order = sorted(range(len(accuracy)), key=lambda s: (-accuracy[s], s))
    return {m: _weight(m, order, accuracy, copies) for m in masks}


def _posteriors(masks: list[int], counts: list[float], weights: dict[int, float]) -> list[float]:
    top = max(weights[m] for m in masks)
    each = [math.exp(weights[m] - top) for m in masks]
    # Values that nobody claims share the rest.
    total = sum(e * c for e, c in zip(each, counts)) + max(0.0, N_FALSE + 1 - sum(counts)) * math.exp(-top)
    return [e / total for e in each]


def estimate(histogram: list[tuple[list[tuple[int, float]], int]], n_sources: int, rounds: int = 8) -> tuple[list[float], dict[tuple[int, int], float]]:
    """(accuracies, chances of dependence) from a histogram of items: ([(set of sources, values an item)], items)."""
    accuracy, copies = [0.8] * n_sources, {}
    every = {m for sets, _ in histogram for m, _ in sets}
    for _ in range(rounds):
        weights = _weights(every, accuracy, copies)
        right, claims = [1.0] * n_sources, [1.25] * n_sources
        same_true, same_false, differ = ({p: 0.0 for p in combinations(range(n_sources), 2)} for _ in range(3))
        for sets, n in histogram:
            masks, counts = [m for m, _ in sets], [c for _, c in sets]
            chance = _posteriors(masks, counts, weights)
            for m, c, p in zip(masks, counts, chance):
                for s in range(n_sources):
                    if m >> s & 1:
                        right[s] += n * c * p
                        claims[s] += n * c
            for a, b in same_true:
                both = sum(c for m, c in sets if m >> a & 1), sum(c for m, c in sets if m >> b & 1)
                if not all(both):
                    continue
                shared = [(c, p) for m, c, p in zip(masks, counts, chance) if m >> a & m >> b & 1]
                same_true[a, b] += n * sum(c * p for c, p in shared)
                same_false[a, b] += n * sum(c * (1 - p) for c, p in shared)
                differ[a, b] += n * max(0, min(both) - sum(c for c, _ in shared))
        accuracy = [min(0.99, max(0.05, r / c)) for r, c in zip(right, claims)]
        for a, b in same_true:
            e = 1 - (accuracy[a] + accuracy[b]) / 2
            alone = ((1 - e) ** 2, e * e / N_FALSE)
            alone = (*alone, 1 - sum(alone))
            tied = ((1 - e) * COPIED + alone[0] * (1 - COPIED), e * COPIED + alone[1] * (1 - COPIED), alone[2] * (1 - COPIED))
            odds = sum(k[a, b] * (math.log(t) - math.log(i)) for k, t, i in zip((same_true, same_false, differ), tied, alone))
            odds += math.log(DEPENDENT / (1 - DEPENDENT))
            copies[a, b] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return accuracy, copies


def _histogram(masks: DataFrame) -> list[tuple[list[tuple[int, float]], int]]:
    """The histogram of items of (group, field, value, mask): sets with their mean number of values an item, and items."""
    sets = masks.groupBy("group", "field", "mask").agg(F.count(F.lit(1)).alias("n")).groupBy("group", "field").agg(F.sort_array(F.collect_list(F.struct("mask", "n"))).alias("sets"))
    key = F.transform("sets", lambda x: F.struct(x["mask"].alias("mask"), F.least(x["n"], F.lit(N_FALSE + 1)).alias("n")))
    each = sets.select(key.alias("key"), F.posexplode("sets").alias("at", "s")).groupBy("key", "at").agg(F.max("s.mask").alias("mask"), F.avg("s.n").alias("n"), F.count(F.lit(1)).alias("items"))
    rows = each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("mask", "n"))).alias("sets"), F.max("items").alias("items"))
    return [([(x["mask"], x["n"]) for x in r["sets"]], r["items"]) for r in rows.select("sets", "items").toLocalIterator()]


def fuse(claims: DataFrame, sources: list[str]) -> tuple[DataFrame, list[float], dict[tuple[int, int], float]]:
    """(values, accuracies, dependences) of claims (group, field, value, source): values has the posterior of
    each distinct value, 1 for the field's best as `rank`. Sources not in the list count as one more;
    claims with a null field or value are none. Ties go to the value with more sources, then the smaller."""
    if len(sources) >= MAX_SOURCES:
        raise ValueError(f"at most {MAX_SOURCES - 1} sources")
    bit = F.lit(1 << len(sources)).cast("long")
    for i, s in enumerate(sources):
        bit = F.when(F.col("source") == s, F.lit(1 << i).cast("long")).otherwise(bit)
    masks = materialize(claims.filter("field is not null and value is not null").groupBy("group", "field", "value").agg(F.bit_or(bit).alias("mask")), "masks")
    histogram = _histogram(masks)
    accuracy, copies = estimate(histogram, len(sources) + 1)
    votes = _weights({m for sets, _ in histogram for m, _ in sets}, accuracy, copies)
    scored = masks.join(claims.sparkSession.createDataFrame(sorted(votes.items()), "mask long, vote double"), "mask")
    norm = scored.groupBy("group", "field").agg(F.sum(F.exp("vote")).alias("z"), F.count(F.lit(1)).alias("k"), F.max(F.struct("vote", F.bit_count("mask").alias("bits"))).alias("top"))
    best = scored.join(norm, ["group", "field"])
    is_top = (F.col("vote") == F.col("top.vote")) & (F.bit_count("mask") == F.col("top.bits"))
    first_top = best.filter(is_top).groupBy("group", "field").agg(F.min("value").alias("best_value"))
    rest = F.greatest(F.lit(0), F.lit(N_FALSE + 1) - F.col("k"))
    values = best.join(first_top, ["group", "field"]).select(
        "group", "field", "value", (F.exp("vote") / (F.col("z") + rest)).alias("posterior"), F.when(F.col("value") == F.col("best_value"), 1).otherwise(2).alias("rank")
    )
    return values, accuracy, copies


def day_of(text: Column) -> Column:
    """A date written day first (with / . or -) or as ISO, as date; null for anything else."""
    iso = F.regexp_extract(text, r"^\s*(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})\b", 0)
    d = lambda i: F.regexp_extract(text, r"^\s*(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", i)
    made = F.concat_ws("-", d(3), F.lpad(d(2), 2, "0"), F.lpad(d(1), 2, "0"))
    return F.when(iso != "", F.try_to_date(F.regexp_replace(F.trim(iso), "[/.]", "-"), "yyyy-M-d")).when(d(1) != "", F.try_to_date(made, "yyyy-MM-dd"))


def _filled(zones: Column, texts: bool) -> Column:
    """Fields of a record: (zone code, hash of its filled values, these values if asked for) of each zone code that holds a value with
    a letter or digit."""
    has = lambda s: F.coalesce(s["valeur"], F.lit("")).rlike(r"[\p{L}\p{N}]")
    filled = F.filter(zones, lambda z: (z["code"] != "90F") & F.exists(F.coalesce(z["sousZones"], F.array()), has))
    codes = F.array_distinct(F.transform(filled, lambda z: z["code"]))
    text = lambda z: F.array_join(F.transform(F.filter(z["sousZones"], has), lambda s: F.concat_ws("=", s["code"], F.trim(s["valeur"]))), "|")
    value = lambda c: F.array_join(F.sort_array(F.transform(F.filter(filled, lambda z: z["code"] == c), text)), "||")
    kept = lambda c: [value(c).alias("text")] if texts else []
    return F.coalesce(F.transform(codes, lambda c: F.struct(c.alias("field"), F.xxhash64(value(c)).alias("value"), *kept(c))), F.array())


def _represented(clusters: DataFrame, entities: DataFrame, levels: DataFrame, texts: bool) -> tuple[DataFrame, DataFrame, list[str]]:
    """(members, claims, sources): the members of each cluster with the row that stands for each; what they claim."""
    members = (
        clusters.select("cluster_id", F.explode(F.array_distinct(F.concat(F.array("anchor_id"), F.coalesce("clustered_ids", F.array())))).alias("id"))
        .filter("id is not null and trim(id) <> ''")
        .distinct()
    )
    wanted = materialize(members, "members")
    levels = levels.filter("provenance is not null").groupBy("provenance").agg(F.max("level").alias("level"))
    zones = F.col("zones")
    slim = (
        entities.filter("intermarc is not null or id_entitelrm is not null")
        .withColumn("zones", parse_zones(F.col("intermarc")))
        .select(F.col("id_entitelrm").alias("id"), "row_idx", "loaded_at", "provenance", day_of(first(zones, "001", "d")).alias("day"), _filled(zones, texts).alias("fields"))
    )
    known = slim.join(wanted.select("id").distinct(), "id", "left_semi")
    latest = known.groupBy("id").agg(F.max_by(F.struct("provenance", "day", "fields"), F.struct("loaded_at", "row_idx")).alias("r"))
    member = materialize(wanted.join(latest, "id").join(F.broadcast(levels.withColumnRenamed("provenance", "_p")), F.col("r.provenance") == F.col("_p"), "left").select("cluster_id", "id", "r.*", "level"), "represented")
    sources = [r[0] for r in levels.select("provenance").orderBy("provenance").limit(MAX_SOURCES).collect()]
    claims = member.select(F.col("cluster_id").alias("group"), "id", F.coalesce("provenance", F.lit("")).alias("source"), F.explode("fields").alias("f")).select("group", "id", "source", "f.*")
    return member, claims, sources


def fused_records(clusters: DataFrame, entities: DataFrame, levels: DataFrame) -> DataFrame:
    """(cluster_id, field, value, posterior, n_values): the surviving record of each cluster, field by field: of each zone code that any
    member fills, the value (its filled subfields as `code=value`, sorted by zone) of the greatest posterior. Members are
    represented as in best_members; ties go to the value with more sources."""
    _, claims, sources = _represented(clusters, entities, levels, True)
    values, _, _ = fuse(claims, sources)
    best = values.groupBy("group", "field").agg(F.min_by(F.struct("value", "posterior"), "rank").alias("b"), F.count(F.lit(1)).alias("n_values")).select("group", "field", "b.*", "n_values")
    text = claims.groupBy("group", "field", "value").agg(F.min("text").alias("text"))
    return best.join(text, ["group", "field", "value"]).select(F.col("group").alias("cluster_id"), "field", F.col("text").alias("value"), "posterior", "n_values")


def best_members(clusters: DataFrame, entities: DataFrame, levels: DataFrame) -> DataFrame:
    """One row per cluster: cluster_id, best_id, support, dominant, n_members, most_supported.

    The members of a cluster (anchor_id and clustered_ids, blanks and nulls aside) are each represented
    by the entity row with the latest loaded_at (then the largest row_idx). Their zones are claims of their
    provenance; fusion gives each claim its posterior, and a member's support is the sum over its
    zones. The best member is the one that equals or beats all others in completeness (its zones hold
    all that any member has), recency (001$d; none is oldest) and trust (level of the provenance; none is
    least); if several do or none, the one with the most support, then the smaller id. `dominant`
    tells whether exactly one member of several does; most_supported is the member that fusion alone would choose. Clusters
    without any known member give no row; rows that stand twice count once.
    """
    member, claims, sources = _represented(clusters, entities, levels, False)
    values, _, _ = fuse(claims, sources)
    support = claims.join(values, ["group", "field", "value"]).groupBy("group", "id").agg(F.sum("posterior").alias("support"))
    n_zones = claims.groupBy(F.col("group").alias("cluster_id")).agg(F.countDistinct("field").alias("all_zones"))
    top = member.groupBy("cluster_id").agg(F.max("day").alias("last_day"), F.max("level").alias("top_level"), F.count(F.lit(1)).alias("n_members"))
    judged = (
        member.join(top, "cluster_id")
        .join(n_zones, "cluster_id", "left")
        .join(support.select(F.col("group").alias("cluster_id"), "id", "support"), ["cluster_id", "id"], "left")
        .select(
            "cluster_id", "id", "n_members", F.coalesce("support", F.lit(0.0)).alias("support"),
            ((F.size("fields") == F.coalesce("all_zones", F.lit(0))) & F.col("day").eqNullSafe(F.col("last_day")) & F.col("level").eqNullSafe(F.col("top_level"))).alias("beats_all"),
        )
    )
    return judged.groupBy("cluster_id").agg(
        F.min_by("id", F.struct(~F.col("beats_all"), -F.round("support", 9), "id")).alias("best_id"),
        F.min_by("id", F.struct(-F.round("support", 9), "id")).alias("most_supported"),
        F.max_by("support", F.struct("beats_all", "support")).alias("support"),
        ((F.sum(F.col("beats_all").cast("int")) == 1) & (F.max("n_members") > 1)).alias("dominant"),
        F.max("n_members").alias("n_members"),
    )
