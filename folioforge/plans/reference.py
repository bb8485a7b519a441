"""One query per operator over the catalogue's tables. Each has its SQL in oracle.py unless SQL can't express it.

curated: the last delivery of each record; original: the first. Seeds of the extraction: the anchors of
cluster_result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import authority, clustering, detection, extraction, labels, review
from folioforge.operators import entities as E
from folioforge.operators import record as R
from folioforge.operators.flatten import flatten_subfields, flatten_zones
from folioforge.operators.labels import AGENT_ZONES
from folioforge.operators.ordering import collated, ranked
from folioforge.session import materialize
from folioforge.sources.arks import distinct_in_order, found_arks
from folioforge.sources.csv_entities import delimiter_of, with_updates
from folioforge.sources.tables import table

#: Queries that read the parsed records more than twice.
PARSED_ONCE = frozenset(
    "cluster_expressions expr_pairs detect_clusters apply_work_decisions apply_expression_decisions expression_groups independent_expressions coverage is_clustered unclustered_works unclustered_counts work_clusters expression_clusters work_counts primary_expression work_list "
    "agent_names breadcrumbs decorate_text merge_updates export_curated title_key clean_title detect_hits detect_contamination variant_spans parent_entity first_child original_indexes".split()
)
#: The zones that queries read, where it isn't all: only these are shuffled and written. The ARK and the type are always there.
_TITLES, _LINKS, _GROUPS = ("150",), ("140", "750", "740"), ("015", "700", "150")
_CLUSTERS = ("001", "150", "90F", *_LINKS)
_LABELS = ("100", "110", "150", "163", "169", "186", "245")
ZONES_READ: dict[str, tuple[str, ...]] = {
    "zone_filter": ("700",), "subfield_values": ("701",), "first_subfield": ("601",), "entity_ark": (), "title_main": _TITLES, "work_group_key": _GROUPS, "display_title": _TITLES, "manifestation_title": ("245",),
    "ark_to_id": (), "derive_internal_id": (), "cluster_targets": ("90F",), "existing_targets": ("90F",), "expr_signature": ("051", "041"), "filter_works": (), "filter_expressions": (), "filter_wem": (),
    "record_source": (), "merged_index": (), "record_lookup": (), "tab_lookup": (), "ark_index": ("001", "150"), "bond_counts": ("700", "701", "702", *_LINKS), "responsible_arks": AGENT_ZONES, "name_variants": ("100", "400"),
    "honorific_variants": ("100", "400"), "sorted_titles": _TITLES, "ark_labels": _LABELS, "agent_names": (*AGENT_ZONES, *_LABELS), "decorate_text": ("700", *_LABELS), "breadcrumbs": (*_LINKS, *_LABELS), "extract_arks": (),
    "cluster_expressions": (*_GROUPS, *_LINKS, "041", "051", "90F"), "expr_pairs": (*_GROUPS, *_LINKS, "041", "051", "90F"), "relationship_counts": tuple(sorted({z for codes in review.RELATIONSHIPS.values() for z in codes})),
} | dict.fromkeys("has_suffix illustration_trigger normalize_title work_groups work_anchors cluster_works cluster_sizes".split(), _GROUPS) | dict.fromkeys(
    "expr_work_edges manif_expr_edges expressions_by_work manifestations_by_expression inventory_cluster parent_entity first_child moved_manifestations original_indexes".split(), _LINKS
) | dict.fromkeys(
    "detect_clusters apply_work_decisions apply_expression_decisions expression_groups independent_expressions coverage is_clustered unclustered_works unclustered_counts work_clusters expression_clusters work_counts primary_expression work_list".split(), _CLUSTERS
)
RUN_DATE = "2026-01-31"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class Catalogue:
    """The tables of a folder, as the operators take them."""

    def __init__(self, spark: SparkSession, folder: str, keep: bool = False, codes: tuple[str, ...] | None = None) -> None:
        self.keep = keep  # whether records are parsed once and written, for queries that read them several times
        self.codes = codes  # the zones that are read, or None for all
        self.rows = table(spark, folder, "test_honorific")
        self.authorities = table(spark, folder, "authority_core")
        self.edges = table(spark, folder, "entitelrm_entitelrm")
        self.clusters = table(spark, folder, "cluster_result")
        self.detections = table(spark, folder, "detection_record")
        self.variants = table(spark, folder, "nes_variant")
        self.lines = table(spark, folder, "raw_entity_line")
        self.z = F.col("zones")

    @cached_property
    def curated(self) -> DataFrame:
        return self._parsed(E.last_rows, "curated")

    @cached_property
    def original(self) -> DataFrame:
        return self._parsed(E.first_rows, "original")

    def _parsed(self, pick: Callable[..., DataFrame], name: str) -> DataFrame:
        df = E.index_records(pick(self.rows)) if self.codes is None else pick(self.rows, E.index_records(self.rows, self.codes))
        return materialize(df, name) if self.keep else df

    @property
    def everything(self) -> DataFrame:
        """Curated records and the controlled values, in order."""
        core = self.authorities.withColumn("row_idx", -F.col("id_entitelrm").cast("long"))
        return self.curated.unionByName(E.index_records(core, self.codes))

    @property
    def seeds(self) -> DataFrame:
        return self.clusters.select(F.expr("try_cast(anchor_id AS BIGINT)").alias("id")).filter("id is not null").distinct()

    # What several steps read is written once.
    @cached_property
    def items(self) -> DataFrame:
        return materialize(review.cluster_items(self.curated, self.original), "items")

    @cached_property
    def expressions(self) -> DataFrame:
        return materialize(review.cluster_expressions(self.curated, self.items), "expressions")

    @cached_property
    def coverage(self) -> DataFrame:
        return materialize(review.coverage(self.items, self.expressions, self.curated), "coverage")


def query(f: Callable[[Catalogue], DataFrame]) -> Callable[[Catalogue], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = f(Catalogue(spark, folder, f.__name__ in PARSED_ONCE, ZONES_READ.get(f.__name__)))
        return out.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in out.dtypes])

    QUERIES[f.__name__] = run
    return f


def joined(values):
    """An array as text, for results that hold scalars only."""
    return F.array_join(values, "|")


# Records and their accessors


@query
def scan_entities(c):
    return c.rows.select("row_idx", "id_entitelrm", "type_entite", F.length("intermarc").cast("long").alias("n_chars"))


@query
def parse_record(c):
    return flatten_subfields(c.rows, ["row_idx"])


@query
def record_zones(c):
    return flatten_zones(c.rows, ["row_idx"]).withColumn("n_subfields", F.col("n_subfields").cast("long"))


@query
def index_records(c):
    return E.index_records(c.rows).select("row_idx", "id", "type_norm", "ark")


@query
def serialize_record(c):
    return c.curated.filter("zones is not null").select("id", F.md5(E.serialize(c.z)).alias("digest"))


@query
def zone_filter(c):
    return c.curated.select("id", F.size(R.zones_of(c.z, "700")).cast("long").alias("n")).filter("n > 0")


@query
def subfield_values(c):
    return c.curated.select("id", F.posexplode(R.values(c.z, "701", "3")).alias("ord", "value"))


@query
def first_subfield(c):
    return c.curated.select("id", R.first_filled(c.z, "601", "a").alias("value")).filter("value is not null")


@query
def entity_ark(c):
    return c.curated.select("id", "ark")


@query
def title_main(c):
    return E.of_type(c.curated, E.WORK).select("id", R.first(c.z, "150", "a").alias("title"))


@query
def work_group_key(c):
    return E.work_rows(c.curated).filter("c015 is not null").select("id", "c015", "c700")


@query
def append_zone(c):
    more = E.append_zones(c.z, F.array(E.link_zone(F.col("ark"), RUN_DATE)))
    return E.of_type(c.curated, E.WORK).filter("ark is not null").select("id", F.size(c.z).cast("long").alias("before"), F.size(more).cast("long").alias("after"), F.element_at(more, -1)["sousZones"][0]["valeur"].alias("target"))


@query
def display_title(c):
    return E.of_type(c.curated, E.WORK).select("id", review.display_title(c.z).alias("title"))


@query
def manifestation_title(c):
    return E.of_type(c.curated, E.MANIFESTATION).select("id", R.first_zone_text(c.z, "245").alias("title"))


@query
def expr_work_edges(c):
    return E.expression_works(c.curated).select("id", "ord", "work_ark")


@query
def manif_expr_edges(c):
    return E.manifestation_expressions(c.curated).select("id", "ord", "expression_ark")


@query
def cluster_targets(c):
    return c.curated.select("id", F.posexplode(E.script_links(c.z)).alias("ord", "l")).select("id", "ord", F.col("l.ark").alias("ark"), F.col("l.date").alias("date"))


@query
def existing_targets(c):
    return c.curated.select("id", F.explode(E.script_links(c.z, exact=False)).alias("l")).select("id", F.col("l.ark").alias("ark")).distinct()


@query
def expr_signature(c):
    one, two = E.signature(c.z)
    return E.of_type(c.curated, E.EXPRESSION).select("id", F.explode(one).alias("s051"), "zones").select("id", "s051", F.explode(two).alias("s041"))


@query
def rebuild_90f(c):
    new = E.rebuild_links(c.z, F.array(F.lit("ark:/12148/cb0x")), RUN_DATE)
    return E.of_type(c.curated, E.WORK).filter("zones is not null").select("id", F.size(new).cast("long").alias("n_zones"), F.size(R.zones_of(new, "90F")).cast("long").alias("n_links"))


@query
def pretty_print(c):
    return c.curated.filter("zones is not null").select("id", F.md5(labels.pretty_print(c.z)).alias("digest"))


@query
def parse_pretty(c):
    back = labels.parse_pretty(labels.pretty_print(c.z))
    return c.curated.filter("zones is not null").select("id", F.size(F.flatten(F.transform(back, lambda z: z["sousZones"]))).cast("long").alias("n"), R.first(back, "001", "a").alias("ark"))


@query
def extract_arks(c):
    return c.curated.join(c.rows, "row_idx").select("id", F.posexplode(found_arks(F.col("intermarc"))).alias("ord", "ark"))


@query
def ark_to_id(c):
    return c.curated.filter("ark is not null").select("id", labels.ark_to_id(F.col("ark")).alias("from_ark"))


@query
def derive_internal_id(c):
    return c.curated.filter("ark is not null").select("id", labels.internal_id(F.col("ark")).alias("from_ark"))


@query
def normalize_type(c):
    return c.rows.select("type_entite", R.normalize_type(F.col("type_entite")).alias("type_norm")).groupBy("type_entite", "type_norm").agg(F.count(F.lit(1)).alias("n"))


@query
def validate_record(c):
    return c.rows.select("row_idx", R.parse_zones(F.col("intermarc")).isNotNull().alias("valid"))


@query
def validate_keys(c):
    return review.key_problems(c.rows)


def _by_title(titles: DataFrame) -> DataFrame:
    """Rows (id, title) with their place in the order of titles, then ids."""
    return ranked(titles, collated(F.col("title")), F.col("id"))


# Filters


@query
def filter_works(c):
    return E.of_type(c.curated, E.WORK).select("id")


@query
def filter_expressions(c):
    return E.of_type(c.curated, E.EXPRESSION).select("id")


@query
def has_suffix(c):
    return E.work_rows(c.curated).filter("suffix").select("id", "title")


@query
def illustration_trigger(c):
    return E.work_rows(c.curated).filter(detection.has_illustration(F.col("title"))).select("id")


@query
def is_clustered(c):
    return review.is_clustered(c.original, c.coverage)


@query
def unclustered_works(c):
    state = review.is_clustered(E.of_type(c.original, E.WORK), c.coverage).filter("not clustered").select("id")
    return _by_title(E.of_type(c.original, E.WORK).join(state, "id", "left_semi").select("id", F.coalesce(review.display_title(c.z), "id").alias("title")))


@query
def record_source(c):
    return review.merged(c.curated.select("id", "row_idx"), c.original.select("id", "row_idx")).select("id", "row_idx", "source")


# Extraction


@query
def hop_750(c):
    return extraction.hop(c.seeds, c.edges, "750$3")


@query
def hop_740(c):
    return extraction.hop(extraction.hop(c.seeds, c.edges, "750$3"), c.edges, "740$3")


@query
def base_ids(c):
    return extraction.base_ids(c.seeds, c.edges)


@query
def base_rows(c):
    return extraction.rows_of(extraction.base_ids(c.seeds, c.edges), c.rows).select("row_idx", "id_entitelrm")


@query
def ark_hits(c):
    return c.rows.select("row_idx", F.explode(extraction.ark_mentions(F.col("intermarc"))).alias("hit")).groupBy("row_idx", "hit").agg(F.count(F.lit(1)).alias("n"))


@query
def extract_neighbourhood(c):
    return ranked(extraction.neighbourhood(c.seeds, c.edges, c.rows).select("row_idx", "id_entitelrm", "type_entite"), F.col("id_entitelrm").cast("long"), F.col("row_idx"))


@query
def stage_counts(c):
    return extraction.stage_counts(c.seeds, c.edges, c.rows)


# Clustering


@query
def normalize_title(c):
    return E.work_rows(c.curated).filter("title is not null").select("id", "title_key")


@query
def work_groups(c):
    return clustering.work_groups(E.work_rows(c.curated)).select("c015", "c700", "title_key", "n", "first_row")


@query
def work_anchors(c):
    return clustering.work_anchors(E.work_rows(c.curated)).select("title_key", "anchor_id", "anchor_ark", "n")


@query
def cluster_works(c):
    return clustering.cluster_members(E.work_rows(c.curated)).select("anchor_id", "anchor_ark", "member_id", "member_ark", "member_row")


@query
def cluster_works_90f(c):
    linked = clustering.linked_works(c.curated, RUN_DATE)
    return linked.select("id", F.size(R.zones_of(c.z, "90F")).cast("long").alias("n_links"), F.element_at(c.z, -1)["sousZones"][0]["valeur"].alias("last_target"))


@query
def cluster_sizes(c):
    return clustering.cluster_members(E.work_rows(c.curated)).groupBy("anchor_id").agg((F.count(F.lit(1)) + 1).alias("size"))


@query
def expressions_by_work(c):
    return E.expression_works(c.curated).groupBy("work_ark").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first_row"))


@query
def expr_pairs(c):
    return clustering.expression_pairs(c.curated).select("anchor_id", "a_id", "c_id", "shared").groupBy("anchor_id", "a_id", "c_id").agg(F.max("shared").alias("shared"))


@query
def cluster_expressions(c):
    return clustering.cluster_expressions(c.curated)


@query
def merge_updates(c):
    updates = clustering.linked_works(c.curated, RUN_DATE)
    new = with_updates(E.last_rows(c.rows), updates)
    return E.index_records(new).select("id", F.size(R.zones_of(c.z, "90F")).cast("long").alias("n_links"))


@query
def export_curated(c):
    new = with_updates(E.last_rows(c.rows), clustering.linked_works(c.curated, RUN_DATE))
    updated = F.col("intermarc").contains(f'"{RUN_DATE}"')
    return new.select("row_idx", "id_entitelrm", "type_entite", updated.alias("updated"), F.when(~updated, F.md5("intermarc")).alias("digest"))


# Review


@query
def detect_clusters(c):
    return c.items.select("anchor_id", "anchor_ark", "ord", "item_ark", "date", "item_id", "item_title")


@query
def expression_groups(c):
    return c.expressions.filter("role <> 'independent'").select("anchor_id", "role", "expression_id", "expression_ark", "work_ark")


@query
def independent_expressions(c):
    return c.expressions.filter("role = 'independent'").select("anchor_id", "expression_id", "expression_ark", "work_ark")


def _decided(c: Catalogue) -> DataFrame:
    """Items with decisions: links to records that nobody knows are rejected."""
    return review.apply_decisions(c.items, c.items.filter("item_id is null").select("anchor_id", "item_ark", F.lit(False).alias("accepted")).distinct())


@query
def apply_work_decisions(c):
    return _decided(c).select("anchor_id", "ord", "item_ark", "accepted", "date")


@query
def apply_expression_decisions(c):
    return review.apply_to_expressions(c.expressions, _decided(c)).select("anchor_id", "expression_id", "work_ark", "accepted")


@query
def ark_index(c):
    return review.ark_index(c.original)


@query
def coverage(c):
    return c.coverage


@query
def work_counts(c):
    return review.work_counts(c.expressions, c.curated)


@query
def unclustered_counts(c):
    works = E.of_type(c.original, E.WORK)
    state = review.is_clustered(works, c.coverage).filter("not clustered").select("id")
    return review.unclustered_counts(works.join(state, "id", "left_semi"), c.original)


@query
def relationship_counts(c):
    return review.relationship_counts(c.curated)


@query
def bond_counts(c):
    """The same over the zones that bind works, expressions and manifestations to each other."""
    return review.relationship_counts(c.curated, {E.WORK: ("700", "701", "702"), E.EXPRESSION: ("140", "750"), E.MANIFESTATION: ("740",)})


@query
def manifestations_by_expression(c):
    return E.manifestation_expressions(c.curated).groupBy("expression_ark").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query
def original_indexes(c):
    works = E.of_type(c.original, E.WORK).select(F.lit("work").alias("kind"), "ark", "id")
    exprs = E.expression_works(c.original).select(F.lit("expression of").alias("kind"), F.col("work_ark").alias("ark"), "id")
    manifs = E.manifestation_expressions(c.original).select(F.lit("manifestation of").alias("kind"), F.col("expression_ark").alias("ark"), "id")
    return works.unionByName(exprs).unionByName(manifs)


@query
def merged_index(c):
    both = c.original.select("id", "ark", F.lit(1).alias("k")).unionByName(c.curated.select("id", "ark", F.lit(0).alias("k")))
    return both.groupBy("id").agg(F.min_by("ark", "k").alias("ark"))


@query
def record_lookup(c):
    both = c.original.select(F.lower("ark").alias("ark"), "id", "row_idx", F.lit(1).alias("k")).unionByName(c.curated.select(F.lower("ark").alias("ark"), "id", "row_idx", F.lit(0).alias("k")))
    return both.filter("ark is not null").groupBy("ark").agg(F.max_by(F.struct("id", "row_idx"), F.struct("k", "row_idx")).alias("r")).select("ark", "r.id", "r.row_idx")


@query
def primary_expression(c):
    return review.primary_expressions(c.expressions)


@query
def work_clusters(c):
    return review.cluster_of_works(c.items)


@query
def expression_clusters(c):
    return review.cluster_of_expressions(c.items, c.expressions)


@query
def tab_lookup(c):
    """By id and by ARK, the record that comes last: original records first, then curated ones."""
    both = c.original.select("id", F.lower("ark").alias("ark"), "row_idx", F.lit(0).alias("k")).unionByName(c.curated.select("id", F.lower("ark").alias("ark"), "row_idx", F.lit(1).alias("k")))
    keys = F.array(F.struct(F.lit("id").alias("kind"), F.col("id").alias("key")), F.struct(F.lit("ark").alias("kind"), F.col("ark").alias("key")))
    last = both.select(F.explode(keys).alias("x"), "row_idx", "k").filter("x.key is not null").groupBy("x.kind", "x.key").agg(F.max_by("row_idx", F.struct("k", "row_idx")).alias("row_idx"))
    return last.select("kind", "key", "row_idx")


@query
def filter_wem(c):
    return c.curated.filter(F.col("type_norm").isin(E.WORK, E.EXPRESSION, E.MANIFESTATION)).select("id", "type_norm")


@query
def filter_equal(c):
    return review.equal_where_given(c.edges, codesouszone="750$3", id_entitelrm_source=None).select("edge_id")


@query
def inventory_cluster(c):
    works = E.of_type(c.original, E.WORK).filter("ark is not null").select(F.col("id").alias("work_id"), F.col("ark").alias("work_ark"))
    return works.join(E.expression_works(c.original).select("work_ark", F.col("id").alias("expression_id"), "ord"), "work_ark").select("work_id", "expression_id", "ord")


@query
def parent_entity(c):
    manifs = E.manifestation_expressions(c.curated).filter("ord = 0").select("id", F.col("expression_ark").alias("parent_ark"))
    return manifs.unionByName(E.expression_works(c.curated).filter("ord = 0").select("id", F.col("work_ark").alias("parent_ark")))


@query
def first_child(c):
    exprs = E.expression_works(c.curated).groupBy(F.col("work_ark").alias("ark")).agg(F.min_by("id", F.struct("row_idx", "ord")).alias("child_id"))
    return exprs.unionByName(E.manifestation_expressions(c.curated).groupBy(F.col("expression_ark").alias("ark")).agg(F.min_by("id", F.struct("row_idx", "ord")).alias("child_id")))


@query
def moved_manifestations(c):
    old = E.manifestation_expressions(c.original).filter("ord = 0").select("id", F.col("expression_ark").alias("old_ark"))
    return E.manifestation_expressions(c.curated).filter("ord = 0").select("id", F.col("expression_ark").alias("new_ark")).join(old, "id").filter("old_ark <> new_ark")


@query
def move_manifestation(c):
    one = E.of_type(c.curated, E.MANIFESTATION).filter("zones is not null")
    moved = one.select("id", E.move_parent(c.z, R.first(c.z, "740", "3"), F.lit("ark:/12148/cb0x")).alias("zones"))
    return moved.select("id", joined(R.values(c.z, "740", "3")).alias("parents"))


@query
def curated_diff(c):
    return review.differences(c.curated.filter("zones is not null"), c.original.filter("zones is not null"))


@query
def sorted_titles(c):
    titles = E.of_type(c.curated, E.WORK).select("id", F.coalesce(review.display_title(c.z), "id").alias("title"))
    return _by_title(titles)


@query
def work_list(c):
    anchors = c.items.select(F.col("anchor_id").alias("id")).distinct().withColumn("kind", F.lit("cluster"))
    titled = E.of_type(c.curated, E.WORK).select("id", F.coalesce(review.display_title(c.z), "id").alias("title"))
    mixed = titled.join(anchors, "id", "left").select("id", "title", F.coalesce("kind", F.lit("work")).alias("kind"))
    return ranked(mixed, collated(F.col("title")), F.col("kind"), F.col("id"))  # clusters before works


# Labels and names


@query
def ark_labels(c):
    return labels.ark_labels(c.everything)


@query
def agent_names(c):
    return labels.agent_names(c.curated, labels.ark_labels(c.everything))


@query
def decorate_text(c):
    texts = c.curated.select("id", F.array_join(F.transform(R.values(c.z, "700", "3"), lambda v: F.trim(v)), " ").alias("text")).filter("text <> ''")
    return labels.decorate(texts, "text", labels.ark_labels(c.everything), "id")


@query
def breadcrumbs(c):
    names = labels.ark_labels(c.everything).select(F.col("ark").alias("_ark"), "label")
    edge = E.expression_works(c.curated).filter("ord = 0").select("id", R.clean_ark(F.col("work_ark")).alias("_ark"))
    own = E.of_type(c.curated, E.EXPRESSION).select("id", F.coalesce(labels.label(F.col("type_norm"), c.z), "id").alias("own"))
    return own.join(edge, "id").join(names, "_ark", "left").select("id", F.concat_ws(" › ", "label", F.when(F.col("label").isNull() | (F.col("label") != F.col("own")), F.col("own"))).alias("path"))


@query
def responsible_arks(c):
    return c.curated.select("id", F.posexplode(authority.responsible_arks(c.z)).alias("ord", "ark"))


@query
def name_variants(c):
    return c.curated.select("id", F.explode(authority.name_variants(c.z)).alias("variant"))


@query
def honorific_variants(c):
    return c.curated.select("id", authority.name_variants(c.z).alias("own")).filter("size(own) > 0").select("id", F.explode(authority.with_honorifics(F.col("own"))).alias("variant"))


def _store(c: Catalogue) -> DataFrame:
    return c.variants.select(R.clean_ark(F.col("ark")).alias("ark"), F.col("variant"), F.lit(0).alias("ord")).filter("ark is not null and variant is not null").distinct()


@query
def person_variants(c):
    return authority.person_variants(c.everything, _store(c)).select("ark", "variant").distinct()


@query
def nes_upsert(c):
    store = c.variants.select("ark", "variant", F.lit(0).alias("ord"))
    new = authority.person_variants(c.curated)
    return authority.upsert_variants(store, new).select("ark", "variant")


@query
def ark_list(c):
    return distinct_in_order(c.variants.select("ark", F.lit(0).alias("ord"))).select("ark")


@query
def ark_sources(c):
    return distinct_in_order(c.variants.select("ark", F.lit(0).alias("ord")), c.detections.select(F.col("work_ark").alias("ark"), F.lit(0).alias("ord"))).select("ark", "source")


@query
def dedupe_ordered(c):
    kept = F.array_distinct(F.filter(F.transform("clustered_arks", lambda v: F.trim(v)), lambda a: a != ""))
    return c.clusters.select("cluster_id", F.posexplode(kept).alias("ord", "ark")).distinct()


@query
def guess_delimiter(c):
    return c.lines.filter("line_no = 1").select("file_name", delimiter_of(F.col("line")).alias("delimiter"))


# Text functions and detection


@query
def fold_diacritics(c):
    return c.detections.filter("title is not null").select("detection_id", T.fold(F.col("title")).alias("folded"))


@query
def folded_map(c):
    maps = detection.folded_maps(c.detections.select(F.col("detection_id").alias("id"), "title"))
    return maps.select(F.col("id").cast("long").alias("detection_id"), "form", F.size("places").alias("n"), F.array_join(F.transform("places", lambda p: p.cast("string")), " ").alias("places"))


@query
def normalize_match(c):
    return c.detections.filter("title is not null").select("detection_id", T.normalize_match(F.col("title")).alias("form"))


@query
def word_tokens(c):
    return c.detections.filter("title is not null").select("detection_id", F.size(T.word_tokens(F.col("title"))).cast("long").alias("n"))


@query
def title_key(c):
    """Keys of titles after names and statements were taken out."""
    cleaned = detection.clean_titles(_titles(c))
    return cleaned.select("id", T.normalize_title(F.col("cleaned_title")).alias("title_key"))


@query
def merge_ranges(c):
    spans = F.transform(F.regexp_extract_all(F.col("title"), F.lit(r"(\w+)"), F.lit(1)), lambda w: F.struct(F.instr(F.col("title"), w).alias("start"), (F.instr(F.col("title"), w) + F.length(w) + 1).alias("end")))
    return c.detections.filter("title is not null").select("detection_id", F.size(T.merge_ranges(spans)).cast("long").alias("n"))


def _known_names(c: Catalogue) -> DataFrame:
    """(ark, variant): the names of records and all that the store keeps, for ARKs with a record as well."""
    return authority.person_variants(c.everything).unionByName(_store(c)).select("ark", "variant").distinct()


def _titles(c: Catalogue) -> DataFrame:
    """Works with their titles and all names of their agents."""
    works = E.of_type(c.curated, E.WORK).select("id", R.first(c.z, "150", "a").alias("title"), F.explode_outer(authority.responsible_arks(c.z)).alias("ark")).filter("title <> ''")
    named = works.select("id", "title", R.clean_ark(F.col("ark")).alias("ark")).join(_known_names(c), "ark", "left")
    return named.groupBy("id", "title").agg(F.sort_array(F.collect_set(F.when(detection.holds_name(F.col("title"), F.col("variant")), F.col("variant")))).alias("variants"))


def _titles_by_name(c: Catalogue) -> DataFrame:
    """Titles of works with each name of each of their own agents, which are looked for anywhere in the title."""
    works = E.of_type(c.curated, E.WORK).select("id", R.first(c.z, "150", "a").alias("title"), F.explode(authority.responsible_arks(c.z)).alias("ark")).filter("title <> ''")
    return works.select("id", "title", R.clean_ark(F.col("ark")).alias("ark")).distinct().join(_known_names(c), "ark").select("id", "title", "ark", "variant")


@query
def detect_hits(c):
    return detection.find_names(_titles_by_name(c), least=0.0).select("id", "ark", "variant", "score", "start", "end", "confidence")


@query
def detect_contamination(c):
    """At the usual thresholds no name reaches the report, as separators never stand in matching forms; 0.3 shows what is there."""
    works = E.of_type(c.curated, E.WORK).select("id", "ark", R.first(c.z, "150", "a").alias("title"))
    return detection.contamination(works, _titles_by_name(c), detection.clean_titles(_titles(c)), least=0.3, high=0.85)


@query
def variant_spans(c):
    return detection.find_names(_titles_by_name(c), least=0.0, telling=0).select("id", "start", "end").distinct()


@query
def clean_title(c):
    return detection.clean_titles(_titles(c))
