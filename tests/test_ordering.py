import json
import random

from pyspark.sql import functions as F

from folioforge.operators import entities as E
from folioforge.operators import review
from folioforge.operators.ordering import collated, ranked


def test_ranks_against_sorting(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "é", "e", "E", "f", "à", "b", ""])) for i in range(500)]
    got = {r.id: r["rank"] for r in ranked(spark.createDataFrame(rows, "id int, title string").repartition(7), F.col("title"), F.col("id")).collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))
    assert [got[i] for i, _ in want] == list(range(1, 501))
    assert ranked(spark.createDataFrame([], "id int"), F.col("id")).count() == 0


def test_dictionary_order(spark):
    titles = ["Zèbre", "éclair", "Eclat", "ecart", "Écart", "abbé", "Abbe"]
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [r.t for r in df.orderBy(collated(F.col("t")), "t").collect()] == ["Abbe", "abbé", "ecart", "Écart", "éclair", "Eclat", "Zèbre"]


def test_written_records_are_strict_json(spark):
    value = 'a"b\\c\r\n\t\x01\x1f é😀'
    zones = [("150", [("150$a", value), ("150$b", None)]), (None, None)]
    out = spark.createDataFrame([(zones,)], "zones array<struct<code:string,sousZones:array<struct<code:string,valeur:string>>>>").select(E.serialize(F.col("zones")).alias("t")).first().t
    assert json.loads(out)["zones"][0]["sousZones"] == [{"code": "150$a", "valeur": value}, {"code": "150$b", "valeur": ""}]


def test_lookups(spark):
    items = spark.createDataFrame([("a", "A", 1, 0, "B", "b"), ("c", "C", 0, 0, "B", "b"), ("c", "C", 0, 1, "X", None)], "anchor_id string, anchor_ark string, anchor_row long, ord int, item_ark string, item_id string")
    assert {(r.kind, r.key, r.anchor_id) for r in review.cluster_of_works(items).collect()} == {("id", "a", "a"), ("id", "b", "c"), ("id", "c", "c"), ("ark", "A", "a"), ("ark", "B", "c"), ("ark", "C", "c"), ("ark", "X", "c")}
    exprs = spark.createDataFrame([("a", "anchor", "e", "E"), ("c", "independent", "e", "E"), ("c", "clustered", "f", "")], "anchor_id string, role string, expression_id string, expression_ark string")
    assert {(r.kind, r.key, r.anchor_id, r.role) for r in review.cluster_of_expressions(items, exprs).collect()} == {("id", "e", "c", "independent"), ("ark", "E", "c", "independent"), ("id", "f", "c", "clustered")}
    assert review.equal_where_given(items, anchor_id="c", item_id=None).count() == 2


def test_narrow_records_keep_their_rows(spark):
    rows = [(1, "1", "Œuvre", json.dumps({"zones": [{"code": "001", "sousZones": [{"code": "001$a", "valeur": "x"}]}, {"code": "150", "sousZones": []}]})), (2, "2", None, "{"), (3, "1", "Œuvre", None)]
    df = spark.createDataFrame(rows, "row_idx long, id_entitelrm string, type_entite string, intermarc string")
    got = {r.row_idx: (r.ark, None if r.zones is None else [z.code for z in r.zones]) for r in E.index_records(df, ("150",)).collect()}
    assert got == {1: ("x", ["150"]), 2: (None, None), 3: (None, None)}
    plan = E.last_rows(df, E.index_records(df, ("150",)))._jdf.queryExecution().optimizedPlan().toString()
    assert {r.row_idx for r in E.last_rows(df, E.index_records(df, ())).collect()} == {2, 3}
    assert "LeftSemi" in plan
