import json

from folioforge.operators.flatten import flatten_records, flatten_subfields

SCHEMA = "row_idx long, intermarc string, code string, valeur string"


def rec(*zones):
    return json.dumps({"zones": list(zones)}, ensure_ascii=False)


def rows(spark, *texts):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], SCHEMA)


def found(df):
    return sorted((r.row_idx, r.zone_pos, r.sub_pos, r.code, r.valeur) for r in df.collect())


def test_places_and_parents(spark):
    text = rec({"code": "001", "sousZones": [{"code": "001$a", "valeur": "x"}]}, {"code": "150", "sousZones": [{"code": "150$a", "valeur": "y"}, {"code": "150$9"}]})
    assert found(flatten_subfields(rows(spark, text), ["row_idx"])) == [(0, 0, 0, "001$a", "x"), (0, 1, 0, "150$a", "y"), (0, 1, 1, "150$9", None)]


def test_what_strays_from_the_schema(spark):
    lone = rec({"code": "600", "sousZones": {"code": "600$a", "valeur": 7}})
    one = '{"zones": {"code": "1", "sousZones": [{"code": "1$a"}]}}'
    mixed = '{"zones": [null, "x", {"code": "2", "sousZones": [3, null, {"code": "2$a", "valeur": true}], "meta": {"sousZones": [{"code": "no"}]}}, {"code": "3", "sousZones": null}, {"code": "4"}]}'
    assert found(flatten_subfields(rows(spark, lone, one, mixed), ["row_idx"])) == [(0, 0, 0, "600$a", "7"), (1, 0, 0, "1$a", None), (2, 2, 2, "2$a", "true")]


def test_no_records(spark):
    texts = [None, "", " ", "[]", "{}", "{bad", '{"zones": null}', '{"zones": "x"}', "null", "3"]
    assert found(flatten_subfields(rows(spark, *texts), ["row_idx"])) == []
    assert flatten_subfields(rows(spark).limit(0), ["row_idx"]).count() == 0


def test_byte_order_mark_repeats_and_long_records(spark):
    long = rec(*({"code": "5", "sousZones": [{"code": "5$a", "valeur": "v" * 50}] * 20} for _ in range(500)))
    text = "﻿" + rec({"code": "1", "sousZones": [{"code": "1$a", "valeur": "x"}]})
    assert flatten_subfields(rows(spark, long), ["row_idx"]).count() == 10000
    assert len(found(flatten_subfields(rows(spark, text, text), ["row_idx"]))) == 2


def test_related_tables(spark):
    text = rec({"code": "1", "sousZones": [{"code": "1$a"}]}, {"code": "2"})
    tables = flatten_records(rows(spark, text, None), ["row_idx"])
    assert sorted(map(tuple, tables["records"].collect())) == [(0, 2), (1, 0)]
    assert sorted(map(tuple, tables["zones"].collect())) == [(0, 0, "1", 1), (0, 1, "2", 0)]
    assert tables["subfields"].count() == 1


def test_one_scan_and_no_shuffle(spark):
    plan = flatten_subfields(rows(spark, None), ["row_idx"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
