import glob
import json
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from folioforge.operators import detection
from folioforge.plans import oracle
from folioforge.plans import reference as P

ONE, TWO = "ark:/12148/cb100000001a", "ark:/12148/cb100000002b"


def catalogue(spark, folder, titles, people=(), variants=()):
    """A catalogue of works (title, ARKs of agents), persons (ARK, surname, forename) and stored names (ARK, variant)."""
    def zone(code, **values):
        return {"code": code, "sousZones": [{"code": f"{code}${k[-1]}", "valeur": v} for k, v in values.items()]}

    works = [("Œuvre", [zone("150", a=t), *(zone("700", s3=a) for a in arks)]) for t, arks in titles]
    persons = [("Identité publique de personne", [zone("001", a=ark), zone("100", a=a, m=m)]) for ark, a, m in people]
    c = P.Catalogue(spark, folder)
    rows = [(i, str(9000 + i), kind, json.dumps({"zones": zones}), None, None, None) for i, (kind, zones) in enumerate([*works, *persons])]
    c.rows = spark.createDataFrame(rows, c.rows.schema)
    c.variants = spark.createDataFrame(list(variants), "ark string, variant string")
    return c


def test_stored_names_are_found(spark, folder):
    """Names of the store count for agents without a record and beside those of a record."""
    titles = [("Contes bleus par Odile Ralpemont", [ONE]), ("Contes verts par Lolotte Belnetier", [TWO])]
    c = catalogue(spark, folder, titles, [(TWO, "Belnetier", "Charlotte")], [(ONE, " Odile  Ralpemont"), (TWO, "Lolotte Belnetier")])
    assert {r.cleaned_title for r in detection.clean_titles(P._titles(c)).collect()} == {"Contes bleus", "Contes verts"}
    assert {(r.ark, r.variant.strip()) for r in detection.find_names(P._titles_by_name(c), least=0.0).collect() if r.ark} == {(ONE, "Odile  Ralpemont"), (TWO, "Lolotte Belnetier")}


def test_own_agents_only(spark, folder):
    """A name may begin or end within a word of the title; names of persons who aren't the work's agents are none, nor are those after `par`."""
    titles = [("Contes bleus (Odile Ralpemontois)", [ONE]), ("Contes verts par Charlotte Belnetier", [ONE]), ("Contes gris par Jeanne Corpignet", [])]
    c = catalogue(spark, folder, titles, [(ONE, "Ralpemont", "Odile"), (TWO, "Belnetier", "Charlotte")])
    assert {(r.id, r.ark, r.variant) for r in detection.find_names(P._titles_by_name(c), least=0.0).collect()} == {("9000", ONE, "Odile Ralpemont")}


def test_report(spark, folder):
    """Each hit of the report has its work, its agent's ARK, place and score; one telling token is enough for spans only."""
    titles = [("Odile Ralpemont : contes illustrés par Odile Ralpemont", [ONE]), ("Contes de Voltaire", [TWO])]
    c = catalogue(spark, folder, titles, [(ONE, "Ralpemont", "Odile"), (TWO, "Voltaire", "")])
    works = spark.createDataFrame([("9000", "W", titles[0][0]), ("9001", None, titles[1][0])], "id string, ark string, title string")
    out = detection.contamination(works, P._titles_by_name(c), detection.clean_titles(P._titles(c)), least=0.3).collect()
    got = {(r.id_entitelrm, r.work_ark, r.author_ark, r.matched_variant, r.score, r.confidence) for r in out}
    assert got == {("9000", "W", ONE, "Odile Ralpemont", 0.45, "medium"), ("9000", "W", ONE, "Odile Ralpemont", 0.3, "medium")}
    assert {r.cleaned_title for r in out} == {"contes"}
    spans = detection.find_names(P._titles_by_name(c), least=0.0, telling=0).collect()
    assert {(r.id, r.start, r.end) for r in spans if r.id == "9001"} == {("9001", 10, 18)}


@pytest.fixture(scope="module")
def named(folder, tmp_path_factory):
    """The smallest tables with works added whose titles hold the names of their agents."""
    out = str(tmp_path_factory.mktemp("named"))
    for f in glob.glob(f"{folder}/*.parquet"):
        pq.write_table(pq.read_table(f), f"{out}/{os.path.basename(f)}")
    store = [r for r in pq.read_table(f"{folder}/nes_variant.parquet").to_pylist() if r["ark"] and len(r["variant"] or "") > 8][:12]
    records = pq.read_table(f"{folder}/test_honorific.parquet")
    rows = records.to_pylist()
    last = max(r["row_idx"] for r in rows)
    for k, r in enumerate(store):
        name = r["variant"]
        title = [f"{name} : contes œuvre", f"Contes – traduits par {name}, avec {name}", f"Histoire… œil, illustrations de {name}"][k % 3]
        zones = [("001", "a", f"ark:/12148/cb9{k}x"), ("150", "a", title), ("700", "3", r["ark"])]
        record = {"zones": [{"code": c, "sousZones": [{"code": f"{c}${x}", "valeur": v}]} for c, x, v in zones]}
        rows.append(rows[0] | {"row_idx": last + 1 + k, "id_entitelrm": str(99_000_000 + k), "type_entite": "Œuvre", "intermarc": json.dumps(record)})
    pq.write_table(pa.Table.from_pylist(rows, schema=records.schema), f"{out}/test_honorific.parquet")
    return out


@pytest.mark.parametrize("name", ["detect_hits", "variant_spans"])
def test_hits_equal_sql(spark, named, name):
    con = duckdb.connect()
    for f in glob.glob(f"{named}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = P.QUERIES[name](spark, named)
    want = con.execute(oracle.SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    got = sorted(tuple(r[c] for c in cols) for r in df.collect())
    assert len(got) > 10 and got == sorted(want.fetchall())
