import pytest
from pyspark.sql import functions as F

from folioforge.operators.authority import upsert_variants  # noqa: F401
from folioforge.sources import arks, csv_entities
from folioforge.streaming.incremental import follow_variants, latest_records

FILE = '﻿"ID_EntiteLRM" ;type_entite;intermarc;extra;type_entite\n1;Œuvre;"{""zones"":\n[]}";x;y\n2;Expression\n3;"a;b";"say ""hi""";;\n'


def test_entity_files(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(FILE, encoding="utf-8")
    df = csv_entities.read_entities(spark, str(path))
    rows = df.orderBy("row_idx").collect()
    assert [(r.id_entitelrm, r.type_entite, r.intermarc) for r in rows] == [("1", "Œuvre", '{"zones":\n[]}'), ("3", "a;b", 'say "hi"')]
    csv_entities.write_entities(df.select("row_idx", "id_entitelrm", "type_entite", "intermarc"), str(tmp_path / "out"))
    again = csv_entities.read_entities(spark, str(tmp_path / "out"))
    assert sorted(r.intermarc for r in again.collect()) == sorted(r.intermarc for r in rows)


def test_headers():
    assert csv_entities.resolve_headers(["INTERMARC", '"Type_entite"', "﻿id_entitelrm"])["id_entitelrm"] == "﻿id_entitelrm"
    with pytest.raises(KeyError, match="intermarc"):
        csv_entities.resolve_headers(["id_entitelrm", "type_entite"])
    assert csv_entities.guess_delimiter("a,b,c;d") == "," and csv_entities.guess_delimiter("a,b;c") == ";"


def test_lists_of_arks(spark, tmp_path):
    (tmp_path / "l.txt").write_text(" a \n\nb\na\n")
    df = arks.read_list(spark, str(tmp_path / "l.txt"))
    assert [r.ark for r in df.orderBy("ord").collect()] == ["a", "b"]
    found = spark.createDataFrame([("x ark:/12148/cb1x, ARK:/12148/cb1x ark:/12148/cb1x",)], "t string").select(arks.found_arks(F.col("t")).alias("a")).first().a
    assert found == ["ark:/12148/cb1x", "ARK:/12148/cb1x"]


def test_fetching_uses_the_cache_and_reports_failures(spark):
    def client(ark):
        if ark == "bad":
            raise OSError("no route")
        return 200, f"body of {ark}"

    wanted = spark.createDataFrame([("kept", 0), ("new", 1), ("bad", 2)], "ark string, ord long")
    cache = spark.createDataFrame([("kept", 200, "old"), ("other", 200, "x")], "ark string, http_code int, body string")
    got = {r.ark: (r.http_code, r.body, r.cached, r.error) for r in arks.fetch(wanted, client, cache).collect()}
    assert got == {"kept": (200, "old", True, None), "new": (200, "body of new", False, None), "bad": (None, None, False, "no route")}
    with pytest.raises(ValueError):
        arks.fetch(wanted, client, limit=-1)


def test_authority_records(spark):
    xml = '<r xmlns="urn:x"><datafield tag="400"><subfield code="a">B</subfield></datafield><datafield tag="200"><subfield code="b">Jean</subfield><subfield code="a">Dupont</subfield></datafield><datafield tag="200"/></r>'
    df = spark.createDataFrame([("1", xml), ("2", "<broken"), ("3", None)], "ark string, body string")
    assert [(r.ark, r.ord, r.variant) for r in arks.marc_names(df).collect()] == [("1", 0, "Dupont Jean"), ("1", 1, "B")]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "ark string, variant string, ord int"
    spark.createDataFrame([("a", "x", 0), ("a", "x", 0)], schema).coalesce(1).write.parquet(src)
    store = str(tmp_path / "store")
    run = lambda: follow_variants(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), store, str(tmp_path / "ck")).awaitTermination()
    run()
    spark.createDataFrame([("a", "y", 0)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    last = max(int(p.name) for p in (tmp_path / "store").iterdir() if p.name.isdigit())
    assert [r.variant for r in spark.read.parquet(f"{store}/{last}").orderBy("ord").collect()] == ["x", "y"]


def test_latest_records_follow_a_stream(spark, tmp_path):
    src = str(tmp_path / "rows")
    schema = "row_idx long, id_entitelrm string, type_entite string, intermarc string, loaded_at timestamp"
    spark.createDataFrame([(1, "a", "t", "old", None), (2, "a", "t", "new", None)], schema).write.parquet(src)
    q = latest_records(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("complete").format("memory").queryName("latest_rows").start()
    q.processAllAvailable()
    q.stop()
    assert [r.intermarc for r in spark.sql("select * from latest_rows").collect()] == ["new"]
