import datetime as dt
import itertools
import json
import random

import pytest

from folioforge.llm import fusion as U

LEVELS = [("A", 3), ("B", 2), ("C", 1), ("C", 1), (None, 9)]


def entity(spark, rows):
    """rows: (id, row_idx, provenance, loaded day, date, zones filled as {code: value})."""
    data = []
    for i, idx, prov, day, date, fields in rows:
        zones = [{"code": "001", "sousZones": [{"code": "001$a", "valeur": "x"}] + ([{"code": "001$d", "valeur": date}] if date else [])}]
        zones += [{"code": c, "sousZones": [{"code": f"{c}$a", "valeur": v}]} for c, v in fields.items()]
        data.append((idx, i, json.dumps({"zones": zones}), prov, None if day is None else dt.datetime(2025, 1, day), "clash"))
    return spark.createDataFrame(data, "row_idx long, id_entitelrm string, intermarc string, provenance string, loaded_at timestamp, level string")


def run(spark, clusters, rows, levels=LEVELS):
    c = spark.createDataFrame([(*x, "clash") for x in clusters], "cluster_id long, anchor_id string, clustered_ids array<string>, best_id string")
    lv = spark.createDataFrame(levels, "provenance string, level int")
    return {r.cluster_id: r for r in U.best_members(c, entity(spark, rows), lv).collect()}


def test_the_one_that_beats_all(spark):
    rows = [
        ("1", 1, "A", 1, "2020-01-02", {"150": "t", "700": "p"}), ("2", 2, "B", 1, "01/01/2020", {"150": "t"}), ("3", 3, "A", 1, "03.01.2020", {"150": "t"}), ("4", 4, "A", 1, "2020-01-02", {"150": "t", "700": "p"}),
        ("5", 5, None, 1, None, {"150": "."}), ("6", 6, "zz", 1, "soon", {"90F": "x"}),
    ]
    got = run(spark, [(1, "2", ["1"]), (2, "1", ["3"]), (3, "1", ["4"]), (4, "1", ["1", None, "", " "]), (5, "5", ["6", "5"]), (6, "none", ["9"]), (7, None, ["2", "1"]), (1, "2", ["1"]), (8, "1", None)], rows)
    assert {k: (r.best_id, r.dominant) for k, r in got.items() if r.dominant} == {1: ("1", True), 7: ("1", True)}
    assert set(got) == {1, 2, 3, 4, 5, 7, 8} and got[3].best_id == "1"


def test_the_latest_row_counts(spark):
    rows = [("1", 1, "C", 5, "2020-01-01", {"150": "t"}), ("1", 2, "A", 2, "2021-01-01", {"150": "t"}), ("1", 3, "B", None, "2022-01-01", {}), ("2", 4, "B", 1, "2020-01-01", {"150": "t"})]
    assert run(spark, [(1, "1", ["2"])], rows)[1].best_id == "2"


def test_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(str(i), i, rng.choice("ABC"), 1, rng.choice(["2020-01-01", "02.01.2020", "03/01/2020", None]), {c: "v" for c in rng.sample(["150", "700", "601"], rng.randint(0, 3))}) for i in range(60)]
    clusters = [(k, str(rng.randrange(60)), [str(rng.randrange(60)) for _ in range(rng.randint(0, 3))]) for k in range(150)]
    order = {"2020-01-01": 1, "02.01.2020": 2, "03/01/2020": 3, None: 0}
    want = {}
    for k, a, more in clusters:
        m = {a, *more}
        info = {i: (set(rows[int(i)][5]) | {"001"}, order[rows[int(i)][4]], dict(LEVELS)[rows[int(i)][2]]) for i in m}
        best = [i for i in m if all(info[i][0] >= info[j][0] and info[i][1] >= info[j][1] and info[i][2] >= info[j][2] for j in m)]
        if len(m) > 1 and len(best) == 1:
            want[k] = best[0]
    got = {k: r.best_id for k, r in run(spark, clusters, rows).items() if r.dominant}
    assert got == want


def test_empty(spark):
    assert run(spark, [], []) == {} and run(spark, [(1, "1", [])], []) == {} and run(spark, [(1, "1", [])], [("1", 1, "A", 1, None, {})], [])[1].best_id == "1"


def items(n, accuracy, copiers, rng):
    """Histogram of simulated claims about n fields with the true value 0; copiers: {source: whom it copies}."""
    out = {}
    for _ in range(n):
        said = {}
        for s, a in enumerate(accuracy):
            said[s] = said[copiers[s]] if s in copiers and rng.random() < 0.9 else (0 if rng.random() < a else rng.randint(1, 10))
        sets = {}
        for s, v in said.items():
            sets[v] = sets.get(v, 0) | 1 << s
        key = tuple(sorted(sets.values()))
        out[key] = out.get(key, 0) + 1
    return [([(m, 1) for m in sorted(k)], n) for k, n in out.items()]


def test_accuracies_and_copying_are_found():
    histogram = items(4000, [0.9, 0.75, 0.6, 0.5, 0.5], {4: 3}, random.Random(2))
    accuracy, copies = U.estimate(histogram, 5)
    assert all(abs(a - b) < 0.12 for a, b in zip(accuracy[:3], [0.9, 0.75, 0.6]))
    assert copies[3, 4] > 0.9 and all(p < 0.2 for k, p in copies.items() if k != (3, 4))


def test_copied_votes_are_discounted():
    free = U._weights(range(8), [0.6] * 3, {})
    tied = U._weights(range(8), [0.6] * 3, {(0, 1): 1.0})
    assert tied[0b011] < free[0b011] and tied[0b101] == pytest.approx(free[0b101])


def test_posteriors_sum_to_one():
    for masks in itertools.combinations(range(1, 8), 2):
        w = U._weights(range(8), [0.9, 0.7, 0.5], {})
        p = U._posteriors(list(masks), [1, 1], w)
        assert 0 < sum(p) <= 1


def test_ties_go_to_the_smaller_id(spark):
    rows = [("12", 1, "A", 1, None, {"150": "t"}), ("1", 2, "A", 1, None, {"150": "t"}), ("9", 3, "A", 1, None, {"150": "t"})]
    assert run(spark, [(1, "12", ["1"]), (2, "9", ["12"])], rows).keys() == {1, 2}
    got = run(spark, [(1, "12", ["1"]), (2, "9", ["12"])], rows)
    assert (got[1].best_id, got[2].best_id) == ("1", "12") and got[1].most_supported == "1"


def test_fused_records_and_copied_votes(spark):
    """Two sources that always make the same mistakes are outvoted by two that don't, one field at a time; many sources are allowed."""
    levels = [(p, i) for i, p in enumerate("ABCD")] + [(f"s{i}", 9) for i in range(30)]
    rows, clusters = [], []
    for k in range(60):
        wrong = k % 3 == 0
        for j, p in enumerate("ABCD"):
            value = f"false {k}" if wrong and p in "AB" else f"true {k}"
            if p == "D" and k % 2:
                value = f"own {k}"
            rows.append((f"{k}-{p}", len(rows), p, 1, None, {"150": value}))
        clusters.append((k, f"{k}-A", [f"{k}-{p}" for p in "BCD"]))
    c = spark.createDataFrame([(*x, "clash") for x in clusters], "cluster_id long, anchor_id string, clustered_ids array<string>, best_id string")
    out = U.fused_records(c, entity(spark, rows), spark.createDataFrame(levels, "provenance string, level int")).filter("field = '150'").collect()
    got = {r.cluster_id: r.value for r in out}
    assert len(out) == 60 and all(got[k] == f"150$a=true {k}" for k in range(60) if k % 2 == 0)
    assert all(0 < r.posterior <= 1 for r in out)
