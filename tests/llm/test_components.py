import random

import pytest

from folioforge.llm.components import connected_components, follow


def brute(edges):
    top = {}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(top.setdefault(a, a) and a), find(top.setdefault(b, b) and b)
            top[max(a, b)] = min(a, b)
    return {x: find(x) for x in top}


def run(spark, edges, parts=5, **kw):
    df = spark.createDataFrame([(*e, "x", "y") for e in edges], "a string, b string, node string, root string").repartition(parts)
    rows = connected_components(df, **kw).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.root for r in rows}


@pytest.mark.parametrize("n,m,bound,nodes", [(300, 200, 20, 15), (800, 900, 100, 50), (50, 400, 1000, 1000)])
def test_random_graphs(spark, n, m, bound, nodes):
    rng = random.Random(n)
    edges = [(str(rng.randrange(n)), str(rng.randrange(n))) for _ in range(m)] + [(None, "1"), ("2", None), (None, None), ("7", "7"), ("1", "2"), ("1", "2")]
    assert run(spark, edges, bound=bound, max_nodes=nodes) == brute(edges)


def test_long_chain_through_small_partitions(spark):
    edges = [(f"{i:05}", f"{i + 1:05}") for i in range(600)]
    random.Random(1).shuffle(edges)
    assert set(run(spark, edges, bound=40, max_nodes=30).values()) == {"00000"}


def test_a_hub_of_a_third_of_all_rows(spark):
    edges = [("hub", f"n{i}") for i in range(3000)] + [(f"p{2 * i}", f"p{2 * i + 1}") for i in range(3000)]
    got = run(spark, edges, bound=500, max_nodes=400)
    assert got == brute(edges)


def test_code_points_decide_and_empty_tables(spark):
    assert run(spark, [("b", "Z"), ("é", "b")]) == {"b": "Z", "Z": "Z", "é": "Z"}
    assert run(spark, [("a", "a")]) == {}
    assert run(spark, []) == {}


def test_labels_that_many_nodes_point_to(spark):
    pointers = spark.createDataFrame([(f"n{i}", "r") for i in range(50)] + [("x", "y")], "node string, root string")
    labels = spark.createDataFrame([("r", "top")], "node string, root string")
    got = {r.node: r.root for r in follow(pointers, labels, heavy=10).collect()}
    assert got["n3"] == "top" and got["x"] == "y" and len(got) == 51
