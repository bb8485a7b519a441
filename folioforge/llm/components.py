"""Consolidating pairwise matches into groups.

Method: union-find within edge partitions, where only a spanning forest is kept, and a hierarchical
merge of the forests through bounded partitions until global components remain.

1. Each partition of edges runs union-find and emits its forest as stars: every node with its root, the
   smallest node of its local component. A partition's memory is bounded: after `max_nodes` nodes
   it emits what it has and starts afresh.
2. A node that several partitions hold has several roots. Those roots belong together: the edges between
   them (each to the smallest) are the graph of the next level, whose nodes are roots only. Each node
   keeps a pointer to its smallest root.
3. The next level's edges are spread over as many partitions as keep each under `bound` edges, one in the
   end. A level that hardly shrinks the graph is preceded by a large-star and a small-star step, which
   turn long chains into stars and are known to converge.
4. When no edges are left, the pointers are followed back, level by level.

No task or driver ever holds the whole graph; the driver sees one row count per level.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import drop, materialize


def _forest(max_nodes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[str, str] = {}

        def find(x: str) -> str:
            top = x
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        def stars() -> pa.RecordBatch:
            nodes = list(parent)
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array([find(x) for x in nodes], pa.string())], names=["node", "root"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                a, b = find(a), find(b)
                if a < b:
                    parent[b] = a
                elif b < a:
                    parent[a] = b
            if len(parent) >= max_nodes:
                yield stars()
                parent.clear()
        if parent:
            yield stars()

    return run


def _star_step(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each node's larger neighbours are tied to its smallest neighbour; small star: its
    smaller neighbours and itself. Both keep what is connected."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    tied = both.join(least, "a")
    if large:
        out = tied.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def follow(pointers: DataFrame, labels: DataFrame, heavy: int = 1_000_000) -> DataFrame:
    """(node, root) and (node, root) of the roots: each node with its root's root. Labels that very many
    nodes point to are joined by broadcast: those with more than `heavy` nodes each are few by count."""
    up = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
    total = pointers.count()
    out = lambda p, u: p.join(u, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    if total <= heavy:
        return out(pointers, up)
    hot = pointers.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(heavy, total // 512)).select("root")
    hot_up = F.broadcast(up.join(F.broadcast(hot), "root", "left_semi"))
    return out(pointers.join(F.broadcast(hot), "root", "left_semi"), hot_up).unionByName(out(pointers.join(F.broadcast(hot), "root", "left_anti"), up))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", bound: int = 2_000_000, max_nodes: int = 1_000_000) -> DataFrame:
    """(node, root): each node of a string edge list with the smallest node (by code point) of all that
    are linked with it directly or indirectly.

    Edges with a null end are ignored; loops and repeated edges change nothing, and a node that only
    has a loop gets no row. An empty table gives an empty table; other columns are ignored.
    """
    level = edges.select(F.col(f"`{a}`").cast("string").alias("a"), F.col(f"`{b}`").cast("string").alias("b")).filter("a <> b")
    pointers: list[DataFrame] = []
    before, n = math.inf, math.inf
    while True:
        if pointers and n > bound:
            if n > 0.7 * before:
                stars = materialize(_star_step(_star_step(level, True), False), "stars")
                drop(level)
                level = stars
            level_in = level.repartition(math.ceil(n / bound), "b")
        else:
            level_in = level.coalesce(1) if pointers else level
        stars = level_in.mapInArrow(_forest(max_nodes), "node string, root string")
        # A node has one root a forest at most, so the set is bounded by the number of forests.
        roots = stars.groupBy("node").agg(F.sort_array(F.collect_set("root")).alias("roots"))
        step = materialize(roots.select("node", F.col("roots")[0].alias("root"), F.when(F.size("roots") > 1, F.slice("roots", 2, 1 << 30)).alias("others")), f"level{len(pointers)}")
        pointers.append(step.select("node", "root"))
        before = n
        level = materialize(step.filter("others is not null").select(F.explode("others").alias("a"), F.col("root").alias("b")).distinct(), "edges")
        n = level.count()
        if n == 0:
            drop(level)
            break
    labels = pointers[-1]
    for p in reversed(pointers[:-1]):
        labels = follow(p, labels)
    return labels
