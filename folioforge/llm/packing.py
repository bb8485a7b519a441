"""Filling fixed-capacity containers with items.

Method: configuration linear program over the length histogram. A configuration is a filling of one container; the
program covers all items with as few as possible. It is solved by multiplicative weights: lengths that
are still little covered weigh more, a knapsack dynamic program prices the configurations of greatest
weight, and those are used a little more, until all items are covered. The solution is rounded by carrying shares of a
container from one configuration to the next.

Only the histogram, at most `capacity` numbers, comes to the driver; the plan that goes back tells which ranks of each
length go to which containers, and its size is bounded by the rounds and the lengths, not by the items.
Items learn their rank among those of their length from counts per (length, salt), so that a length that a
third of all items have is ranked by many tasks.
"""

from __future__ import annotations

import base64
import math
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import materialize

#: Where the public vocabulary lies; a path may be given instead.
VOCABULARY = "byte_bpe_50k.tiktoken"


def _count_tokens(vocabulary: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        path = vocabulary or public_tokenizers.path(VOCABULARY)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            # Texts with lone surrogates can't come from Arrow; everything else can be encoded.
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(encode(t)) for t in batch.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of each document with a text."""
    return docs.filter("text is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(_count_tokens(vocabulary), "doc_id long, n_tokens long")


def knapsack(value: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack by dynamic programming: the greatest value of a filling of each size. value[l] is what an item of length l
    is worth; those worth nothing aren't used."""
    lengths = np.flatnonzero(value > 0)
    lengths = lengths[lengths > 0]
    worth = value[lengths]
    best = np.zeros(capacity + 1)
    ends = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if ends[c]:
            best[c] = max(best[c], (worth[: ends[c]] + best[c - lengths[: ends[c]]]).max())
    return best


class Program:
    """The configuration program of a histogram, solved by multiplicative weights.

    It runs over a time from 0 to 1: at time t each length has to be covered to the share t of its items. What a length is
    worth is its share of the capacity, to the power `spare` (short lengths fit anywhere and are spared), times exp(rate x
    how far it lags behind); the knapsack's table over these prices bounds from above what any filling of any room is
    worth. Each round goes through the lengths, longest first, and fills a container around each that lags with the
    uncovered lengths that are worth most beside it; a filling that is worth less than 1 - eps of the best is put off
    until prices have moved. Where rounds hardly cover anything more at time 1, eps grows,
    so that every length is covered in the end.

    uses: configuration -> how often, in shares of a container where items are few; bound: no packing needs fewer containers (the
    greatest that any round's prices show by duality).
    """

    def __init__(self, histogram: dict[int, int], capacity: int, step: float = 0.05, rate: float = 2.0, eps: float = 0.003, fine: int = 16, spare: float = 1.2) -> None:
        self.capacity = capacity
        self.sizes = np.array(sorted(x for x, k in histogram.items() if k > 0), np.int64)
        count = np.array([histogram[int(x)] for x in self.sizes], np.int64)
        self.uses: dict[tuple[tuple[int, int], ...], float] = {}
        self.bound = 0.0
        if not len(self.sizes):
            return
        self.bound = float((self.sizes * count).sum() / capacity)
        scale = max(1, math.ceil(fine / float(np.median(count))))  # so fine are the shares
        need, covered, t = count * scale, np.zeros(len(count), np.int64), 0.0
        while (covered < need).any():
            t = min(1.0, t + step)
            price = (self.sizes / capacity) ** spare * np.exp(rate * np.clip(t - covered / need, 0, 1))
            value = np.zeros(capacity + 1)
            value[self.sizes] = price
            best = knapsack(value, capacity)
            self.bound = max(self.bound, float((price * count).sum() / best[capacity]))
            before = covered.copy()
            due = np.ceil(t * need - 1e-9).astype(np.int64)
            gap = need - covered
            for i in range(len(gap) - 1, -1, -1):
                while covered[i] < due[i] and (config := self._around(i, gap, price, best, (1 - eps) * best[capacity])):
                    amount = min(max(1, int(due[i] - covered[i]) // config[i]), *(int(gap[y]) // a for y, a in config.items()))
                    key = tuple(sorted((int(self.sizes[y]), a) for y, a in config.items()))
                    self.uses[key] = self.uses.get(key, 0.0) + amount / scale
                    for y, a in config.items():
                        gap[y] -= a * amount
                        covered[y] += a * amount
            if t == 1 and ((covered - before) * self.sizes).sum() < 0.05 * ((need - before) * self.sizes).sum():
                eps *= 1.5

    def _around(self, i: int, gap: np.ndarray, price: np.ndarray, best: np.ndarray, least: float) -> dict[int, int] | None:
        """A filling around length i (places of lengths -> items) of those with a gap, worth at least so much, or None."""
        config, worth, room = {i: 1}, float(price[i]), self.capacity - int(self.sizes[i])
        spent = [i] if gap[i] <= 1 else []
        while room > 0 and (end := int(np.searchsorted(self.sizes, room, "right"))):
            may = np.where(gap[:end] > 0, price[:end] + best[room - self.sizes[:end]], -1.0)
            may[[y for y in spent if y < end]] = -1.0
            k = int(may.argmax())
            if may[k] < 0 or worth + may[k] < least:
                break
            config[k] = config.get(k, 0) + 1
            if config[k] >= gap[k]:
                spent.append(k)
            worth, room = worth + float(price[k]), room - int(self.sizes[k])
        return config if worth >= least else None


class _Stock:
    """What is left of each length while containers are filled."""

    def __init__(self, histogram: dict[int, int]) -> None:
        self.left = {x: k for x, k in histogram.items() if k > 0}
        self.order = sorted(self.left)

    def longest(self, most: int, taken: dict[int, int]) -> int:
        """The greatest length up to `most` of which more are left than taken, or 0."""
        i = bisect_right(self.order, most) - 1
        while i >= 0 and self.left[self.order[i]] <= taken.get(self.order[i], 0):
            i -= 1
        return self.order[i] if i >= 0 else 0

    def top_up(self, config: dict[int, int], room: int) -> dict[int, int]:
        while room > 0 and (x := self.longest(room, config)):
            a = min(self.left[x] - config.get(x, 0), room // x)
            config[x] = config.get(x, 0) + a
            room -= a * x
        return config

    def copies(self, config: dict[int, int]) -> int:
        return min(self.left.get(x, 0) // a for x, a in config.items())

    def use(self, config: dict[int, int], k: int) -> tuple[int, dict[int, int]]:
        for x, a in config.items():
            self.left[x] -= a * k
            if not self.left[x]:
                del self.left[x]
                self.order.pop(bisect_right(self.order, x) - 1)
        return k, config


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, dict[int, int]]], dict[str, float]]:
    """(containers, figures): containers are (how many, configuration) and hold every item of the histogram; figures has the bound,
    the program's value, and how many containers come from it.

    Rounding: configurations go by in order, and shares of a container are carried from one to the next, so that as
    many whole containers come out. One whose items have run out gets the next shorter ones, and what room is left is
    filled with the longest that fit. Items beyond the last whole container are packed longest first.
    """
    program, stock = Program(histogram, capacity), _Stock(histogram)
    out: list[tuple[int, dict[int, int]]] = []
    carried = 0.0
    for key, share in sorted(program.uses.items(), key=lambda u: u[0][::-1], reverse=True):
        carried += share
        k = int(carried + 1e-9)
        carried -= k
        whole = min(k, stock.copies(dict(key)))
        if whole:
            out.append(stock.use(dict(key), whole))
        for _ in range(k - whole):
            config: dict[int, int] = {}
            for x, a in reversed(key):
                for _ in range(a):
                    y = stock.longest(x, config)
                    if y:
                        config[y] = config.get(y, 0) + 1
            config = stock.top_up(config, capacity - sum(x * a for x, a in config.items()))
            if config:
                out.append(stock.use(config, 1))
    made = sum(k for k, _ in out)
    while stock.order:
        config = stock.top_up({}, capacity)
        out.append(stock.use(config, stock.copies(config)))
    return out, {"bound": program.bound, "program": sum(program.uses.values()), "from_program": made, "containers": sum(k for k, _ in out)}


def _place(intervals: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 4))
            container = np.empty(len(length), np.int64)
            for x in np.unique(length):
                mine = length == x
                starts, first, per = intervals[int(x)]
                k = np.searchsorted(starts, rank[mine], "right") - 1
                container[mine] = first[k] + (rank[mine] - starts[k]) // per[k]
            yield pa.RecordBatch.from_arrays([pa.array(container), *(batch.column(i) for i in range(4))], names=["container_id", "doc_id", "piece", "tok_start", "n_tokens"])

    return run


def pack(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """(container_id, doc_id, piece, tok_start, n_tokens) of items (doc_id, n_tokens).

    Items longer than the capacity are cut into full pieces, each a container of its own, and a rest; no other
    item is cut. Containers are numbered from 0 and none holds more than the capacity. Items of no length or a null
    length are in no container; rows that stand twice are packed twice; an empty table gives an empty result.
    """
    whole = items.filter("n_tokens > 0").withColumn("n_tokens", F.col("n_tokens").cast("long"))
    cut = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / capacity)), lambda i: F.struct(i.cast("int").alias("piece"), (i * capacity).alias("tok_start"), F.least(F.lit(capacity), F.col("n_tokens") - i * capacity).alias("n_tokens")))
    pieces = whole.select("doc_id", F.explode(cut).alias("p")).select("doc_id", "p.*")
    pieces = materialize(pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(256)).cast("int")), "pieces")
    counts = materialize(pieces.groupBy(F.col("n_tokens"), "salt").agg(F.count(F.lit(1)).alias("k")), "counts")
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("n_tokens").agg(F.sum("k")).collect()}
    intervals: dict[int, list[tuple[int, int, int]]] = {}
    done: dict[int, int] = {}
    container = 0
    for k, config in plan(histogram, capacity)[0]:
        for x, a in config.items():
            intervals.setdefault(x, []).append((done.get(x, 0), container, a))
            done[x] = done.get(x, 0) + a * k
        container += k
    arrays = {x: tuple(np.array(c, np.int64) for c in zip(*rows)) for x, rows in intervals.items()}
    before = counts.withColumn("before", F.sum("k").over(Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("n_tokens", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece", "tok_start")) - 1
    ranked = pieces.withColumn("own", own).join(before, ["n_tokens", "salt"]).select("doc_id", "piece", "tok_start", "n_tokens", (F.col("before") + F.col("own")).cast("long").alias("rank"))
    return ranked.mapInArrow(_place(arrays), "container_id long, doc_id long, piece int, tok_start long, n_tokens long")
