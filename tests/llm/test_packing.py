import itertools
import math

import numpy as np
import pytest

from folioforge.llm import packing as P


def brute_bins(lengths, capacity):
    """Fewest containers, by trying."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity and bins[k] not in bins[:k]:
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


def histogram(lengths):
    return {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}


def check(plan, hist, capacity):
    held = {}
    for k, config in plan:
        assert sum(x * a for x, a in config.items()) <= capacity
        for x, a in config.items():
            held[x] = held.get(x, 0) + a * k
    assert held == hist
    return sum(k for k, _ in plan)


def test_knapsack_against_all_fillings():
    rng = np.random.default_rng(1)
    for _ in range(40):
        value = np.concatenate([[0], rng.integers(0, 9, 12)]).astype(float)
        best = P.knapsack(value, 12)
        want = max(sum(value[x] for x in c) for n in range(13) for c in itertools.combinations_with_replacement(range(1, 13), n) if sum(c) <= 12)
        assert best[12] == want


def test_small_cases_are_near_the_best():
    rng = np.random.default_rng(2)
    for _ in range(25):
        lengths = sorted(rng.integers(1, 20, 9).tolist(), reverse=True)
        assert check(P.plan(histogram(lengths), 20)[0], histogram(lengths), 20) <= brute_bins(lengths, 20) + 1


@pytest.mark.parametrize("low,high,slack", [(500, 1100, 1.06), (1, 2048, 1.01), (300, 900, 1.02)])
def test_large_cases_are_near_the_bound(low, high, slack):
    lengths = np.random.default_rng(3).integers(low, high, 20_000)
    used = check(P.plan(histogram(lengths), 2048)[0], histogram(lengths), 2048)
    assert used <= slack * math.ceil(lengths.sum() / 2048)


@pytest.mark.parametrize("times", [1, 1000])
@pytest.mark.parametrize("low,high,slack", [(1, 2048, 1.002), (500, 1100, 1.06), (300, 900, 1.02)])
def test_the_program_is_solved(low, high, slack, times):
    """All mass is covered by configurations, the containers come from them, and they are near the program's bound."""
    hist = {x: 10 * times for x in range(low, high + 1)}
    program = P.Program(hist, 2048)
    covered = {}
    for key, share in program.uses.items():
        assert sum(x * a for x, a in key) <= 2048
        for x, a in key:
            covered[x] = covered.get(x, 0.0) + a * share
    mass = sum(min(covered.get(x, 0.0), k) * x for x, k in hist.items())
    assert mass >= 0.999 * sum(x * k for x, k in hist.items())
    out, figures = P.plan(hist, 2048)
    used = check(out, hist, 2048)
    assert used == figures["containers"] and figures["from_program"] >= 0.98 * used
    assert math.ceil(sum(x * k for x, k in hist.items()) / 2048) <= math.ceil(figures["bound"] - 1e-6) <= used <= slack * figures["bound"] + 1


def test_items_are_placed_whole(spark):
    rows = [(1, 5), (2, 10), (3, 23), (4, 0), (5, None), (6, 10), (6, 10), (None, 3), (7, 1_000_003)] + [(i, 7) for i in range(100, 400)]
    out = P.pack(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, n_tokens int, piece int, salt int"), capacity=10)
    got = out.collect()
    fill = {}
    for r in got:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
    assert max(fill.values()) <= 10 and set(fill) == set(range(len(fill)))
    assert sum(fill.values()) == sum(n or 0 for _, n in rows)
    assert sorted((r.piece, r.tok_start, r.n_tokens) for r in got if r.doc_id == 3) == [(0, 0, 10), (1, 10, 10), (2, 20, 3)]
    assert sum(r.doc_id == 6 for r in got) == 2 and all(r.doc_id not in (4, 5) for r in got)


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, n_tokens int")).count() == 0


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in P.token_counts(docs).collect()}
    assert got[1] == 2 and got[2] == 0 and got[4] > 1 and 3 not in got
