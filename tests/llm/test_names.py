import itertools
import random

import pytest

from folioforge.llm import names as N

SCHEMA = "key string, text string, kind string, years string, head boolean, root string, token string"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    links, groups = N.link_names(df, **kw)
    return {(r.a, r.b) for r in N.pairs_of(groups, links, 3).collect()}


def person(key, text, years=None, head=True):
    return (key, text, "person", years, head)


def brute_distance(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in "xy")
        assert N.edit_distance(a, b, 2) == min(3, brute_distance(a, b)), (a, b)


def test_optimal_assignment_against_all_orders():
    rng = random.Random(2)
    for _ in range(300):
        n, m = sorted((rng.randint(1, 4), rng.randint(1, 4)))
        cost = [[rng.choice([0.0, 0.5, 1.0, 1000.0]) for _ in range(m)] for _ in range(n)]
        want = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        total, place = N.assign(cost)
        assert total == want and len(set(place)) == n


def test_index_finds_all_neighbours(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcde") for _ in range(rng.randint(4, 10))) for _ in range(60)]
    words = set(base)
    for w in base:
        for _ in range(3):
            i = rng.randrange(len(w))
            words.add(w[:i] + rng.choice(["", "x", w[i] * 2]) + w[i + 1 :])
    want = {(a, b) for a, b in itertools.combinations(sorted(words), 2) if N.edit_distance(a, b) <= min(N.reach(a), N.reach(b))}
    got = {(r.one, r.two) for r in N.neighbours(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    assert got == want


def test_variants_are_linked(spark):
    rows = [
        person("1", "Cortuvarin Alexandrine", "1959-2036"), person("2", "Alexandrine CORTUVARIN"), person("3", "Coltuvarin, Alexandrine"), person("4", "A. Cortuvarin"), person("5", "Mme Alexandrine Сortuvarin"), person("6", "Cortuvarin Simon"),
        person("7", "de Perlafimier Judith", "1831-1910"), person("8", "Perlafimier, Judith", "1776-1861"), person("9", "Perlafimier Judith", "18..-1910"), person("10", "Cortuvarin"), person("11", None), person(None, "Cortuvarin Simon"), person("12", " \t"),
        ("20", "Académie botanique de Gergabobert", "body", None, True), ("21", "Acad. bot. de Gergabobert", "body", None, True), ("22", "Gergabobert. Académie botanique", "body", None, True), ("23", "Musée botanique de Gergabobert", "body", None, True), ("24", "BOTANIQUE DE GERGABOBERT (ACADEMIE)", "body", None, True),
        ("25", "Cortuvarin Simon", "body", None, True), ("6", "Cortuvarin Simon", "person", None, True),
    ]
    got = run(spark, rows)
    together = [{"1", "2", "3", "4", "5"}, {"7", "9"}, {"20", "21", "22", "24"}]
    assert got == {p for g in together for p in itertools.combinations(sorted(g), 2)}


def test_bynames_are_learned(spark):
    rows = []
    for i, s in enumerate(("Tourjagavert", "Belnetier", "Corpignet")):
        rows += [person(f"h{i}", f"{s} Charlotte"), person(f"h{i}", f"{s} Lolotte", None, False)]
    rows += [person("x", "Ralpemont Charlotte"), person("y", "Ralpemont Lolotte"), person("z", "Ralpemont Odile")]
    assert run(spark, rows) == {("x", "y")}


def test_common_names(spark):
    """A surname of more keys than `common` is filed with the other tokens of the name."""
    rows = [person(f"k{i:03}", f"Martin {n}") for i, n in enumerate(["Paule", "Jacques", "Firmin", "Octave"] * 10)] + [person(f"o{i:03}", f"{a} {n}") for i, (a, n) in enumerate(itertools.product(["Bruvot", "Castel"], ["Paule", "Jacques", "Firmin", "Octave"]))]
    got = run(spark, rows, common=5)
    assert {p for p in got if p[0][0] == p[1][0] == "k"} == {(f"k{i:03}", f"k{j:03}") for i in range(40) for j in range(i + 1, 40) if i % 4 == j % 4}


def test_empty_and_repeated(spark):
    assert run(spark, []) == set()
    assert run(spark, [person("a", "Durand Paul")] * 3 + [person("b", "Durand Paul")] * 2) == {("a", "b")}
    assert run(spark, [person("a", "Durand " + "x" * 100_000), person("b", "...")]) == set()


@pytest.mark.parametrize("a,b,same", [("Marie-Louise Sernarubois", "Mraie-Louise Sernarubois", True), ("Marielouise Lorbanelier", "Marie-Louise Lorbanelier", True), ("Jean Noel", "Jean Noelle", True), ("Paul X", "Pierre X", False)])
def test_pairs_of_names(a, b, same):
    assert N.Matcher({}).same([N.name_tokens(a)], [N.name_tokens(b)]) is same


def test_names_of_common_tokens(spark):
    """Names of which all tokens are common meet under misprints, initials and bynames; a vague initial links none."""
    rows = [person(f"k{i:03}", f"{s} {n}") for i, (s, n) in enumerate(itertools.product(["Martin", "Durand", "Lefort"], ["Jeanne", "Octave", "Firmin", "Paule"] * 3))]
    rows += [person("x1", "Martin Jaenne"), person("x2", "Martni Octave"), person("x3", "Durand F."), person("x4", "Lefort Oct.")]
    rows += [person("y1", "Durand Olivier"), person("y2", "Durand O.")]
    got = run(spark, rows, common=5)
    of = lambda k: {dict(zip(rows_by, (r[1] for r in rows))).get(p) for pair in got if k in pair for p in pair if p != k}
    rows_by = [r[0] for r in rows]
    assert of("x1") == {"Martin Jeanne"} and of("x2") == {"Martin Octave"}
    assert of("x3") == {"Durand Firmin"} and of("x4") == {"Lefort Octave"}
    assert of("y2") == set()


def test_short_tokens_and_blocks(spark):
    """Names of short tokens only meet in any order; large files are met in blocks; headings may be one word on one side."""
    rows = [person("a", "Li Wu"), person("b", "Wu, Li"), person("c", "Li Wo"), person("d", "Poe Max"), person("e", "Max Poe")]
    rows += [person(f"k{i:02}", "Ralpemont Odile") for i in range(25)] + [person("v1", "Vandamme Odile"), person("v2", "Van Damme Odile")]
    got = run(spark, rows, common=5, block=4)
    want = {("a", "b"), ("d", "e"), ("v1", "v2")} | set(itertools.combinations([f"k{i:02}" for i in range(25)], 2))
    assert got == want


@pytest.mark.parametrize("common", [2, 1000])
def test_candidates_against_brute_force(spark, common):
    """Whatever files names meet under, every pair that agrees in full is linked."""
    rng = random.Random(5)
    first, last = ["Jeanne", "Octave", "Firmin", "Marie", "Louise"], ["Martin", "Durandeau", "Lefort", "Li", "Delavigne"]
    rows = []
    for i in range(60):
        name = [*rng.sample(first, rng.choice([1, 1, 2])), rng.choice(last)]
        j = rng.randrange(len(name))
        w = name[j]
        at = rng.randrange(len(w) - 1)
        if len(w) > 4 and rng.random() < 0.5:
            name[j] = rng.choice([w[:at] + w[at + 1 :], w[:at] + w[at + 1] + w[at] + w[at + 2 :], w[:at] + "x" + w[at:]])
        rng.shuffle(name)
        rows.append(person(f"k{i:02}", " ".join(name)))
    names = {r[0]: N.name_tokens(r[1]) for r in rows}
    held = {}
    for tokens in names.values():
        for t in set(tokens):
            held[t] = held.get(t, 0) + 1
    matcher = N.Matcher({t: (n, frozenset()) for t, n in held.items()})
    want = {(a, b) for a, b in itertools.combinations(sorted(names), 2) if matcher.grade(N.Named([names[a]]), N.Named([names[b]])) == 0}
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    links, groups = N.link_names(df, common=common)
    assert want <= {(r.a, r.b) for r in links.collect()}


def test_tables_of_names_are_not_broadcast(spark):
    """Whatever Spark takes their files for, only the list of large files may go through the driver."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    before = store.executionsCount()
    rows = [person(f"k{i:02}", f"{s} {n}") for i, (s, n) in enumerate(itertools.product(["Ralpemont", "Ralpement", "Vandamme"], ["Odile", "Octave", "O."]))]
    assert ("k00", "k03") in run(spark, rows)
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    ran = store.executionsList()
    plans = [ran.apply(i).physicalPlanDescription() for i in range(before, ran.size())]
    assert sum("SortMergeJoin" in p for p in plans) > 5
    assert sum("BroadcastExchange" in p for p in plans) <= 1
