import random

import pytest

from folioforge.llm import leakage as L

RNG = random.Random(11)
SYLLABLES = "ba co di fu gre hal jo kri lu mon ner pas que ral sto tir vul zen".split()


def words(n, rng=RNG):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]


ITEM = words(60)
ITEM[29] += "."


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    return {(r.doc_id, r.item_id) for r in L.find_leaks(d, i, **kw).collect()}


def misprint(w):
    k = len(w) // 2
    return w[:k] + "x" + w[k:] if len(w) > 3 else w


CASES = {
    "whole": ITEM, "twenty words": ITEM[5:25], "upper case": [w.upper() for w in ITEM[:30]], "accents": [w.replace("a", "á").replace("o", "ô") for w in ITEM[:30]], "full width": ["".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalpha() else c for c in w) for w in ITEM[:30]],
    "misprints": [misprint(w) if i % 7 == 3 else w for i, w in enumerate(ITEM[:40])], "stray words": [x for i, w in enumerate(ITEM[:40]) for x in ([w, "certes"] if i % 9 == 4 else [w])], "missing words": [w for i, w in enumerate(ITEM[:40]) if i % 11 != 5],
    "sentences apart": [*ITEM[18:30], *words(30), *ITEM[30:42]], "punctuation": [w + ";" for w in ITEM[:25]],
}
NONE = {"nineteen words": ITEM[5:24], "twelve": ITEM[:12], "apart within a sentence": [*ITEM[5:16], *words(30), *ITEM[16:27]], "other names": [w if i % 3 else "".join(words(2)) for i, w in enumerate(ITEM[:40])], "nothing": words(100)}


@pytest.mark.parametrize("cases,hit", [(CASES, True), (NONE, False)])
def test_cases(spark, cases, hit):
    docs = [(i, " ".join([*words(15), *c, *words(15)])) for i, c in enumerate(cases.values())]
    got = run(spark, docs, [(1, " ".join(ITEM)), (2, " ".join(words(60)))])
    assert got == ({(i, 1) for i in range(len(docs))} if hit else set()), list(cases)


def test_line_breaks(spark):
    text = "\n".join(" ".join(ITEM[i : i + 6]) for i in range(0, 42, 6))
    broken = text[:100] + text[100:].replace(ITEM[30], ITEM[30][:2] + "-\n" + ITEM[30][2:])
    assert run(spark, [(1, text), (2, broken)], [(1, " ".join(ITEM))]) == {(1, 1), (2, 1)}


def test_set_formulas_do_not_count(spark):
    formula = words(12)
    items = [(i, " ".join([*words(30), *formula])) for i in range(20)]
    own = items[0][1].split()
    docs = [(1, " ".join([*words(9), *formula, *words(9)])), (2, " ".join(own[-24:])), (3, " ".join(own[:30]))]
    assert run(spark, docs, items) == {(3, 0)}


def test_short_item_whole(spark):
    assert run(spark, [(1, " ".join([*words(5), *ITEM[:12], *words(5)]))], [(1, " ".join(ITEM[:12]))]) == {(1, 1)}


def test_blocks_give_what_one_search_does(spark):
    items = [(i, " ".join(words(40))) for i in range(12)]
    docs = [(i, " ".join([*words(5), *t.split()[3:28], *words(5)])) for i, t in items]
    assert run(spark, docs, items, block_words=90) == run(spark, docs, items) == {(i, i) for i in range(12)}


def test_nulls_repeats_and_long_documents(spark):
    passage = " ".join(ITEM[:30])
    docs = [(1, None), (2, ""), (3, "  "), (4, passage), (4, passage), (5, (passage + " " + " ".join(words(20)) + " ") * 400), (None, passage)]
    assert run(spark, docs, [(1, " ".join(ITEM)), (1, " ".join(ITEM)), (2, None), (None, passage), (3, "")]) == {(4, 1), (5, 1), (None, 1)}
    assert run(spark, [], [(1, passage)]) == set() and run(spark, docs, []) == set()


def test_few_seeds(spark):
    """Sentences apart and runs with many misprints hold few seeds; they count as words do."""
    item = [w + "." if i in (6, 13, 20) else w for i, w in enumerate(words(40))]
    item = [w if len(w) > 3 else w + "taro" for w in item]
    apart = [*item[:7], *words(30), *item[7:14], *words(30), *item[14:21]]
    every_fourth = [misprint(w) if i % 4 == 3 else w for i, w in enumerate(item[:20])]
    docs = [(i, " ".join([*words(15), *c, *words(15)])) for i, c in enumerate((apart, every_fourth))]
    assert run(spark, docs, [(1, " ".join(item))]) == {(0, 1), (1, 1)}


def test_few_tokens_and_unspaced_scripts(spark):
    chinese = "本書は明治時代の文学を研究した論文集であり、著者は東京の出身である。初版は千九百二十年に刊行された。"
    items = [(1, "Quatre mots fort rares"), (2, chinese), (3, "Mot"), (4, "...")]
    docs = [
        (1, "Il y a quatre mots fort rares ici."), (2, "quatre mots rares fort"), (3, "前書き。" + chinese + "次の章。"), (4, "論文集であり、東京の"), (5, "un MOT."), (6, chinese.replace("文学", "哲学")), (7, "ไม่มี " * 9),
    ]
    assert run(spark, docs, items) == {(1, 1), (3, 2), (5, 3), (6, 2)}


def test_recall_by_rate_of_misprints():
    """Passages of 25 words with misprints in a given share of them, by the alignment itself: what must be found is."""
    rng = random.Random(4)
    found = {}
    for rate in (0.0, 0.1, 0.2, 0.3):
        n = 0
        for _ in range(60):
            item = words(60, rng)
            at = rng.randrange(35)
            passage = [misprint(w) if rng.random() < rate else w for w in item[at : at + 25]]
            it = L.Item(1, " ".join(item))
            index = L.Index([it])
            doc = L._TOKEN.findall(L.plain(" ".join([*words(20, rng), *passage, *words(20, rng)])))
            ids = L.np.array([index.ids.get(t, 0) for t in doc], L.np.uint64)
            hits = index.hits(ids, L.np.array([0])).get((0, 0), set())
            n += bool(hits) and L.longest_run(doc, it, hits)[0] >= 20
        found[rate] = n / 60
    assert found[0.0] == 1 and found[0.1] >= 0.98 and found[0.2] >= 0.95 and found[0.3] >= 0.95, found


def test_leaving_early_changes_nothing():
    """Pairs that are left before their runs are put together could not have been reported."""
    rng = random.Random(8)
    for _ in range(150):
        item = words(40, rng)
        at, n = rng.randrange(15), rng.randint(14, 24)
        passage = [w for w in item[at : at + n] if rng.random() > 0.08]
        it = L.Item(1, " ".join(item))
        it.formula[rng.randrange(40) :][:4] = True
        doc = L._TOKEN.findall(L.plain(" ".join([*words(8, rng), *passage, *words(8, rng)])))
        index = L.Index([it])
        hits = index.hits(L.np.array([index.ids.get(t, 0) for t in doc], L.np.uint64), L.np.array([0])).get((0, 0), set())
        full, short = L.longest_run(doc, it, hits), L.longest_run(doc, it, hits, words=20, whole=0.9)
        assert (full[0] >= 20 or full[1] >= 0.9) == (short[0] >= 20 or short[1] >= 0.9)
