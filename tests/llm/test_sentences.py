import random

import pytest

from folioforge.llm import sentences as S
from folioforge.sources.tables import table

EN = ["Mr. A. B. Smith paid £3.50 in Jan. 1905.", "See fig. 2.2 and p. 35 of vol. IV.", "What a strange title!", "Did Dr. Jones see it?", "The heirs sold letters, plates, etc.", '"Stop! Who goes there?" is the first line.', "(The index is missing.)", "The story follows a binder."]
ZH = ["初版已经散佚！", "参见1887年的目录。", "编者写道：“第7页缺失。请勿出借。”", "“请把手稿还给我！我等着。”石文野在信中写道。"]
TH = ["ต้นฉบับเก็บไว้ในหอสมุด", "ชื่อเรื่องแปลกมาก", "ปกหนังสือสูง49.7เซนติเมตร"]
EL = ["Μήπως ο Δρακιρέλης ήταν ο μεταφραστής;", "Το αντίτυπο έχει 928 σ. και 5 εικ.", "Τι παράξενος τίτλος!"]


def made(rng, n):
    """Documents of known sentences: (text, units)."""
    out = []
    for _ in range(n):
        pool, sep = rng.choice([(EN, " ")] * 3 + [(ZH, ""), (TH, " "), (EL, " ")])
        text, units = "", []
        for _ in range(rng.randint(2, 5)):
            if text:
                text += "\n\n"
            for k in range(rng.randint(1, 5)):
                s = rng.choice(pool)
                text += sep if k else ""
                units.append((len(text), len(text) + len(s)))
                text += s
        out.append((text, units))
    return out


@pytest.fixture(scope="module")
def model(spark):
    texts = [(t,) for t, _ in made(random.Random(1), 400)]
    return S.train(spark.createDataFrame(texts, "text string"))


def test_held_out_boundaries(model):
    hit = got = want = 0
    for text, units in made(random.Random(2), 200):
        found = set(S.split_text(text, model))
        hit, got, want = hit + len(found & set(units)), got + len(found), want + len(units)
    assert hit / got > 0.97 and hit / want > 0.97, (hit / got, hit / want)


def test_layout(model):
    text = "§ 3. Les éditions\n\n1. A. B. Dupont. Titre. Lieu, 1900.\n— C. D. Durand, 1901, in-12, 5 p.\n\nContents\nWhat a strange title! The story follows a binder.\n \t\n"
    assert [text[s:e] for s, e in S.split_text(text, model)] == ["§ 3. Les éditions", "1. A. B. Dupont. Titre. Lieu, 1900.", "— C. D. Durand, 1901, in-12, 5 p.", "Contents", "What a strange title!", "The story follows a binder."]


def test_wrapped_lines(model):
    import textwrap

    text = textwrap.fill(" ".join(EN), 60)
    assert [" ".join(text[s:e].split()) for s, e in S.split_text(text, model)] == EN


def test_tables(spark, model):
    long = " ".join(EN * 2000)
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, " \n\t ", 0), (4, long, 0), (5, "x", 0), (5, "x", 0), (None, "y", 0), (6, "((((\"«" * 5000 + ")" * 5000, 0)], "doc_id long, text string, sent_start int")
    rows = S.sentences(docs, model).collect()
    count = lambda k: sum(r.doc_id == k for r in rows)
    assert count(4) == 16000 and count(5) == 2 and count(None) == 1 and count(1) == count(2) == count(3) == 0
    assert S.sentences(docs.limit(0)).count() == 0


def test_units_are_bare_and_apart(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    by = {}
    for r in S.sentences(docs).collect():
        by.setdefault(r.doc_id, []).append((r.sent_start, r.sent_end))
    assert set(by) == {k for k, t in texts.items() if t and t.strip()}
    for k, units in by.items():
        units.sort()
        assert all(s < e and texts[k][s:e] == texts[k][s:e].strip() for s, e in units)
        assert all(a[1] <= b[0] for a, b in zip(units, units[1:]))
        gaps = [texts[k][a:b] for a, b in zip([0, *(e for _, e in units)], [*(s for s, _ in units), len(texts[k])])]
        assert not any(g.strip() for g in gaps)


def test_posteriors_sum_over_all_choices():
    import itertools

    rng = random.Random(4)
    for _ in range(50):
        n = rng.randint(1, 6)
        chain, close = [(rng.random(), rng.random()) for _ in range(n)], [rng.random() < 0.4 for _ in range(n)]
        mass = [0.0] * n
        total = 0.0
        for choice in itertools.product((0, 1), repeat=n):
            w, before = 1.0, 0
            for (p, q), near, c in zip(chain, close, choice):
                w *= (p * (S.SHORT if near and before else 1.0)) if c else q
                before = c
            total += w
            for i, c in enumerate(choice):
                mass[i] += w * c
        assert S._posteriors(chain, close) == pytest.approx([m / total for m in mass])


@pytest.mark.parametrize("parts,sep", [(["Գիրքը տպագրվել է Երևանում։", "Հեղինակը հայտնի չէ։", "Ձեռագիրը կորել է։"], " "), (["សៀវភៅនេះត្រូវបានបោះពុម្ព។", "អ្នកនិពន្ធមិនស្គាល់។", "ទំព័រខ្លះបាត់។"], ""), (["መጽሐፉ ታተመ።", "ደራሲው አይታወቅም።"], " ")])
def test_stops_of_scripts_that_were_not_trained(model, parts, sep):
    """What is learned of stops holds for those of scripts that the documents don't have."""
    text = sep.join(parts)
    assert [text[s:e] for s, e in S.split_text(text, model)] == parts
