import unicodedata

import pytest
from pyspark.sql import functions as F

from folioforge.llm.confusables import canonical_texts, same_look

SAME = [
    ("été", "été"), ("Ｌｅｓ ａｂ", "Les ab"), ("сесrets", "cecrets"), ("a​b­c⁠﻿", "abc"), ("a　b c d", "a b c d"), ("ﬁn", "fin"), ("е́té", "été"), ("ѐ", "è"), ("x‍́", "x́"), ("𝐁𝑖ble", "Bible"), ("Сказки", "Cкaзки"), ("a…", "a..."),
]
OTHER = [("Lettres", "lettres"), ("été", "ete"), ("les", "le"), ("a-b", "a b"), ("a b", "ab"), ("x²", "x2"), ("d'été", "d été")]


def canon(spark, *texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "i int, t string, c0 string")
    return [r.out for r in canonical_texts(df, {"t": "out"}).orderBy("i").collect()]


def test_what_looks_the_same(spark):
    out = canon(spark, *[t for pair in SAME for t in pair])
    assert all(a == b for a, b in zip(out[::2], out[1::2])), list(zip(SAME, out[::2], out[1::2]))


def test_what_looks_different(spark):
    out = canon(spark, *[t for pair in OTHER for t in pair])
    assert all(a != b for a, b in zip(out[::2], out[1::2]))


def test_canonical_texts_are_their_own_form(spark):
    once = canon(spark, *[t for pair in SAME + OTHER for t in pair])
    assert canon(spark, *once) == once
    assert all(unicodedata.is_normalized("NFC", t) for t in once)


def test_null_empty_long(spark):
    assert canon(spark, None, "", " ", "​", "é" * 1_000_000) == [None, "", "", "", "é" * 1_000_000]


def test_pairs(spark):
    schema = "k int, a string, b string, _left0 string"
    df = spark.createDataFrame([(1, "é", "é", "x"), (2, "a", "a", "x"), (3, None, "a", "x"), (4, "a", "b", "x"), (5, "é", "é", "x"), (5, "é", "é", "x")], schema)
    out = same_look(df, "a", "b")
    assert out.columns == df.columns and sorted(r.k for r in out.collect()) == [1, 5, 5]
    assert same_look(df.limit(0), "a", "b").count() == 0


@pytest.mark.parametrize("kind", ["struct<x:int,y:string>", "array<string>", "timestamp", "decimal(10,2)"])
def test_other_columns_pass_through(spark, kind):
    df = spark.createDataFrame([("a",)], "t string").withColumn("other", F.lit(None).cast(kind))
    assert canonical_texts(df, {"t": "u"}).first().other is None
