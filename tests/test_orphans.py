import datetime as dt
import random

from pyspark.sql import functions as F

from folioforge.operators.orphans import find_orphans, records_by_key

REFS = "src_table string, src_row long, kind string, key string, period string, reason string, _kind string"
RECORDS = "id string, ark string, loaded_at timestamp, deleted boolean"


def run(spark, refs, records, **kw):
    r = spark.createDataFrame([(*x, "clash", "clash") for x in refs], REFS)
    k = records_by_key(spark.createDataFrame(records, RECORDS))
    cases, report = find_orphans(r, k, **kw)
    return {(x.src_table, x.src_row, x.ref, x.period): x.reason for x in cases.collect()}, report


def day(m, d=1):
    return dt.datetime(2025, m, d)


def test_missing_deleted_later(spark):
    records = [("1", "a1", day(3), False), ("1", "a1", day(2), False), ("2", "a2", day(1), False), ("2", None, day(5), True), (None, "a3", day(1), False), ("4", "a4", None, False)]
    refs = [
        ("t", 1, "ark", "a1", "2025-01"), ("t", 2, "ark", "a1", "2025-02"), ("t", 3, "id", "2", "2025-09"), ("t", 4, "ark", "a2", "2025-09"), ("t", 5, "ark", "a3", "2025-01"), ("t", 6, "id", "9", "2025-01"),
        ("t", 7, "id", None, "2025-01"), ("t", 8, "id", "1", None), ("t", 9, "id", "9", None), ("t", 6, "id", "9", "2025-01"), ("t", 10, "id", "4", "2025-01"),
    ]
    cases, report = run(spark, refs, records)
    assert cases == {("t", 1, "a1", "2025-01"): "later", ("t", 3, "2", "2025-09"): "deleted", ("t", 4, "a2", "2025-09"): "deleted", ("t", 6, "9", "2025-01"): "missing", ("t", 9, "9", None): "missing"}
    assert sum(r.n for r in report.collect()) == 5


def test_hot_keys_give_what_the_others_do(spark):
    rng = random.Random(1)
    keys = ["hot"] * 4000 + [f"k{i}" for i in range(300)]
    refs = [("t", i, "id", rng.choice(keys), f"2025-0{rng.randint(1, 9)}") for i in range(20_000)]
    records = [("hot", None, day(5), False)] + [(f"k{i}", None, day(rng.randint(1, 9)), i % 7 == 0) for i in range(0, 300, 2)]
    first = {r[0]: (f"{r[2]:%Y-%m}", r[3]) for r in records}
    want = {(t, i, k, p) for t, i, _, k, p in refs if k not in first or first[k][1] or first[k][0] > p}
    cases, _ = run(spark, refs, records, heavy_share=8)
    assert set(cases) == want


def test_empty(spark):
    cases, report = run(spark, [], [])
    assert cases == {} and report.count() == 0


def test_heavy_pairs_are_bounded(spark):
    """No more than heavy_share pairs can each hold more than 1/heavy_share of all."""
    refs = spark.range(5000).select(F.lit("t").alias("src_table"), F.col("id").alias("src_row"), F.lit("id").alias("kind"), (F.col("id") % 3).cast("string").alias("key"), F.lit("2025-01").alias("period"))
    cases, _ = find_orphans(refs, records_by_key(spark.createDataFrame([], RECORDS)), heavy_share=2)
    assert cases.count() == 5000
