import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from volseg.operators import selection as S
from volseg.storage import Scratch


@pytest.fixture(params=[1 << 16, 3], ids=["production steps", "few steps"])
def steps(request, monkeypatch):
    monkeypatch.setattr(S, "STEPS", request.param)


def test_frequent_values(spark, steps):
    r = random.Random(1)
    ends = [-(1 << 63), (1 << 63) - 1, 1 << 60, (1 << 60) + 1]
    rows = [("a", r.choice([1, 1, 1, 2, -5, None, *ends, r.randint(-(1 << 62), 1 << 62)])) for _ in range(2000)] + [("b", None)] * 5 + [("c", 9), (None, 1)]
    df = spark.createDataFrame([(k, v, "n", 1) for k, v in rows], "key string, value bigint, v string, n int")
    totals = df.groupBy("key").agg(F.count(F.lit(1)).alias("total"))
    got = {tuple(x) for x in S.frequent_values(df, "key", "value", totals, 3, Scratch(spark, "t")).collect()}
    total, c = Counter(k for k, _ in rows), Counter(rows)
    assert got == {(k, v, n) for (k, v), n in c.items() if k and v is not None and 100 * n >= 3 * total[k]}
    assert S.frequent_values(df.limit(0), "key", "value", totals.limit(0), 3, Scratch(spark, "t")).collect() == []


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([("k", i if i > 3 else 1) for i in range(1, 101)], "key string, value bigint")
    totals = df.groupBy("key").agg(F.count(F.lit(1)).alias("total"))
    assert [tuple(x) for x in S.frequent_values(df, "key", "value", totals, 3, Scratch(spark, "t")).collect()] == [("k", 1, 3)]


def test_double_quantiles_per_key_and_merging(spark, steps):
    r = random.Random(2)
    rows = [(r.choice([1, 1, 1, 1, 2, 3]), r.choice([0.0, -0.0, -1.0, r.gauss(0, 1e3), r.random() * 1e-9, 1e300, -1.7e308, 1.7e308, 5e-324, 1e-323])) for _ in range(800)]
    df = spark.createDataFrame(rows, "key int, value double").withColumn("value", F.col("value") + F.lit(0.0))
    scratch = Scratch(spark, "t")
    a, b = df.where("value < 10"), df.where("value >= 10")
    hist = scratch.save(S.merge_histograms(S.histogram(a, ["key"], "value"), S.histogram(b, ["key"], "value")))
    got = S.select_ranks(hist, S.quantile_targets(S.key_ranges(hist, ["key"]), ["key"], [0.0, 0.25, 0.5, 1.0]), ["key"], scratch)
    got = {(k, q): (x, n) for k, q, x, n in got.select("key", "target", "v", "n").collect()}
    for k in (1, 2, 3):
        vals = sorted(x for kk, x in rows if kk == k)
        for q in (0.0, 0.25, 0.5, 1.0):
            x = vals[int(q * (len(vals) - 1))]
            assert got[(k, q)] == (x, vals.count(x))


def test_ranks_outside_and_shuffled_keys(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 4)
    df = spark.createDataFrame([(i % 50, (i * 7919) % 1000) for i in range(2000)] + [(99, i) for i in range(3000)], "key int, value bigint")
    scratch = Scratch(spark, "t")
    hist = scratch.save(S.histogram(df, ["key"], "value"))
    targets = spark.createDataFrame([(k, "t", r) for k in [*range(50), 99] for r in (-1, 0, 20, 2999, 3000)], "key int, target string, rank bigint")
    want = {}
    for k, v in df.collect():
        want.setdefault(k, []).append(v)
    exact = {(k, r): sorted(v)[r] for k, v in want.items() for r in (0, 20, 2999) if r < len(v)}
    assert {(x.key, x.rank): x.v for x in S.select_ranks(hist, targets, ["key"], scratch).collect()} == exact
