import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from volseg.llm import percentiles as P
from volseg.storage import Scratch

WANTED = [0.0, 0.5, 25.0, 50.0, 90.5, 99.9, 100.0]


def data(spark, n=4000):
    r = random.Random(5)
    rows = []
    for _ in range(n):
        g = r.choice(["a", "a", "a", "b", None, "c"])
        v = r.choice([None, float("nan"), float("inf"), -float("inf"), -1.0, -1.0, 0.0, -0.0, r.gauss(0, 100), r.random() * 1e-7])
        rows.append((g, r.choice([1, 1, 1, 2, 3]), v, "start", 7))
    rows.append(("lonely", 1, None, "x", 1))
    return rows, spark.createDataFrame(rows, "g string, d int, x double, start string, total int").repartition(7)


def test_exact_against_numpy(spark):
    rows, df = data(spark)
    ranks = P.ranked(P.counted(df, ["g"], "x"), ["g"], Scratch(spark, "t"))
    got = {(r.g, r.percentile): (r.n_values, r.value) for r in P.percentiles(ranks, ["g"], WANTED).collect()}
    groups = defaultdict(list)
    for g, _, x, *_ in rows:
        if x is not None and np.isfinite(x):
            groups[g].append(x)
    assert {k for k, _ in got} == set(groups)
    for g, vals in groups.items():
        for p in WANTED:
            assert got[(g, p)][0] == len(vals)
            assert np.isclose(got[(g, p)][1], np.percentile(vals, p), rtol=1e-12, atol=1e-12)


def test_empty_and_constant(spark):
    _, df = data(spark, 10)
    none = P.ranked(P.counted(df.limit(0), ["g"], "x"), ["g"], Scratch(spark, "t"))
    assert P.percentiles(none, ["g"], WANTED).collect() == []
    same = spark.createDataFrame([("k", 2.5)] * 500, "g string, x double")
    got = P.percentiles(P.ranked(P.counted(same, ["g"], "x"), ["g"], Scratch(spark, "t")), ["g"], WANTED).collect()
    assert len(got) == len(WANTED) and all(r.value == 2.5 and r.n_values == 500 for r in got)


def test_merged_days_stay_within_the_bound(spark):
    rows, df = data(spark, 6000)
    scratch = Scratch(spark, "t")
    summary = P.summaries(P.ranked(P.counted(df.where("g is not null"), ["g", "d"], "x"), ["g", "d"], scratch), ["g", "d"], 0.05)
    assert summary.count() < df.count() / 4
    got = P.span_percentiles(scratch.save(summary), ["g", "d"], ["g"], WANTED).collect()
    assert len(got) == 3 * len(WANTED)
    for r in got:
        vals = np.sort([x for g, _, x, *_ in rows if g == r.g and x is not None and np.isfinite(x)])
        assert r.n_values == len(vals) and r.rank_error <= 0.05 * len(vals)
        want = int(r.percentile / 100 * (len(vals) - 1))
        lo, hi = np.searchsorted(vals, r.value, "left"), np.searchsorted(vals, r.value, "right") - 1
        assert lo - r.rank_error <= want <= hi + r.rank_error
    assert df.agg(F.count("*")).first()[0] == len(rows)
