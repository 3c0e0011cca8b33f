import random

import numpy as np
import pandas as pd

from volseg.operators import graph as G
from volseg.operators import kernels as K
from volseg.storage import Scratch


def brute(edges):
    sets = K.Sets()
    for a, b in edges:
        x, y = sets.find(a), sets.find(b)
        if x != y:
            sets.link(min(x, y), max(x, y))
    return {v: sets.find(v) for e in edges for v in e}


def graph(seed):
    r = random.Random(seed)
    return [(r.randint(1, 300), r.randint(1, 300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7), (9000, 9000)]


def test_stars():
    edges = graph(3)
    ids, low = G.stars(*(np.array(x) for x in zip(*edges)))
    assert dict(zip(ids.tolist(), low.tolist())) == brute(edges)


def test_labels_with_and_without_contraction(spark):
    edges = graph(6)
    df = spark.createDataFrame(edges, "s1 bigint, s2 bigint")
    want = brute(edges)
    spread = df.repartition(7).unionByName(spark.createDataFrame([(None, 5), (5, None)], "s1 bigint, s2 bigint"))
    assert {r.id: r.cc for r in G.component_labels(spread, Scratch(spark, "t")).collect()} == {5: 5} | want
    assert {r.id: r.cc for r in G.component_labels(df, Scratch(spark, "t"), contract=False).collect()} == want
    assert G.component_labels(df.limit(0), Scratch(spark, "t")).collect() == []


def test_folds(spark, monkeypatch):
    edges = graph(9)
    batches = [b for a in range(0, len(edges), 10) for b in [__import__("pyarrow").RecordBatch.from_pandas(pd.DataFrame(edges[a : a + 10], columns=["a", "b"]))]]
    monkeypatch.setattr(G, "FOLD_ROWS", 25)
    (out,) = list(G._contract(iter(batches)))
    want = brute(edges)
    assert dict(zip(*(c.to_pylist() for c in out.columns))) == {i: c for i, c in want.items() if i != c}


def test_spanning_forest_is_that_of_one_sorted_pass(spark):
    r = random.Random(8)
    edges = [(r.choice([0.25, 0.5, 0.75, r.random()]), *sorted(r.sample(range(1, 90), 2))) for _ in range(300)] + [(0.5, 500 + i, 501 + i) for i in range(20)]
    best = {}
    for w, a, b in edges:
        best[a, b] = max(w, best.get((a, b), 0))
    want = {(a, b, w) for w, a, b in K.spanning_forest([(w, a, b) for (a, b), w in best.items()])}
    df = spark.createDataFrame(edges + [(1.0, 3, 3), (1.0, None, 3)], "score double, s1 bigint, s2 bigint")
    got = [(x.s1, x.s2, x.score) for x in G.spanning_forest(df, Scratch(spark, "t")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert G.spanning_forest(df.limit(0), Scratch(spark, "t")).collect() == []


def test_kernels_see_whole_components(spark, monkeypatch):
    monkeypatch.setattr(G, "CALL_ROWS", 10)
    rows = [(c, i if i % 3 else None) for c in range(40) for i in range(c % 30 + 1)] + [(99, (1 << 60) + 1)]
    df = spark.createDataFrame(rows, "cc bigint, v bigint").repartition(5)

    def count(pdf):
        return pdf.groupby("cc").agg(n=("cc", "size"), top=("v", lambda s: max((x for x in s if x is not None), default=None))).reset_index()

    got = {r.cc: (r.n, r.top) for r in G.per_component(df, "cc", count, "cc bigint, n bigint, top bigint").collect()}
    assert got[99] == (1, (1 << 60) + 1) and got[29][0] == 30 and len(got) == 41


def test_ranges_of_ids_tied_together(spark, monkeypatch):
    monkeypatch.setattr(G, "FOLD_ROWS", 60)
    edges = graph(6)
    df = spark.createDataFrame([*edges, (None, 5), (5, None), (None, None)], "s1 bigint, s2 bigint").repartition(7)
    assert {r.id: r.cc for r in G.component_labels(df, Scratch(spark, "t")).collect()} == {5: 5} | brute(edges)


def test_a_graph_of_one_partition_takes_one_round(spark):
    r = random.Random(5)
    ids = r.sample(range(1, 9000), 600)
    df = spark.createDataFrame(list(zip(ids, ids[1:])), "s1 bigint, s2 bigint").repartition(6)
    scratch = Scratch(spark, "t")
    assert {x.cc for x in G.component_labels(df, scratch).collect()} == {min(ids)} and scratch.count <= 2
    scored = df.selectExpr("CAST(s1 % 7 AS DOUBLE) AS score", "s1", "s2")
    scratch = Scratch(spark, "t")
    assert G.spanning_forest(scored, scratch).count() == 599 and scratch.count <= 2


def test_forest_of_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(G, "FOLD_ROWS", 90)
    r = random.Random(2)
    edges = {tuple(sorted(r.sample(range(1, 120), 2))): r.choice([0.25, -0.5, float("inf"), r.random()]) for _ in range(500)}
    df = spark.createDataFrame([(w, b, a) for (a, b), w in edges.items()], "score double, s1 bigint, s2 bigint")
    want = {(a, b, w) for w, a, b in K.spanning_forest([(w, a, b) for (a, b), w in edges.items()])}
    assert {(x.s1, x.s2, x.score) for x in G.spanning_forest(df, Scratch(spark, "t")).collect()} == want
    odd = spark.createDataFrame([(None, 1, 2), (float("nan"), 1, 3), (1.0, 2, 3), (None, 3, 4)], "score double, s1 bigint, s2 bigint")
    assert sorted((x.s1, x.s2) for x in G.spanning_forest(odd, Scratch(spark, "t")).collect()) == [(1, 3), (2, 3), (3, 4)]
