import random
from dataclasses import replace

import pytest

from volseg.config import Agglomeration
from volseg.operators import agglomeration as A
from volseg.operators import kernels
from volseg.schema import CONFLICT, NONE, PROPER
from volseg.storage import Scratch

P = replace(Agglomeration(), threshold=0.3)
KINDS = ("residual", "nucleus", "semantic", "size", "twig", "final")


def groups(pairs):
    sets = kernels.Sets()
    for a, b in pairs:
        x, y = sets.find(a), sets.find(b)
        if x != y:
            sets.link(min(x, y), max(x, y))
    return {v: sets.find(v) for p in pairs for v in p}


def random_edges(seed, n=260, ids=150):
    r = random.Random(seed)
    edges = {}
    for _ in range(n):
        a, b = sorted(r.sample(range(1, ids), 2))
        k = r.randint(1, 8)
        edges[(a, b)] = (sum(r.random() for _ in range(k)), k)
    return [(a, b, s, k) for (a, b), (s, k) in edges.items()]


@pytest.mark.parametrize("most", [A.MOST_EDGES, 60])
def test_components_and_stages_agree_with_one_queue(spark, most):
    rows = random_edges(12)
    df = spark.createDataFrame(rows, "s1 bigint, s2 bigint, sum_aff double, area bigint")
    alone = kernels.agglomerate(rows, {}, P)
    events = A.agglomerate(df, A.nodes_of(df), P, Scratch(spark, "t"), most=most).collect()
    assert groups([(e.a, e.b) for e in events if e.kind == "remap"]) == groups(alone["remap"])
    assert abs(sum(e.sum_aff for e in events if e.kind == "final") - sum(w[2] for w in alone["final"])) < 1e-9


@pytest.mark.parametrize("most", [A.MOST_EDGES, 80])
def test_vetoes_hold_in_stages(spark, most):
    r = random.Random(5)
    rows = random_edges(7, 300, 120)
    p = replace(P, threshold=0.7, twig=0.5, twig_size=60, twig_area=8, semantic=0.8, labelled=5, size_affinity=0.9, small=30, large=70)
    nodes = {}
    for s in {x for e in rows for x in e[:2]}:
        nucleus = r.choice([(NONE, 0, 0, 0)] * 6 + [(PROPER, 1, 3, 4), (PROPER, 2, 3, 3), (CONFLICT, 0, 0, 5)])
        nodes[s] = kernels.Node(r.randint(1, 9), r.randint(1, 60), r.random() < 0.01, (r.randint(0, 9), r.randint(0, 9), 0), nucleus)
    flat = [(s, n.supervoxels, n.size, n.frozen, *n.labels, *n.nucleus) for s, n in nodes.items()]
    df = spark.createDataFrame(rows, "s1 bigint, s2 bigint, sum_aff double, area bigint")
    state = spark.createDataFrame(flat, "sid bigint, supervoxels bigint, size bigint, frozen boolean, n0 bigint, n1 bigint, n2 bigint, state bigint, id bigint, count bigint, total bigint")
    alone = kernels.agglomerate(rows, nodes, p, by_degree=False)
    events = A.agglomerate(df, state, p, Scratch(spark, "t"), by_degree=False, most=most).collect()
    assert groups([(e.a, e.b) for e in events if e.kind == "remap"]) == groups(alone["remap"])
    for kind in KINDS:
        want = sorted((min(e[:2]), max(e[:2]), e[3]) for e in alone[kind])
        assert sorted((min(e.a, e.b), max(e.a, e.b), e.area) for e in events if e.kind == kind) == want, kind
    assert all(alone[k] for k in KINDS)


def test_nothing(spark):
    df = spark.createDataFrame([], "s1 bigint, s2 bigint, sum_aff double, area bigint")
    assert A.agglomerate(df, A.nodes_of(df), P, Scratch(spark, "t")).collect() == []


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_are_those_of_one_queue(spark, seed):
    r = random.Random(seed)
    rows = [(r.randint(1, 120), 0, r.randint(1, 120), r.choice([None, 5, 5, r.randint(0, 99)])) for _ in range(160)] + [(0, 0, 4, 9), (None, 0, 4, 9), (300, 0, 300, 1), (301, 0, 302, 2)]
    tags = {s: r.choice([(PROPER, 1, 3, 4), (PROPER, 2, 3, 3), (PROPER, 3, 1, 1), (CONFLICT, 0, 0, 5), (NONE, 0, 0, 0)]) for s in r.sample(range(1, 120), 25)}
    df = spark.createDataFrame(rows + rows[:5], "oid bigint, boundary_size bigint, nid bigint, agg_size bigint")
    nuclei = spark.createDataFrame([(s, *t) for s, t in tags.items()], "sid bigint, state int, id bigint, count bigint, total bigint")
    todo = sorted({(o, b, n, -1 if a is None else a) for o, b, n, a in rows if o and n})
    for given, frame in ((tags, nuclei), ({}, None)):
        new, cuts = kernels.match(todo, given)
        got = A.match(df, frame, Scratch(spark, "t")).collect()
        assert {g.a: g.b for g in got if g.kind == "remap"} == new
        assert sorted((g.a, g.b) for g in got if g.kind == "cut") == sorted(set(cuts))
    assert A.match(df.limit(0), nuclei, Scratch(spark, "t")).collect() == []
