"""Kernels against hand-computed cases and brute force; no Spark."""

import itertools
import random

import numpy as np
import pytest

from volseg.config import Agglomeration, ratio, read_parameters, sanitize, score_function
from volseg.operators import kernels as K
from volseg.schema import CONFLICT, NONE, PROPER

RECORDS = [(NONE, 0, 0, 0), (PROPER, 1, 3, 5), (PROPER, 1, 9, 10), (PROPER, 2, 4, 5), (CONFLICT, 0, 0, 9)]
P25 = Agglomeration(threshold=0.25)


def test_record_algebra():
    for a, b, c in itertools.product(RECORDS, repeat=3):
        assert K.join_nuclei(a, b) == K.join_nuclei(b, a)
        assert K.join_nuclei(K.join_nuclei(a, b), c) == K.join_nuclei(a, K.join_nuclei(b, c))
    assert K.join_nuclei(RECORDS[1], RECORDS[1]) == (PROPER, 1, 6, 10)
    none, p1, p1b, p2, conflict = RECORDS
    assert all(K.nuclei_agree(a, b) for a, b in [(none, none), (none, p1), (none, conflict), (p1, p1b)])
    assert not any(K.nuclei_agree(a, b) for a, b in [(p1, p2), (conflict, p1), (p1, conflict), (conflict, conflict)])


def test_parameters():
    assert ratio("0.6") == (600, 1000) and ratio("1") == (1000, 1000)
    for bad in ("nan", "inf", "0.5", "1.1"):
        with pytest.raises(ValueError):
            ratio(bad)
    assert score_function("p90.5") == ("percentile", 90.5) and score_function("p.5") == ("percentile", 0.5) and score_function("max") == ("max", None)
    for bad in ("p101", "p", "median"):
        with pytest.raises(ValueError):
            score_function(bad)
    assert sanitize("a-b c") == "a_b_c"
    assert read_parameters('{"threshold": 1, "else": 2}', Agglomeration).threshold == 1.0


def one_edge(nuclei, sizes):
    nodes = {s: K.Node(supervoxels=n, nucleus=nuclei.get(s, RECORDS[0])) for s, n in zip((100, 200), sizes)}
    return K.agglomerate([(100, 200, 407.4, 420)], nodes, P25, by_degree=False)


@pytest.mark.parametrize("nuclei,sizes,remap,cut", [
    ({100: (PROPER, 1, 9, 9), 200: (PROPER, 2, 9, 9)}, (100, 100), None, True),
    ({100: (PROPER, 1, 9, 9), 200: (PROPER, 1, 9, 9)}, (100, 100), (200, 100), False),
    ({100: (PROPER, 1, 9, 9)}, (100, 100), (200, 100), False),
    ({100: (PROPER, 1, 9, 9)}, (1, 100), (200, 100), False),
    ({200: (PROPER, 1, 9, 9)}, (100, 1), (100, 200), False),
    ({100: (CONFLICT, 0, 0, 9), 200: (PROPER, 2, 9, 9)}, (100, 100), None, True),
    ({}, (100, 100), (200, 100), False),
])
def test_agglomeration_with_nuclei(nuclei, sizes, remap, cut):
    out = one_edge(nuclei, sizes)
    assert out["remap"] == ([remap] if remap else [])
    assert [e[:2] for e in out["nucleus"]] == ([(100, 200)] if cut else [])


def test_agglomeration_rules():
    # averages of parallel edges: 1-2 merge first, then (1,3) is the mean of both edges to 3
    out = K.agglomerate([(1, 2, 9.0, 10), (1, 3, 4.0, 10), (2, 3, 1.0, 10)], {}, P25)
    assert len(out["remap"]) == 1 and out["final"][0][2:] == (5.0, 20)
    out = K.agglomerate([(1, 2, 9.0, 10), (1, 3, 4.0, 10), (2, 3, 2.0, 10)], {}, P25)
    assert len(out["remap"]) == 2 and out["final"] == []
    # a frozen segment freezes what it touches, and the edge is left over
    out = K.agglomerate([(1, 2, 9.0, 10), (2, 3, 8.0, 10)], {1: K.Node(frozen=True)}, P25)
    assert out["remap"] == [] and sorted(e[:2] for e in out["residual"]) == [(1, 2), (2, 3)]
    # dominant labels differ
    a, b = K.Node(labels=(200_000, 0, 0)), K.Node(labels=(0, 200_000, 0))
    assert K.agglomerate([(1, 2, 4.0, 10)], {1: a, 2: b}, P25)["semantic"]
    a, b = K.Node(labels=(200_000, 0, 0)), K.Node(labels=(0, 90_000, 0))
    assert K.agglomerate([(1, 2, 4.0, 10)], {1: a, 2: b}, P25)["remap"]
    # two large segments need a strong edge
    a, b = K.Node(size=2_000_000), K.Node(size=9_000_000)
    assert K.agglomerate([(1, 2, 3.0, 10)], {1: a, 2: b}, P25)["size"]
    # at the threshold there is no merge
    assert K.agglomerate([(1, 2, 2.5, 10)], {}, P25)["final"] == [(1, 2, 2.5, 10)]


def test_merge_small():
    size, border = {1: 100, 2: 5, 3: 100, 4: 2, 5: 7}, {1: False, 2: False, 3: False, 4: False, 5: True}
    new, forest, records = K.merge_small([(0.9, 1, 3), (0.8, 1, 2), (0.7, 2, 3), (0.6, 3, 5)], size, border, limit=50, dust=10, above=0.1)
    assert new == {1: 1, 2: 1, 3: 3, 4: 0, 5: 5}  # the large pair stays apart, 4 is dust, 5 lies at the border
    assert forest == [(0.9, 1, 3), (0.6, 3, 5)] and records[3] == (100, True)


def test_spanning_forest_is_maximal():
    r = random.Random(1)
    edges = [(r.random(), a, b) for a, b in itertools.combinations(range(1, 8), 2) if r.random() < 0.6]
    got = sum(w for w, *_ in K.spanning_forest(edges))
    n = len(K.spanning_forest(edges))
    best = 0.0
    for part in itertools.combinations(edges, n):
        sets = K.Sets()
        ok = True
        for _, a, b in part:
            x, y = sets.find(a), sets.find(b)
            ok = ok and x != y
            sets.link(x, y)
        best = max(best, sum(w for w, *_ in part)) if ok else best
    assert abs(got - best) < 1e-12


def test_join_descents():
    def run(third):
        nodes = {i: [i, i == 3, d] for i, d in ((1, 0.9), (2, 0.9), (3, third))}
        return K.join_descents([(0.9, 1, 2), (0.5, 2, 3)], nodes, 0.99), nodes

    assert run(0.6)[0] == {2: 1}
    stand, nodes = run(0.5)
    assert stand == {2: 1, 3: 1} and nodes[1] == [6, True, 0.99]  # what drains elsewhere counts as a plateau


def test_basins():
    bits = np.zeros((5, 1, 1), dtype=int)
    bits[:, 0, 0] = [8, 1, 0, 8, 1]  # two pairs that point at each other, background between
    assert K.basins(bits)[:, 0, 0].tolist() == [1, 1, 0, 2, 2]
    bits[:, 0, 0] = [8, 8, 8, 9, 1]  # all lead to the pair at the end
    assert K.basins(bits)[:, 0, 0].tolist() == [1] * 5
    bits = np.zeros((2, 2, 1), dtype=int)
    bits[:, :, 0] = [[8, 2], [1, 2]]  # y neighbours follow x = 0 and x = 1 of the first row
    assert len(set(K.basins(bits).ravel().tolist())) == 1


def test_flood():
    cost = np.ones((7, 1, 1))
    seeds = np.zeros((7, 1, 1), dtype=int)
    seeds[0], seeds[6] = 5, 9
    mask = np.ones((7, 1, 1), dtype=bool)
    assert K.flood(cost, seeds, mask).ravel().tolist() == [5, 5, 5, 5, 9, 9, 9]
    cost[1] = 10
    assert K.flood(cost, seeds, mask).ravel().tolist()[2:] == [9] * 5
    mask[3] = False
    assert K.flood(cost, seeds, mask).ravel().tolist() == [5, 5, 5, 0, 9, 9, 9]


def test_match():
    rows = [(10, 0, 100, 1000), (10, 0, 200, 900)]
    none, p1, _, p2, _ = RECORDS
    new, cuts = K.match(rows, {100: p1, 200: p2})
    assert new[200] == 200 and new[10] == 100 and cuts == [(10, 200)]
    for nuclei in ({200: p1}, {}):
        new, cuts = K.match(rows, nuclei)
        assert new == {10: 100, 100: 100, 200: 100} and not cuts


def test_coordinate_components_and_reweighting():
    assert K.coordinate_components([(0, 0, 0), (1, 1, 1), (3, 0, 0), (2, 0, 0)]) == [0, 0, 0, 0]
    assert K.coordinate_components([(0, 0, 0), (5, 0, 0), (1, 0, 0)]) == [0, 1, 0]
    weak = {(i, 0, 0): (0.1, 1, 0.1) for i in range(30)}
    aff, area = K.reweighted_mean(weak)
    assert area == 30 and abs(aff - 3.0) < 1e-12
    strong = {**weak, **{(100 + i, 0, 0): (0.9, 1, 0.9) for i in range(25)}}
    aff, area = K.reweighted_mean(strong)
    assert area == 25 and abs(aff / area - 0.9) < 1e-12
