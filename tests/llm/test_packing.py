import random
from collections import defaultdict

import numpy as np
import pytest

from volseg.llm import packing as P
from volseg.storage import Scratch

BINS = [("short", 100), ("base", 400), ("none", 0), (None, 5)]


def check(rows, counts, bins):
    loads, seen = defaultdict(int), defaultdict(list)
    for b, c, d, piece, start, n in rows:
        seen[(b, d)].append((start, n, piece))
        if c is None:
            assert n == 0
        else:
            assert n > 0
            loads[(b, c)] += n
    for code, cap in bins:
        assert all(v <= cap for (b, _), v in loads.items() if b == code)
        for d, n in counts.items():
            pieces = sorted(seen[(code, d)])
            assert sum(p[1] for p in pieces) == n and len(pieces) == max(1, -(-n // cap))
            assert [p[0] for p in pieces] == [i * cap for i in range(len(pieces))] and [p[2] for p in pieces] == list(range(len(pieces)))
    return loads


def test_documents(spark):
    r = random.Random(3)
    counts = {i: r.choice([0, r.randint(1, 60), r.randint(1, 400), r.randint(300, 2500), 100, 400]) for i in range(3000)}
    df = spark.createDataFrame([(k, v, "x", "y") for k, v in counts.items()] + [(5000, None, "x", "y")], "doc_id bigint, n_tokens bigint, container string, shard string")
    scratch = Scratch(spark, "t")
    packed = scratch.save(P.pack_documents(scratch.save(df), BINS, scratch))
    loads = check([tuple(x) for x in packed.collect()], {**counts, 5000: 0}, BINS[:2])
    for r in P.fill_report(packed, BINS).collect():
        assert r.unused_share < 0.03 and r.fullest <= r.capacity_tokens and r.fewest <= r.n_containers
        assert r.n_containers == sum(1 for b, _ in loads if b == r.bin_code)
    assert P.pack_documents(scratch.save(df.limit(0)), BINS, scratch).collect() == []


@pytest.mark.parametrize("make", [lambda r: r.randint(1, 1000), lambda r: r.randint(300, 700), lambda r: r.choice([501, 499, 334, 333, 250]), lambda r: 1000, lambda r: 1, lambda r: int(min(1000, max(1, r.lognormvariate(5, 1))))])
def test_pack_is_tight(make):
    r = random.Random(4)
    lengths = np.array([make(r) for _ in range(4000)])
    at = P.pack(lengths, 1000)
    load = np.bincount(at, weights=lengths)
    assert load.max() <= 1000 and (at >= 0).all()
    bound = max(-(-lengths.sum() // 1000), (lengths > 500).sum())
    assert load.size <= bound * 1.03 + 2


def test_pack_nothing_and_one():
    assert P.pack(np.array([], dtype=np.int64), 10).size == 0
    assert P.pack(np.array([10]), 10).tolist() == [0]
    assert len(set(P.pack(np.array([6, 6, 4, 4]), 10).tolist())) == 2


def test_report_sees_what_is_wrong(spark):
    counts = spark.createDataFrame([(1, 5), (2, 3), (3, 12)], "doc_id bigint, n_tokens bigint")
    kind = "bin_code string, container string, doc_id bigint, piece_no bigint, start_token bigint, n_tokens bigint"
    good = [("b", "x", 1, 0, 0, 5), ("b", "x", 2, 0, 0, 3), ("b", "y", 3, 0, 0, 8), ("b", "z", 3, 1, 8, 4)]
    bad = [("b", "x", 1, 0, 0, 5), ("b", "x", 2, 0, 0, 2), ("b", "x", 2, 1, 2, 1), ("b", "x", 3, 0, 0, 8), ("b", "z", 3, 0, 0, 3)]
    for rows, want in ((good, (3, 0, 0, 0, 0)), (bad, (3, 1, 1, 1, 1))):
        got = P.kept_report(spark.createDataFrame(rows, kind), counts, [("b", 8)]).first()
        assert tuple(got)[2:] == want
