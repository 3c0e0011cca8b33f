import random
import threading
from dataclasses import replace

import numpy as np
import pytest

from volseg.config import Watershed
from volseg.operators import kernels, rag, watershed
from volseg.storage import Scratch


def volume(spark, shape, seed):
    r = np.random.default_rng(seed)
    at = np.indices(shape).reshape(3, -1).T
    aff = r.random((len(at), 3))
    rows = [(*map(int, p), *map(float, a)) for p, a in zip(at, aff)]
    return spark.createDataFrame(rows, "x int, y int, z int, ax double, ay double, az double").repartition(3)


def parts(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r.sid, set()).add((r.x, r.y, r.z))
    return {frozenset(g) for s, g in groups.items() if s}, groups.get(0, set())


@pytest.mark.parametrize("high,most", [(2.0, 10_000), (0.8, 120)])
def test_stitched_blocks_are_the_whole(spark, high, most):
    shape, chunk, low = (11, 9, 8), (4, 5, 4), 0.3
    v = volume(spark, shape, 4)
    scratch = Scratch(spark, "t")
    whole = watershed.basins(v, shape, low, high).collect()
    labels = scratch.save(v.join(watershed.basins(v, chunk, low, high), ["x", "y", "z"]))
    graph = rag.scored(rag.contacts(watershed.inside(labels, chunk), chunk=chunk), "max")
    sizes = watershed.sizes_and_border(labels, shape, shape)
    p = replace(Watershed(), high=high, low=low, size=0, dust=0)
    level = watershed.stitch(watershed.face_planes(labels, chunk, "bits"), graph, sizes, p, scratch, most=most)
    new = {r.old: r.new for r in level.remap.collect()}
    got = [r.asDict() | {"sid": new.get(r.sid, 0)} for r in labels.collect()]
    one = {(r.x, r.y, r.z): r.sid for r in whole}
    pairs = {(one[g["x"], g["y"], g["z"]], g["sid"]) for g in got}
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)  # one to one
    assert sum(r["size"] for r in level.sizes.collect()) == sum(1 for g in got if g["sid"])
    assert level.edges.count() == 0  # nothing goes on beyond the volume


@pytest.mark.parametrize("most", [watershed.MOST_EDGES, 50])
def test_small_basins_as_in_one_pass(spark, most):
    r = random.Random(3)
    ids = range(1, 90)
    edges = {tuple(sorted(r.sample(ids, 2))): r.choice([0.5, 0.75, r.random()]) for _ in range(170)}
    size, border = {i: r.randint(1, 40) for i in ids}, {i: r.random() < 0.2 for i in ids}
    new, forest, _ = kernels.merge_small([(w, a, b) for (a, b), w in edges.items()], size, border, 30, 12, 0.2)
    graph = spark.createDataFrame([(w, a, b) for (a, b), w in edges.items()], "score double, s1 bigint, s2 bigint")
    sizes = spark.createDataFrame([(i, size[i], border[i]) for i in ids], "sid bigint, size bigint, on_border boolean")
    scratch = Scratch(spark, "t")
    out = scratch.save(watershed.merge_segments(graph, sizes, 30, 12, 0.2, scratch, most=most))
    rows = out.collect()
    assert {x.a: x.b for x in rows if x.kind == "remap"} == new
    assert {(x.a, x.b, x.score) for x in rows if x.kind == "edge"} == {(min(a, b), max(a, b), w) for w, a, b in forest}
    compact = watershed.compact_segments(out, scratch).collect()
    assert sorted({x.b for x in compact if x.kind == "remap"} - {0}) == list(range(1, len(set(new.values()) - {0}) + 1))
    assert watershed.merge_segments(graph.limit(0), sizes.limit(0), 30, 12, 0.2, scratch).collect() == []


def test_only_draining_edges_are_put_in_order(spark):
    r = random.Random(7)
    edges = {tuple(sorted(r.sample(range(1, 40), 2))): r.choice([0.5, 0.75, 0.9, r.random()]) for _ in range(150)}
    rows = sorted([(w, a, b) for (a, b), w in edges.items()], key=lambda e: (-e[0], e[1], e[2]))
    nodes = {i: [1, False, r.choice([0.5, 0.75, max((w for w, *e in rows if i in e), default=-1.0)])] for i in range(1, 40)}
    df = spark.createDataFrame(rows, "score double, s1 bigint, s2 bigint")
    known = spark.createDataFrame([(i, v[2]) for i, v in nodes.items()], "sid bigint, descent double")
    left = {(x.score, x.s1, x.s2) for x in watershed._draining(df, known, 0.9).collect()}
    assert len(left) < len(rows)
    copies = [{i: list(v) for i, v in nodes.items()} for _ in range(2)]
    some = kernels.join_descents([e for e in rows if e in left], copies[0], 0.9)
    assert some == kernels.join_descents(rows, copies[1], 0.9) and copies[0] == copies[1]


def test_blocks_beyond_ten_bits_have_ids_of_their_own(spark):
    places = [(0, 0, 4 * 1025), (0, 5, 4), (0, 5, 4 * 1025), (4 * 1024, 0, 4), (4, 0, 4), (0, 5 * 1024, 4 * 5000)]
    rows = [(x, y, z + k, 0.0, 0.0, 0.5) for x, y, z in places for k in (0, 1)]
    got = watershed.basins(spark.createDataFrame(rows, "x int, y int, z int, ax double, ay double, az double"), (4, 5, 4), 0.1, 0.9).collect()
    ids = {(r.x, r.y, r.z // 4): r.sid for r in got if r.sid}
    assert len(ids) == len(set(ids.values())) == len(places) and min(ids.values()) > 0
    assert ids[0, 5, 1] == (1 << 36 | 1 << 26) + 1
    with pytest.raises(ValueError):
        watershed._first_id(4096, 0, 0)


def test_stages_begin_with_what_a_task_may_hold(spark):
    # a chain whose components need not be looked for at falling halves of the edges
    r = random.Random(11)
    rows = [(r.random(), i, i + 1) for i in range(1, 800)]
    scratch = Scratch(spark, "t")
    sizes = {i: r.randint(1, 9) for i in range(1, 801)}
    new, forest, _ = kernels.merge_small(rows, sizes, dict.fromkeys(sizes, False), 30, 12, 0.0)
    known = spark.createDataFrame([(i, n, False) for i, n in sizes.items()], "sid bigint, size bigint, on_border boolean")
    out = watershed.merge_segments(spark.createDataFrame(rows, "score double, s1 bigint, s2 bigint"), known, 30, 12, 0.0, scratch, most=100).collect()
    assert {x.a: x.b for x in out if x.kind == "remap"} == new and scratch.count < 60


def test_settings_run_side_by_side(spark, monkeypatch):
    graph = spark.createDataFrame([(0.9, 1, 2), (0.6, 2, 3), (0.4, 3, 4)], "score double, s1 bigint, s2 bigint")
    sizes = spark.createDataFrame([(i, 5, False) for i in range(1, 5)], "sid bigint, size bigint, on_border boolean")
    settings, met, one = [(10, 2, 0.5), (20, 3, 0.3)], threading.Barrier(2, timeout=30), watershed.merge_segments
    want = {(i, r.kind, r.a, r.b, r.score) for i, t in enumerate(settings) for r in one(graph, sizes, *t, Scratch(spark, "t")).collect()}

    def waits(*args):
        met.wait()
        return one(*args)

    monkeypatch.setattr(watershed, "merge_segments", waits)
    got = watershed.merge_segments_at(graph, sizes, settings, Scratch(spark, "t")).collect()
    assert {(r.setting, r.kind, r.a, r.b, r.score) for r in got} == want and len(got) == len(want)
