import random

from volseg.operators import hierarchy as H
from volseg.plans import tables
from volseg.storage import Scratch

SCHEMA = "oid bigint, nid bigint, agg_size bigint, id bigint, nxt string"


def brute(rows):
    best = {}
    for o, n, w in rows:
        if o and n and o != n:
            key = (w is not None, w or 0, -n)
            if o not in best or key > best[o][0]:
                best[o] = (key, n)
    up = {o: n for o, (_, n) in best.items()}
    out = {}
    for v in {x for o, n, _ in rows for x in (o, n) if x}:
        seen = [v]
        while seen[-1] in up and up[seen[-1]] not in seen:
            seen.append(up[seen[-1]])
        if seen[-1] in up:
            loop = seen[seen.index(up[seen[-1]]) :]
            out[v] = (min(loop), -1, None)
        else:
            out[v] = (seen[-1], len(seen) - 1, seen[::-1])
    return out


def run(spark, rows, paths=True):
    df = spark.createDataFrame([(o, n, w, 7, "x") for o, n, w in rows], SCHEMA)
    got = H.resolve(H.parents(df, "oid", "nid", "agg_size"), H.all_ids(df, "oid", "nid"), Scratch(spark, "test"), paths)
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len({r[0] for r in got})
    return {r[0]: (r[1], r[2], *r[3:]) for r in got}


def test_random_forest_with_loops(spark):
    r = random.Random(3)
    rows = []
    for i in range(1, 1500):
        rows.append((i, r.choice([i + 1, i + 1, r.randint(1, 1600)]), r.choice([None, 1, 2, 2])))
        if r.random() < 0.05:
            rows.append((i, r.choice([None, 0, i, 5]), 9))
    rows += rows[:50] + [(None, 3, 1), (0, 4, 1), (4, None, None)]
    assert run(spark, rows) == brute(rows)


def test_loops_without_splitters(spark):
    plain = [r[0] for r in spark.range(1, 400).where(~H.is_splitter(H.F.col("id"))).collect()]
    split = [r[0] for r in spark.range(1, 400).where(H.is_splitter(H.F.col("id"))).collect()]
    ring = [(a, b, 1) for a, b in zip(plain[:9], plain[1:9] + plain[:1])]  # a loop without splitters
    tail = [(split[0], plain[0], 1), (plain[20], split[0], 1), (plain[21], plain[20], 1), (split[1], plain[21], 1)]
    pair = [(split[2], split[3], 1), (split[3], split[2], 1), (plain[30], split[2], 1)]
    one = [(split[4], plain[40], 1), (plain[40], plain[41], 1), (plain[41], split[4], 1)]
    rows = ring + tail + pair + one
    assert run(spark, rows) == brute(rows)


def test_chain_star_and_empty(spark):
    chain = [(i, i + 1, None) for i in range(1, 700)] + [(10_000 + i, 5, 1) for i in range(300)]
    assert run(spark, chain) == brute(chain)
    assert run(spark, []) == {}
    assert run(spark, [(None, None, None), (0, 0, 1), (7, 7, 1)]) == {7: (7, 0, [7])}


def test_descendants(spark):
    rows = [(2, 1, 1), (3, 2, 1), (4, 2, 1), (8, 9, 1), (9, 8, 1)]
    df = spark.createDataFrame([(o, n, w, 7, "x") for o, n, w in rows], SCHEMA)
    got = H.resolve(H.parents(df, "oid", "nid", "agg_size"), H.all_ids(df, "oid", "nid"), Scratch(spark, "test"), True)
    assert {tuple(r) for r in H.descendants(got).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (1, 4, 2), (2, 4, 1)}


def test_descendants_at_and_below_loops(spark):
    r = random.Random(5)
    rows = [(i, r.choice([i + 1, r.randint(1, 430)]), r.choice([1, 2])) for i in range(1, 400)]
    rows += [(501, 502, 1), (502, 503, 1), (503, 501, 1), (510, 502, 1), (511, 510, 1)]
    df = spark.createDataFrame([(o, n, w, 7, "x") for o, n, w in rows], SCHEMA)
    links, ids, scratch = H.parents(df, "oid", "nid", "agg_size"), H.all_ids(df, "oid", "nid"), Scratch(spark, "test")
    up = {row[0]: row[1] for row in links.collect()}
    want = []
    for v in up:
        at, n, seen = up[v], 1, {v}
        while at is not None and at not in seen:
            want.append((at, v, n))
            seen.add(at)
            at, n = up.get(at), n + 1
    assert {(502, 511, 2), (501, 511, 4), (503, 502, 1), (502, 503, 2)} <= set(want)
    out = H.resolve(links, ids, scratch, True)
    assert sorted(tuple(x) for x in H.descendants(out, H.cut_loops(links, out, scratch)).collect()) == sorted(want)


def test_paths_of_looped_segments_are_null(spark, tmp_path):
    rows = [(2, 1, 1), (8, 9, 1), (9, 8, 1), (10, 9, 1)]
    spark.createDataFrame([(o, n, w, 7, "x") for o, n, w in rows], SCHEMA).write.parquet(f"{tmp_path}/matching_faces.parquet")
    got = tables.p5_paths(spark, str(tmp_path)).select("seg_id", "root_id", "n_links", "path").collect()
    assert {tuple(r) for r in got} == {(1, 1, 0, "1"), (2, 1, 1, "1/2"), (8, 8, -1, None), (9, 8, -1, None), (10, 8, -1, None)}
