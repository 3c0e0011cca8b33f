import random

from volseg.llm import components as C
from volseg.storage import Scratch

SCHEMA = "oid bigint, nid bigint, id bigint, group_id string, a int"


def brute(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in pairs:
        for v in (x, y):
            if v:
                find(v)
        if x and y:
            a, b = find(x), find(y)
            up[max(a, b)] = min(a, b)
    return {v: find(v) for v in up}


def run(spark, rows):
    df = spark.createDataFrame([(x, y, 1, "n", 2) for x, y in rows], SCHEMA)
    sides = (df, "oid", "nid")
    got = C.components(C.link_edges(sides), C.link_ids(sides), Scratch(spark, "t")).collect()
    assert len(got) == len({r.id for r in got})
    return {r.id: r.group_id for r in got}


def test_random_graph(spark):
    r = random.Random(8)
    rows = [(r.choice([None, 0, r.randint(-50, 900)]) if r.random() < 0.1 else r.randint(-50, 900), r.randint(-50, 900)) for _ in range(420)]
    rows += rows[:30] + [(5, 5), (None, None), (0, 0), (None, 7777), (8888, 0)]
    assert run(spark, rows) == brute(rows)


def test_chains_and_stars(spark):
    r = random.Random(9)
    names = r.sample(range(1, 10_000), 300)
    rows = list(zip(names, names[1:])) + [(20_000 + i, 20_001 + i) for i in range(200)] + [(30_000, 30_001 + i) for i in range(300)] + [(50_000, 49_999 - i) for i in range(100)]
    assert run(spark, rows) == brute(rows)


def test_nothing_linked(spark):
    assert run(spark, []) == {}
    assert run(spark, [(3, 0), (None, 4), (5, 5)]) == {3: 3, 4: 4, 5: 5}
