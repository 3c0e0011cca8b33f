import random
from collections import Counter, defaultdict

from volseg.llm import mixing as M
from volseg.storage import Scratch

TARGETS = [M.Target("a", 0.5, 1), M.Target("b_c", 0.2, 2), M.Target("tiny", 0.2, 4), M.Target("absent", 0.1, 9)]


def data(spark, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(3000):
        s = r.choice(["a", "A ", "a", "a", "b-c", "B_C", None, "other", "tiny" if r.random() < 0.2 else "a"])
        rows.append((i, s, r.choice([0, 5, r.randint(1, 300), r.randint(1, 300)]), "p", 1))
    return rows, spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, position string, start int")


def name(s):
    return None if s is None else s.strip().lower().replace("-", "_")


def test_shares_repeats_and_order(spark):
    rows, df = data(spark)
    got = M.mix(df, TARGETS, Scratch(spark, "t")).orderBy("position").collect()
    totals = Counter()
    for d, s, n, *_ in rows:
        totals[name(s)] += n
    budget = int(M.largest_budget(totals, TARGETS))
    taken = sum(x.n_tokens for x in got)
    assert budget - 300 <= taken <= budget
    at, seen, repeats = 0, Counter(), defaultdict(list)
    for x in got:
        assert x.position == at
        at += x.n_tokens
        seen[x.source] += x.n_tokens
        repeats[x.doc_id].append(x.repeat_no)
        for t in TARGETS[:3]:
            assert abs(seen[t.source] - at * t.share / 0.9) <= 3 * 300
    limits = {t.source: t.repeats for t in TARGETS}
    where = {d: name(s) for d, s, *_ in rows}
    assert all(sorted(v) == list(range(len(v))) and len(v) <= limits[where[d]] for d, v in repeats.items())
    finish = [x.virtual_finish for x in got]
    assert finish == sorted(finish)
    report = {r.source: r for r in M.shares_report(M.mix(df, TARGETS, Scratch(spark, "t")), TARGETS).collect()}
    assert report["absent"].n_tokens == 0 and abs(report["a"].actual_share - 0.5 / 0.9) < 0.02
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9


def test_a_budget_beyond_what_there_is(spark):
    rows, df = data(spark)
    got = M.mix(df, TARGETS, Scratch(spark, "t"), budget=10**9).collect()
    most = sum(n * {"a": 1, "b_c": 2, "tiny": 4}.get(name(s), 0) for _, s, n, *_ in rows)
    assert sum(x.n_tokens for x in got) == most


def test_empty(spark):
    _, df = data(spark)
    assert M.mix(df.limit(0), TARGETS, Scratch(spark, "t")).collect() == []
    assert M.mix(df, [M.Target("absent", 1.0, 3)], Scratch(spark, "t")).collect() == []
