import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from volseg.operators import compaction as C
from volseg.storage import Scratch

EDGE = "s1 bigint, s2 bigint, aff double, area bigint, chunk_tag string, file_id bigint, slot int, written_at string, rec int, a string"


def edges(spark, files):
    rows = [(*rec, tag, fid, slot, f"t{slot}", 1, "x") for (tag, fid), recs in files.items() for slot, rec in enumerate(recs)]
    return spark.createDataFrame(rows, EDGE)


def brute(files):
    norm = lambda recs: {tuple("nan" if v != v else v for v in r) for r in recs}
    sets = {k: norm(v) for k, v in files.items() if v and k[1] is not None}
    out = set()
    for (tag, fid), a in sets.items():
        for (tag2, fid2), b in sets.items():
            if tag == tag2 and fid != fid2 and a <= b and (len(b) > len(a) or fid2 < fid):
                out.add(fid)
    return out


def test_contained_files(spark):
    r = random.Random(4)
    nan = float("nan")
    files, fid = {}, 0
    pool = [(r.choice([None, 0, 1, 2]), r.choice([None, 1, 2]), r.choice([None, nan, 1.5, float("inf")]), r.choice([None, 3])) for _ in range(60)]
    for _ in range(250):
        fid += 1
        recs = [r.choice(pool) for _ in range(r.randint(1, 9))]
        if files and r.random() < 0.4:
            recs = list(r.choice(list(files.values())))
            recs = recs[: r.randint(1, len(recs))] + recs[:1]
        files[(r.choice(["c1", "c1", "c2", None]), fid)] = recs
    files[("c1", None)] = [pool[0]]
    df = edges(spark, files)
    got = [x[0] for x in C.contained_files([(df, ["s1", "s2", "aff", "area"])], Scratch(spark, "t")).select("file_id").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(files)
    assert C.contained_files([(df.limit(0), ["s1", "s2", "aff", "area"])], Scratch(spark, "t")).collect() == []


def test_nulls_keep_their_place(spark):
    files = {("c", 1): [(None, 5, 1.0, 1)], ("c", 2): [(5, None, 1.0, 1)], ("c", 3): [(None, 5, 1.0, 1), (5, None, 1.0, 1)]}
    got = C.contained_files([(edges(spark, files), ["s1", "s2", "aff", "area"])], Scratch(spark, "t"))
    assert {x[0] for x in got.collect()} == {1, 2}


def test_longest_first():
    sizes = np.array([7, 3, 9, 1, 5, 5, 6])
    groups = C.longest_first(sizes, 3)
    loads = [int(sizes[groups == g].sum()) for g in range(3)]
    assert max(loads) - min(loads) <= 2 and sum(loads) == 36
    assert C.longest_first(np.array([], dtype=np.int64), 2).tolist() == []


RECORD = ["s1", "s2", "aff", "area"]


def test_compact_keeps_every_record(spark):
    files = {("c", i): [(i, j, float(j), None) for j in range(i % 40 + 1)] for i in range(1, 120)}
    files[("c", 500)] = files[("c", 39)][:5]
    files[("c", 600)] = [(600, j, float("nan"), j) for j in range(2000)]  # larger than a group
    files[("c", None)] = [(None, j, None, 1) for j in range(1500)]  # rows without a file
    df = edges(spark, files)
    df = df.unionByName(df.where("file_id = 38")).unionByName(df.where("file_id = 600 AND slot < 11"))
    scratch = Scratch(spark, "t")
    (m,) = C.compact_tables([(df, RECORD, 32)], scratch, target_bytes=9000, least=4)
    listed = {x.file_id: x for x in m.files.collect()}
    assert [f for f, x in listed.items() if x.kept_in is not None] == [500] and listed[500].kept_in == 39
    assert set(listed) == {f for _, f in files} and listed[600].n_parts > 3 and listed[None].n_parts > 3
    groups = m.groups.collect()
    n = sum(len(v) for (_, f), v in files.items() if f != 500)
    assert sum(g.n_records for g in groups) == n and sum(g.n_repeats for g in groups) == 39 + 11
    assert max(g.n_records for g in groups) * 32 < 3 * 9000 and len({g.group_id for g in groups}) == len(groups)
    stored = [pq.read_table(g.path) for g in groups]
    keys = [(x["file_id"], x["slot"]) for t in stored for x in t.to_pylist()]
    assert len(keys) == len(set(keys)) == n and m.records().count() == n
    with pytest.raises(RuntimeError):
        C.compact(df, RECORD, 32, df.select("file_id", F.lit(1).cast("bigint").alias("kept_in")).limit(0), m.path, scratch)


def test_compact_nothing(spark):
    (m,) = C.compact_tables([(edges(spark, {}), RECORD, 32)], Scratch(spark, "t"))
    assert m.groups.collect() == [] and m.files.collect() == []


def test_a_damaged_file_is_not_published(spark, monkeypatch):
    files = {("c", i): [(i, 1, 0.5, 1)] for i in range(20)}
    whole = C._writer

    def broken(folder, columns, identity):
        run = whole(folder, columns, identity)

        def damaged(batches):
            import pyarrow.parquet as files

            for row in run(batches):
                path = row.column("path")[0].as_py()
                t = files.read_table(path)
                files.write_table(t.set_column(t.column_names.index("area"), "area", t.column("s1")), path)
                yield row

        return damaged

    monkeypatch.setattr(C, "_writer", broken)
    with pytest.raises(RuntimeError, match="read back"):
        C.compact_tables([(edges(spark, files), RECORD, 32)], Scratch(spark, "t"), least=2)


def test_repeats_are_told_by_value(spark, monkeypatch):
    monkeypatch.setattr(C, "record_hash", lambda scope, record: F.lit(7).cast("bigint"))
    df = edges(spark, {("c", 1): [(1, 1, 1.0, 1), (2, 1, float("nan"), None)]})
    df = df.unionByName(df).withColumn("slot", F.lit(0))
    gone = df.select("file_id", F.col("file_id").alias("kept_in")).limit(0)
    scratch = Scratch(spark, "t")
    m = C.compact(df, RECORD, 32, gone, scratch.path(), scratch, least=1)
    assert [(g.n_records, g.n_repeats) for g in m.groups.collect()] == [(2, 2)]
