import os
import struct
import tempfile
import zlib

import numpy as np
import pytest

from volseg.sources import tables as T
from volseg.sources import volume as V
from volseg.sources import zarr_store as Z


def test_paths_and_options():
    assert [V.kind_of(p) for p in ("a.npy", "a.h5::main", "file:///x%20y/a.zarr", "folder")] == ["npy", "h5", "zarr", "store"]
    assert V.local_path("file:///x%20y") == "/x y" and V.local_path("/a%20b") == "/a%20b"
    V.reject_unsupported({"mip": "0"})
    for bad in ({"mip": "1"}, {"fill_missing": "true"}, {"bounded": "false"}):
        with pytest.raises(ValueError):
            V.reject_unsupported(bad)
    V.check_aligned((0, 4), (4, 6), (4, 4), (8, 6))
    with pytest.raises(ValueError):
        V.check_aligned((0, 2), (4, 6), (4, 4), (8, 6))


class Stub:
    """What h5py gives for a file with one dataset."""

    def __init__(self, data, start):
        self.data, self.start, self.closed = data, start, False
        self.shape, self.dtype, self.attrs = data.shape, data.dtype, {"chunk_start_zyx": start}

    def keys(self):
        return ["main"]

    def __getitem__(self, key):
        return self if key == "main" else self.data[key]

    def close(self):
        self.closed = True


def store(whole, cells, **how):
    opened = []

    def opener(path):
        cell = tuple(map(int, V.CHUNK_NAME.match(os.path.basename(path)).groups()))
        if cell not in cells:
            raise FileNotFoundError(path)
        lo = [i * 6 for i in cell]
        stub = Stub(whole[(slice(None), *[slice(a, a + 6) for a in lo])], str(how.pop("start", lo)))
        opened.append(stub)
        return stub

    names = [f"chunk_z{z}_y{y}_x{x}.h5" for z, y, x in cells] + ["other.h5"]
    return V.ChunkStore("s", opener=opener, names=names, **{k: v for k, v in how.items() if k != "start"}), opened


def test_chunk_store():
    whole = np.random.default_rng(1).random((2, 12, 12, 12), dtype=np.float32)
    every = {(z, y, x) for z in (0, 1) for y in (0, 1) for x in (0, 1)}
    s, opened = store(whole, every)
    assert s.shape == whole.shape and np.array_equal(s[:], whole) and np.array_equal(s[1, 2:9, 3:6, :10], whole[1, 2:9, 3:6, :10])
    assert np.array_equal(s[..., 7, 2:8, 0:12], whole[:, 7, 2:8])
    some = every - {(1, 1, 1)}
    s, _ = store(whole, some)
    assert not s[:, 6:, 6:, 6:].any() and np.array_equal(s[:, :6], whole[:, :6])  # listed: an absent cell is zero
    s, _ = store(whole, some, bbox=(0, 0, 0, 12, 12, 12))
    assert np.array_equal(s[:, :6], whole[:, :6])
    with pytest.raises(FileNotFoundError):  # with a box it must be there
        s[:]
    with pytest.raises(ValueError, match="starts at"):
        store(whole, every, start="[0, 0, 6]")
    with pytest.raises(ValueError, match="no chunk"):
        store(whole, set())
    with pytest.raises(ValueError, match="strided"):
        store(whole, every)[0][:, ::2]


def test_handles_are_closed():
    files = {}
    h = V.Handles(lambda p: files.setdefault(p, Stub(np.zeros((1, 1, 1, 1)), "[0, 0, 0]")), most=2)
    for p in ("a", "b", "a", "c"):
        h.get(p)
    assert [f.closed for f in files.values()] == [False, True, False]


def test_chunk_store_as_a_table(spark, monkeypatch, tmp_path):
    pytest.importorskip("h5py")
    import h5py

    whole = np.random.default_rng(3).random((1, 6, 6, 12), dtype=np.float32)
    for x in (0, 1):
        with h5py.File(tmp_path / f"chunk_z0_y0_x{x}.h5", "w") as f:
            f.create_dataset("main", data=whole[..., x * 6 : x * 6 + 6]).attrs["chunk_start_zyx"] = f"[0, 0, {x * 6}]"
    V.register(spark)
    rows = spark.read.format("volume").option("path", str(tmp_path)).load().collect()
    assert len(rows) == 432 and all(abs(r.c0 - whole[0, r.z, r.y, r.x]) < 1e-6 for r in rows)


def test_zarr_round_trip(spark, tmp_path):
    data = np.random.default_rng(4).random((2, 6, 5, 8))
    rows = [(x, y, z, float(data[0, z, y, x]), float(data[1, z, y, x])) for z in range(6) for y in range(5) for x in range(8)]
    df = spark.createDataFrame(rows, "x int, y int, z int, a double, b double")
    path = str(tmp_path / "v.zarr")
    Z.create(path, data.shape, (4, 4, 4), "float64")
    assert Z.write(df, path, ["a", "b"]) == 8
    assert np.array_equal(Z.ZarrArray(path)[:], data)
    assert Z.write(df.withColumn("a", df.a * 0), path, ["a", "b"], (4, 0, 0, 8, 4, 4)) == 1
    data[0, :4, :4, 4:] = 0
    assert np.array_equal(Z.ZarrArray(path)[:], data)
    with pytest.raises(ValueError):
        Z.write(df, path, ["a", "b"], (2, 0, 0, 8, 4, 4))
    V.register(spark)
    back = spark.read.format("volume").option("path", path).option("box", "1,0,1,5,3,4").load().collect()
    assert len(back) == 4 * 3 * 3 and all(r.c1 == data[1, r.z, r.y, r.x] for r in back)


def test_volume_format(spark):
    data = np.random.default_rng(2).random((3, 4, 5, 6))
    path = os.path.join(tempfile.mkdtemp(), "v.npy")
    np.save(path, data)
    V.register(spark)
    df = spark.read.format("volume").option("path", path).option("channels", "2,0").option("box", "1,0,1,5,3,4").load()
    rows = df.collect()
    assert df.columns == ["x", "y", "z", "c2", "c0"] and len(rows) == 4 * 3 * 3
    assert all(r.c2 == data[2, r.z, r.y, r.x] and r.c0 == data[0, r.z, r.y, r.x] for r in rows)


def test_packed_tables(spark):
    rows = [(1, 2, 0.5, 3), (4, 5, 1.5, 6)]
    data = b"".join(struct.pack("<QQdQ", *r) for r in rows)
    assert list(T.decode(data, "residual_rg").itertuples(index=False, name=None)) == rows
    with pytest.raises(ValueError):
        T.decode(data[:-1], "residual_rg")
    with pytest.raises(ValueError):
        T.decode(struct.pack("<QQ", 1 << 63, 1), "remap")
    folder = tempfile.mkdtemp()
    for name in "ab":
        with open(f"{folder}/{name}.data", "wb") as f:
            f.write(data)
    got = T.read_packed(spark, folder, "residual_rg").select("s1", "s2", "aff", "area").collect()
    assert sorted(map(tuple, got)) == sorted(rows * 2)


def test_sliced_files(spark, tmp_path):
    slices = {7: b"abc", 3: b"", 9: b"xyz" * 50}
    data = T.write_sliced(slices)
    assert T.read_sliced(data) == {7: b"abc", 9: slices[9]} and T.read_sliced(data, 9) == {9: slices[9]}
    assert data[:4] == T.MAGIC and T.read_sliced(T.write_sliced({})) == {} and T.read_sliced(data, 8) == {}
    broken = bytearray(data)
    broken[22] ^= 1
    with pytest.raises(ValueError, match="chunk 7"):
        T.read_sliced(bytes(broken))
    with pytest.raises(ValueError):
        T.read_sliced(b"none" + data)
    with pytest.raises(ValueError):
        T.read_sliced(data, record=8)
    # older footers: a checksum and four zeros, or eight zeros
    for foot in (struct.pack("<I", zlib.crc32(b"abcd")) + bytes(4), bytes(8)):
        index = T._sealed(struct.pack("<QQQ", 5, 20, 4 + len(foot)))
        old = T.MAGIC + struct.pack("<QQ", 24 + len(foot), len(index)) + b"abcd" + foot + index
        assert T.read_sliced(old, record=4) == {5: b"abcd"}
    remap = {1: struct.pack("<QQQQ", 4, 2, 6, 2), 2: struct.pack("<QQ", 9, 8)}
    for name in "ab":
        (tmp_path / f"{name}.data").write_bytes(T.write_sliced(remap))
    every = T.read_sliced_files(spark, str(tmp_path), "remap")
    assert sorted((r.old, r.new, r.chunk) for r in every.collect()) == sorted([(4, 2, 1), (6, 2, 1), (9, 8, 2)] * 2)
    assert T.read_sliced_files(spark, str(tmp_path), "remap", 2).count() == 2


def test_large_chunks_are_cut(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "CASE WHEN id < 900 THEN 'big' ELSE concat('c', id % 5) END AS chunk_tag")
    T.write_by_chunk(df, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {r.chunk_tag: r["count"] for r in back.groupBy("chunk_tag").count().collect()} == {"big": 900, **{f"c{i}": 20 for i in range(5)}}
