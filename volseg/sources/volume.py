"""Dense volumes as tables: a Python data source over npy, HDF5, Zarr and stores of HDF5 chunks.

Arrays are stored as (C, Z, Y, X) or (Z, Y, X); rows come out as x, y, z and one column for each channel. Files are
opened where they are read: one block of planes to a partition, of a chunk store one cell of its grid. Optional
libraries are imported only then; Zarr arrays of version 2 need none (see ``zarr_store``).
"""

from __future__ import annotations

import json
import os
import re
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Handles that a reader of a chunk store keeps open.
OPEN_HANDLES = 8
CHUNK_NAME = re.compile(r"^chunk_z(\d+)_y(\d+)_x(\d+)\.h5$")


def local_path(uri: str) -> str:
    """The path of a file URI, percent signs decoded; other paths as they are."""
    return unquote(uri[7:]) if uri.startswith("file://") else uri


def kind_of(path: str) -> str:
    """``npy``, ``h5``, ``zarr`` or ``store``, told by the path's form."""
    path = local_path(path)
    if path.endswith(".npy"):
        return "npy"
    if ".h5" in path or ".hdf5" in path:
        return "h5"
    if path.rstrip("/").endswith(".zarr") or ".zarr/" in path:
        return "zarr"
    return "store"


def reject_unsupported(options: dict) -> None:
    """Local volumes have one resolution and fixed bounds; other wishes are errors, not silently ignored."""
    if int(options.get("mip", 0)) != 0:
        raise ValueError("local volumes have mip 0 only")
    for name in ("fill_missing", "bounded"):
        if options.get(name, "").lower() == ("true" if name == "fill_missing" else "false"):
            raise ValueError(f"{name} is not supported for local volumes")


class Handles:
    """The last few files opened, by path."""

    def __init__(self, opener, most: int = OPEN_HANDLES):
        self.opener, self.most, self.open = opener, most, OrderedDict()

    def get(self, path: str):
        if path in self.open:
            self.open.move_to_end(path)
        else:
            if len(self.open) >= self.most:
                _, old = self.open.popitem(last=False)
                old.close() if hasattr(old, "close") else None
            self.open[path] = self.opener(path)
        return self.open[path]


def _range(key, size: int) -> tuple[int, int]:
    if isinstance(key, slice):
        start, stop, step = key.indices(size)
        if step != 1:
            raise ValueError("strided reads are not supported")
        return start, max(start, stop)
    return int(key), int(key) + 1


class Boxed:
    """Basic slicing for arrays of ``shape`` that can read a box of all their channels."""

    shape: tuple[int, ...]

    def read(self, lo: tuple[int, ...], hi: tuple[int, ...]) -> np.ndarray:
        raise NotImplementedError

    def __getitem__(self, key) -> np.ndarray:
        key = key if isinstance(key, tuple) else (key,)
        at = next((i for i, k in enumerate(key) if k is Ellipsis), len(key))
        before, after = key[:at], key[at + 1 :]
        key = (*before, *[slice(None)] * (len(self.shape) - len(before) - len(after)), *after)
        box = [_range(k, n) for k, n in zip(key, self.shape)]
        space = box[-3:]
        out = self.read(tuple(a for a, _ in space), tuple(b for _, b in space))
        if len(box) == 4:
            out = out[box[0][0] : box[0][1]]
        whole = [slice(None) if isinstance(k, slice) else 0 for k in key]
        return out[tuple(whole)]


class ChunkStore(Boxed):
    """HDF5 files of equal chunks (C, Z, Y, X), ``chunk_z{i}_y{j}_x{k}.h5`` by their place in the grid, as one array.

    With a ``bbox`` (x0, y0, z0, x1, y1, z1) the cells that it covers must all be there: names follow from the grid,
    and a file that is missing is an error when it is read. Without one the folder is listed, once, and a cell that
    is not listed is zero. A file that cannot be read is an error in both cases. The chunk's size and the dataset, if
    none is named, are those of the first cell, whose stated start must agree with its name.
    """

    def __init__(self, folder: str, dataset: str | None = None, bbox: tuple[int, ...] | None = None, opener=None, names: list[str] | None = None):
        self.folder = folder.rstrip("/")
        self.handles = Handles(opener or self._open)
        if bbox is None:
            found = [m for m in map(CHUNK_NAME.match, os.listdir(self.folder) if names is None else names) if m]
            if not found:
                raise ValueError(f"{folder} holds no chunk_z*_y*_x*.h5")
            self.cells: set[tuple[int, ...]] | None = {tuple(map(int, m.groups())) for m in found}
            first = min(self.cells)
        else:
            self.cells, first = None, (0, 0, 0)
        file = self.handles.get(self.name(first))
        if dataset is None:
            inside = list(file.keys())
            if len(inside) != 1:
                raise ValueError(f"{self.name(first)} has the datasets {inside}; name one")
            dataset = inside[0]
        self.dataset = dataset
        data = file[dataset]
        if len(data.shape) != 4:
            raise ValueError(f"{self.name(first)} is no array (C, Z, Y, X): {data.shape}")
        self.chunk, self.dtype = tuple(int(n) for n in data.shape[1:]), data.dtype
        start = [i * n for i, n in zip(first, self.chunk)]
        stated = getattr(data, "attrs", {}).get("chunk_start_zyx")
        if stated is not None and list(json.loads(str(stated))) != start:
            raise ValueError(f"{self.name(first)} says it starts at {stated}, its name says {start}")
        if bbox is None:
            grid = [max(c[i] for c in self.cells) + 1 for i in range(3)]
        else:
            grid = [-(-bbox[k] // n) for k, n in zip((5, 4, 3), self.chunk)]
        self.shape = (int(data.shape[0]), *[g * n for g, n in zip(grid, self.chunk)])

    @staticmethod
    def _open(path: str):
        import h5py

        return h5py.File(path, "r", locking=False)

    def name(self, cell: tuple[int, ...]) -> str:
        return "{}/chunk_z{}_y{}_x{}.h5".format(self.folder, *cell)

    def read(self, lo: tuple[int, int, int], hi: tuple[int, int, int]) -> np.ndarray:
        """The box lo..hi (z, y, x; stop exclusive) of all channels."""
        out = np.zeros((self.shape[0], *[b - a for a, b in zip(lo, hi)]), dtype=self.dtype)
        for cell in np.ndindex(*[-(-b // n) - a // n for a, b, n in zip(lo, hi, self.chunk)]):
            cell = tuple(int(i) + a // n for i, a, n in zip(cell, lo, self.chunk))
            if self.cells is not None and cell not in self.cells:
                continue
            start = [i * n for i, n in zip(cell, self.chunk)]
            a = [max(x, s) for x, s in zip(lo, start)]
            b = [min(x, s + n) for x, s, n in zip(hi, start, self.chunk)]
            data = self.handles.get(self.name(cell))[self.dataset]
            out[(slice(None), *[slice(x - q, y - q) for x, y, q in zip(a, b, lo)])] = data[(slice(None), *[slice(x - s, y - s) for x, y, s in zip(a, b, start)])]
        return out


def open_array(path: str, dataset: str | None = None, bbox: str | None = None):
    """An array that can be sliced without being read whole; ``bbox``: the cells that a chunk store must have."""
    path, kind = local_path(path), kind_of(path)
    if kind == "npy":
        return np.load(path, mmap_mode="r")
    if kind == "h5":
        import h5py

        name, _, inner = path.partition("::")
        file = h5py.File(name, "r")
        inner = inner or dataset
        if not inner:
            names = list(file.keys())
            if len(names) != 1:
                raise ValueError(f"{name} has the datasets {names}; name one as file::dataset")
            inner = names[0]
        return file[inner]
    if kind == "store":
        return ChunkStore(path, dataset, tuple(int(n) for n in bbox.split(",")) if bbox else None)
    from volseg.sources.zarr_store import ZarrArray, readable

    if readable(path):
        return ZarrArray(path)
    import zarr

    return zarr.open(path, mode="r")


def check_aligned(lo: tuple[int, ...], hi: tuple[int, ...], chunk: tuple[int, ...], extent: tuple[int, ...]) -> None:
    """A write must cover whole storage chunks, so that two writers never share one; only the volume's end is ragged."""
    for a, b, c, e in zip(lo, hi, chunk, extent):
        if a % c or (b % c and b != e):
            raise ValueError(f"the box {lo}..{hi} does not fall on storage chunks of {chunk}")


class _Box(InputPartition):
    def __init__(self, lo: tuple[int, int, int], hi: tuple[int, int, int]):
        self.lo, self.hi = lo, hi


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.options, self.names = options, names

    def _open(self):
        return open_array(self.options["path"], self.options.get("dataset"), self.options.get("bbox"))

    def _box(self, shape: tuple[int, ...]) -> tuple[list[int], list[int]]:
        text = self.options.get("box")
        if not text:
            return [0, 0, 0], [shape[-1], shape[-2], shape[-3]]
        n = [int(v) for v in text.split(",")]
        return n[:3], n[3:]

    def partitions(self) -> list[InputPartition]:
        data = self._open()
        lo, hi = self._box(data.shape)
        step = [data.chunk[2], data.chunk[1], data.chunk[0]] if isinstance(data, ChunkStore) else [hi[0], hi[1], int(self.options.get("planes", 16))]
        grid = [[(max(a, k), min(b, k + n)) for k in range(a // n * n if isinstance(data, ChunkStore) else a, b, max(1, n))] for a, b, n in zip(lo, hi, step)]
        return [_Box((x[0], y[0], z[0]), (x[1], y[1], z[1])) for z in grid[2] for y in grid[1] for x in grid[0]]

    def read(self, partition: _Box) -> Iterator[pa.RecordBatch]:
        data = self._open()
        (x0, y0, z0), (x1, y1, z1) = partition.lo, partition.hi
        for z in range(z0, z1):
            plane = np.asarray(data[..., z, y0:y1, x0:x1])
            plane = plane[None] if plane.ndim == 2 else plane
            channels = [int(c) for c in self.options["channels"].split(",")] if self.options.get("channels") else range(plane.shape[0])
            y, x = np.mgrid[y0:y1, x0:x1]
            cols = [x.ravel().astype(np.int32), y.ravel().astype(np.int32), np.full(x.size, z, np.int32), *[plane[c].ravel().astype(np.float64) for c in channels]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=self.names)


class VolumeSource(DataSource):
    """``spark.read.format("volume").option("path", ...)``.

    Options: ``dataset``, ``channels`` (numbers, comma-separated), ``box`` (x0,y0,z0,x1,y1,z1), ``planes`` to a
    partition, ``bbox`` (the extent that a chunk store must have, in the same form). Column pruning is by ``channels``, cutouts by ``box``.
    """

    @classmethod
    def name(cls) -> str:
        return "volume"

    def _names(self) -> list[str]:
        reject_unsupported(self.options)
        shape = open_array(self.options["path"], self.options.get("dataset"), self.options.get("bbox")).shape
        if self.options.get("channels"):
            channels = self.options["channels"].split(",")
        else:
            channels = [str(c) for c in range(shape[0] if len(shape) == 4 else 1)]
        return ["x", "y", "z", *[f"c{c}" for c in channels]]

    def schema(self) -> str:
        return ", ".join(f"{n} int" if n in "xyz" else f"{n} double" for n in self._names())

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), self._names())


def register(spark) -> None:
    """Make ``format("volume")`` known to a session."""
    spark.dataSource.register(VolumeSource)
