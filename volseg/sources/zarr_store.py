"""Zarr arrays of version 2 on a file system that all executors see: read without a library, written chunk by chunk.

Arrays are (C, Z, Y, X). Each storage chunk is written by one task and no two tasks share one; a write of a part of the
volume must fall on storage chunks.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volseg.sources.volume import Boxed, check_aligned, local_path

META = ".zarray"


def _meta(path: str) -> dict:
    with open(os.path.join(local_path(path), META)) as f:
        return json.load(f)


def readable(path: str) -> bool:
    """Whether the folder is an array that :class:`ZarrArray` can decode."""
    if not os.path.exists(os.path.join(local_path(path), META)):
        return False
    meta = _meta(path)
    codec = (meta.get("compressor") or {}).get("id")
    return meta.get("zarr_format") == 2 and not meta.get("filters") and meta.get("order", "C") == "C" and codec in (None, "zlib", "zstd")


def _decode(data: bytes, codec: str | None) -> bytes:
    if codec == "zlib":
        return zlib.decompress(data)
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return data


class ZarrArray(Boxed):
    """An array of three or four dimensions; a chunk that is not stored has the fill value."""

    def __init__(self, path: str):
        self.path, meta = local_path(path), _meta(path)
        self.shape, self.chunks, self.dtype = tuple(meta["shape"]), tuple(meta["chunks"]), np.dtype(meta["dtype"])
        self.fill, self.codec, self.mark = meta.get("fill_value") or 0, (meta.get("compressor") or {}).get("id"), meta.get("dimension_separator", ".")
        if len(self.shape) not in (3, 4):
            raise ValueError(f"{path} has {len(self.shape)} dimensions")

    def read(self, lo: tuple[int, int, int], hi: tuple[int, int, int]) -> np.ndarray:
        if len(self.shape) == 4:
            lo, hi = (0, *lo), (self.shape[0], *hi)
        out = np.full([b - a for a, b in zip(lo, hi)], self.fill, dtype=self.dtype)
        for cell in np.ndindex(*[-(-b // n) - a // n for a, b, n in zip(lo, hi, self.chunks)]):
            cell = [int(i) + a // n for i, a, n in zip(cell, lo, self.chunks)]
            name = os.path.join(self.path, self.mark.join(map(str, cell)))
            if not os.path.exists(name):
                continue
            with open(name, "rb") as f:
                data = np.frombuffer(_decode(f.read(), self.codec), dtype=self.dtype).reshape(self.chunks)
            start = [i * n for i, n in zip(cell, self.chunks)]
            a = [max(x, s) for x, s in zip(lo, start)]
            b = [min(x, s + n) for x, s, n in zip(hi, start, self.chunks)]
            out[tuple(slice(x - q, y - q) for x, y, q in zip(a, b, lo))] = data[tuple(slice(x - s, y - s) for x, y, s in zip(a, b, start))]
        return out


def create(path: str, shape: tuple[int, int, int, int], chunk: tuple[int, int, int], dtype: str) -> None:
    """An empty array (C, Z, Y, X) with storage chunks (z, y, x) of all channels; an existing one is an error."""
    folder = local_path(path)
    os.makedirs(folder)
    meta = {
        "zarr_format": 2, "shape": list(shape), "chunks": [shape[0], *chunk], "dtype": np.dtype(dtype).str, "compressor": {"id": "zlib", "level": 1},
        "fill_value": 0, "order": "C", "filters": None, "dimension_separator": ".",
    }
    with open(os.path.join(folder, META), "w") as f:
        json.dump(meta, f)


def write(voxels: DataFrame, path: str, columns: list[str], box: tuple[int, ...] | None = None) -> int:
    """Write the columns of ``x, y, z, ...`` as channels into an array made by :func:`create`; the chunks written.

    ``box`` (x0, y0, z0, x1, y1, z1), the whole array by default, must fall on storage chunks but for the volume's
    end; every chunk in it that has voxels is replaced, absent voxels being 0. Voxels outside are not written. A
    chunk is put in place by a rename, so a task that runs twice does no harm.
    """
    target = ZarrArray(path)
    n_channels, depth, height, width = target.shape
    if n_channels != len(columns):
        raise ValueError(f"{len(columns)} columns for {n_channels} channels")
    whole = (width, height, depth)
    lo, hi = (tuple(box[:3]), tuple(box[3:])) if box else ((0, 0, 0), whole)
    chunk = tuple(reversed(target.chunks[1:]))
    check_aligned(lo, hi, chunk, whole)
    rows = voxels
    for c, a, b in zip("xyz", lo, hi):
        rows = rows.where((F.col(c) >= a) & (F.col(c) < b))
    rows = rows.select("x", "y", "z", *columns, *[F.floor(F.col(c) / n).cast("int").alias(f"_c{c}") for c, n in zip("xyz", chunk)])
    folder, kind, shape, mark = target.path, target.dtype, target.chunks, target.mark

    def run(table):
        import pyarrow as pa
        from pyspark import TaskContext

        cell = [table.column(f"_c{c}")[0].as_py() for c in "zyx"]
        data = np.zeros(shape, dtype=kind)
        at = tuple(table.column(c).to_numpy() - i * n for c, i, n in zip("zyx", cell, shape[1:]))
        for k, name in enumerate(columns):
            data[(k, *at)] = table.column(name).to_numpy()
        name = os.path.join(folder, mark.join(map(str, [0, *cell])))
        part = f"{name}.{TaskContext.get().taskAttemptId()}.part"
        with open(part, "wb") as f:
            f.write(zlib.compress(data.tobytes(), 1))
        os.replace(part, name)
        return pa.table({"n": pa.array([table.num_rows], pa.int64())})

    return rows.groupBy("_cx", "_cy", "_cz").applyInArrow(run, "n bigint").count()
