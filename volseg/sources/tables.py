"""Packed binary tables of older runs, and tables partitioned by chunk."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from volseg.schema import ID_LIMIT

#: Record layouts, packed without padding.
LAYOUTS: dict[str, list[tuple[str, str]]] = {
    "residual_rg": [("s1", "<u8"), ("s2", "<u8"), ("aff", "<f8"), ("area", "<u8")],
    "remap": [("old", "<u8"), ("new", "<u8")],
    "counts": [("sid", "<u8"), ("size", "<u8")],
    "matching_faces": [("oid", "<u8"), ("boundary_size", "<u8"), ("nid", "<u8"), ("agg_size", "<u8")],
    "nuclei": [("sid", "<u8"), ("state", "u1"), ("id", "<u4"), ("count", "<u8"), ("total", "<u8")],
}
#: Sliced files: this mark, place and size of the index, the slices, each followed by its CRC-32, and the index (chunk,
#: place, size with the checksum), followed by its own.
MAGIC = b"SO01"
_HEAD, _ENTRY = struct.Struct("<QQ"), struct.Struct("<QQQ")


def decode(data: bytes, layout: str) -> pd.DataFrame:
    """The records of a packed table. A length that is no whole number of records, and ids from 2^63 on, are errors."""
    kind = np.dtype(LAYOUTS[layout])
    if len(data) % kind.itemsize:
        raise ValueError(f"{len(data)} bytes are no whole number of records of {kind.itemsize} bytes")
    rows = np.frombuffer(data, dtype=kind)
    out = {}
    for name, form in LAYOUTS[layout]:
        col = rows[name]
        if form == "<u8":
            if col.size and int(col.max()) >= ID_LIMIT:
                raise ValueError(f"{name} holds a number beyond 2^63 - 1")
            col = col.astype(np.int64)
        elif form != "<f8":
            col = col.astype(np.int64)
        out[name] = col
    return pd.DataFrame(out)


def read_packed(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """All packed files below ``path`` as one table with their ``path``; each file is decoded in one task."""
    fields = ", ".join(f"{n} {'double' if f == '<f8' else 'bigint'}" for n, f in LAYOUTS[layout])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, content in zip(pdf["path"], pdf["content"]):
                yield decode(bytes(content), layout).assign(path=name)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, f"{fields}, path string")


def _sealed(data: bytes) -> bytes:
    return data + struct.pack("<I", zlib.crc32(data))


def _opened(data: bytes, record: int, what: str) -> bytes:
    """A slice or index without its footer: a CRC-32, or as older files have it a CRC-32 and four zeros, or eight zeros.

    What is left must be whole records; anything else is an error.
    """
    for size, fits in (
        (4, lambda d: struct.unpack("<I", d[-4:])[0] == zlib.crc32(d[:-4])),
        (8, lambda d: d[-4:] == bytes(4) and struct.unpack("<I", d[-8:-4])[0] == zlib.crc32(d[:-8])),
        (8, lambda d: d[-8:] == bytes(8)),
    ):
        if len(data) >= size and (len(data) - size) % record == 0 and fits(data):
            return data[:-size]
    raise ValueError(f"{what} is damaged")


def write_sliced(slices: dict[int, bytes]) -> bytes:
    """A sliced file: payload by chunk with checksums, and an index. Empty slices are left out."""
    out, index = bytearray(MAGIC + bytes(_HEAD.size)), []
    for chunk, payload in sorted(slices.items()):
        if payload:
            index.append(_ENTRY.pack(chunk, len(out), len(payload) + 4))
            out += _sealed(payload)
    table = _sealed(b"".join(index))
    out[len(MAGIC) : len(MAGIC) + _HEAD.size] = _HEAD.pack(len(out), len(table))
    return bytes(out + table)


def read_sliced(data: bytes, chunk: int | None = None, record: int = 1) -> dict[int, bytes]:
    """The slices of a file, or that of one chunk; a wrong checksum, or a slice that is no whole records, is an error."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a sliced file")
    start, size = _HEAD.unpack(data[len(MAGIC) : len(MAGIC) + _HEAD.size])
    index = _opened(data[start : start + size], _ENTRY.size, "the index")
    out = {}
    for key, begin, n in _ENTRY.iter_unpack(index):
        if chunk is None or key == chunk:
            out[key] = _opened(data[begin : begin + n], record, f"the slice of chunk {key}")
    return out


def read_sliced_files(spark: SparkSession, path: str, layout: str, chunk: int | None = None) -> DataFrame:
    """The records of all sliced files below ``path``, or those of one chunk, with ``chunk`` and ``path``."""
    fields = ", ".join(f"{n} {'double' if f == '<f8' else 'bigint'}" for n, f in LAYOUTS[layout])
    size = np.dtype(LAYOUTS[layout]).itemsize

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, content in zip(pdf["path"], pdf["content"]):
                for key, payload in read_sliced(bytes(content), chunk, size).items():
                    yield decode(payload, layout).assign(chunk=key, path=name)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, f"{fields}, chunk bigint, path string")


def write_by_chunk(df: DataFrame, path: str, chunk: str = "chunk_tag") -> None:
    """A table partitioned by chunk: the index that slices need is the folder structure, and reads are pruned by it.

    Rows are rebalanced by chunk: small chunks share tasks, and one that is too large for a task is cut into several
    files.
    """
    df.hint("rebalance", chunk).write.mode("overwrite").partitionBy(chunk).parquet(path)
