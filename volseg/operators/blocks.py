"""Voxel rows taken block by block, each block with the voxels next to its faces.

One shuffle brings every voxel to its block and those at a face to the block beyond it as well, so what is sent is
the volume and its faces, whatever looks at neighbours afterwards. Within a block neighbours are array shifts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

KEY = ["x", "y", "z"]
#: Voxels of a block on each axis where the caller names none; a block is one group of one task.
CHUNK = (128, 128, 128)
_B = ["_bx", "_by", "_bz"]


@dataclass
class Block:
    """A block with its halo: arrays [x, y, z] that are longer than the block by the halo at both ends."""

    low: tuple[int, int, int]
    size: tuple[int, int, int]
    at: tuple[np.ndarray, ...]
    rows: pa.Table
    halo: int = 1

    def array(self, name: str, absent: float = 0) -> np.ndarray:
        values = self.rows.column(name).to_numpy()
        out = np.full([n + 2 * self.halo for n in self.size], absent, dtype=values.dtype)
        out[self.at] = values
        return out

    @property
    def there(self) -> np.ndarray:
        out = np.zeros([n + 2 * self.halo for n in self.size], dtype=bool)
        out[self.at] = True
        return out

    @property
    def inner(self) -> tuple[slice, ...]:
        return tuple(slice(self.halo, n + self.halo) for n in self.size)

    def shifted(self, axis: int, by: int) -> tuple[slice, ...]:
        """The block moved by one voxel on an axis, within the halo."""
        return tuple(slice(self.halo + (by if i == axis else 0), n + self.halo + (by if i == axis else 0)) for i, n in enumerate(self.size))

    def coordinates(self, at: tuple[np.ndarray, ...]) -> dict[str, np.ndarray]:
        """The volume's coordinates of places in the inner block."""
        return {c: (p + o).astype(np.int32) for c, p, o in zip(KEY, at, self.low)}


def per_block(voxels: DataFrame, chunk: tuple[int, int, int], columns: list[str], kernel: Callable[[Block], dict], schema: str, before: bool = True, after: bool = True, halo: int = 1, corners: bool = False) -> DataFrame:
    """Run ``kernel`` on every block that has voxels; it returns columns of ``schema`` as arrays.

    ``columns``: those it reads, never null. ``before`` and ``after`` say which neighbours it looks at, ``halo`` how far
    (at most as far as the next block), ``corners`` whether also across edges and corners. Coordinates start at 0.
    """
    if halo > min(chunk):
        raise ValueError(f"a halo of {halo} reaches beyond the next block of {chunk}")
    home = [F.floor(F.col(c) / n).cast("int") for c, n in zip(KEY, chunk)]
    near = [{-1: (F.pmod(F.col(c), F.lit(n)) < halo) & (F.col(c) >= n), 0: F.lit(True), 1: F.pmod(F.col(c), F.lit(n)) >= n - halo} for c, n in zip(KEY, chunk)]
    copies = []
    for step in product((-1, 0, 1), repeat=3):
        moved = sum(map(abs, step))
        # a voxel at the high end of its block lies before the next one, and the other way round
        if (moved > 1 and not corners) or (1 in step and not before) or (-1 in step and not after):
            continue
        wanted = near[0][step[0]] & near[1][step[1]] & near[2][step[2]]
        copies.append(F.when(wanted, F.struct(*[(b + d).alias(k) for b, d, k in zip(home, step, _B)])))
    rows = voxels.select(*KEY, *columns, F.explode(F.array_compact(F.array(*copies))).alias("_b")).select("_b.*", *KEY, *columns)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(table: pa.Table) -> pa.Table:
        low = tuple(table.column(b)[0].as_py() * n for b, n in zip(_B, chunk))
        at = tuple(table.column(c).to_numpy().astype(np.int64) - o + halo for c, o in zip(KEY, low))
        inside = np.logical_and.reduce([(p >= halo) & (p < n + halo) for p, n in zip(at, chunk)])
        if not inside.any():
            return target.empty_table()
        out = kernel(Block(low, chunk, at, table, halo))
        return pa.table([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return rows.groupBy(*_B).applyInArrow(run, schema)
