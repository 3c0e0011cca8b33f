"""Affinities made ready: scaling, shifts, masks, erosion, noise.

A voxel row holds the affinities of its three edges to the voxel before it on each axis. A voxel that is absent
counts as zero. Neighbours are met within blocks that see the voxels beside them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volseg.operators import kernels
from volseg.operators.blocks import CHUNK, Block, per_block

AXES = ("x", "y", "z")
KEY = ["x", "y", "z"]
AFFINITIES = ["ax", "ay", "az"]


def clip(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def scale_integer(c: Column, low: int, high: int) -> Column:
    """An integer type's range as 0..1."""
    return (c - low) / F.lit(float(high - low))


def sigmoid_restore(c: Column, scale: float, eps: float = 1e-6) -> Column:
    """``sigmoid(logit(p) / scale)`` with p kept off 0 and 1."""
    p = F.least(F.greatest(c, F.lit(eps)), F.lit(1 - eps))
    return 1 / (1 + F.exp(-F.ln(p / (1 - p)) / scale))


_ROW = "x int, y int, z int, ax double, ay double, az double"


def _with_before(df: DataFrame, columns: list[str], chunk: tuple[int, int, int], edit: Callable[[Block], list[np.ndarray]], label: str | None = None) -> DataFrame:
    """``x, y, z`` with the affinities that ``edit`` makes of a block and the voxels before it, and ``label`` as it is."""
    kind = f", {label} {df.schema[label].dataType.simpleString()}" if label else ""

    def run(block: Block) -> dict:
        at = np.nonzero(block.there[block.inner])
        out = {**block.coordinates(at), **dict(zip(AFFINITIES, (a[at] for a in edit(block))))}
        return {**out, label: block.array(label)[block.inner][at]} if label else out

    return per_block(df, chunk, columns, run, _ROW + kind, after=False)


def shift_channels(df: DataFrame, chunk: tuple[int, int, int] = CHUNK) -> DataFrame:
    """Edges kept at their first voxel, with channels in reverse order, become edges at their second voxel.

    ``dst[c, v] = clip(src[reversed c, v - 1])``; where a voxel has no predecessor the edge is 0.
    """
    return _with_before(df, AFFINITIES, chunk, lambda b: [np.clip(b.array(AFFINITIES[2 - i])[b.shifted(i, -1)], 0.0, 1.0) for i in range(3)])


def checked_extent(df: DataFrame, extent: tuple[int, int, int], what: str) -> DataFrame:
    """The rows, each checked to lie within 0..extent; one outside is an error when it is read."""
    outside = F.lit(False)
    for c, e in zip(KEY, extent):
        outside = outside | (F.col(c) < 0) | (F.col(c) >= e)
    x = F.when(outside, F.raise_error(F.lit(f"{what} is larger than the volume")).cast("int")).otherwise(F.col("x"))
    return df.select(*[x.alias(c) if c == "x" else F.col(c) for c in df.columns])


def keep_mask(df: DataFrame, mask: DataFrame, extent: tuple[int, int, int] | None = None) -> DataFrame:
    """All affinities zero where ``mask`` (``x, y, z, keep``) has 0; voxels that it does not name are kept.

    With ``extent`` a mask that reaches beyond the volume is an error.
    """
    mask = mask if extent is None else checked_extent(mask, extent, "the mask")
    rows = df.join(mask.select(*KEY, F.col("keep").alias("_keep")), KEY, "left")
    kept = F.coalesce("_keep", F.lit(1)) != 0
    return rows.select(*[F.when(kept, F.col(c)).otherwise(0.0).alias(c) if c in AFFINITIES else F.col(c) for c in df.columns])


def myelin_mask(df: DataFrame, myelin: str, threshold: float, chunk: tuple[int, int, int] = CHUNK) -> DataFrame:
    """``x, y, z``, the affinities and ``myelin``: an edge is zero if either of its voxels has at least ``threshold`` of it."""
    def edit(b: Block) -> list[np.ndarray]:
        high = (b.array(myelin) >= threshold) & b.there
        return [np.where(high[b.inner] | high[b.shifted(i, -1)], 0.0, b.array(a)[b.inner]) for i, a in enumerate(AFFINITIES)]

    return _with_before(df, [*AFFINITIES, myelin], chunk, edit, myelin)


def semantic_mask(df: DataFrame, label: str, chunk: tuple[int, int, int] = CHUNK) -> DataFrame:
    """``x, y, z``, the affinities and ``label``: an edge is zero if its voxels have different labels and neither is 0."""
    def edit(b: Block) -> list[np.ndarray]:
        codes = b.array(label)
        here, out = codes[b.inner], []
        for i, a in enumerate(AFFINITIES):
            before = codes[b.shifted(i, -1)]
            out.append(np.where((here != 0) & (before != 0) & (here != before), 0.0, b.array(a)[b.inner]))
        return out

    return _with_before(df, [*AFFINITIES, label], chunk, edit, label)


def single_channel(df: DataFrame, value: str, extent: tuple[int, int, int]) -> DataFrame:
    """A probability map as affinities: the least of a voxel and the one before, which at 0 is the last (as a roll)."""
    rows = df
    for i, (a, n) in enumerate(zip(AXES, extent)):
        before = df.select(*[F.pmod(F.col(c) + 1, F.lit(n)).cast("int").alias(c) if c == a else F.col(c) for c in KEY], F.col(value).alias(f"_{i}"))
        rows = rows.join(before, KEY, "left")
    return rows.select(*KEY, *[F.least(F.col(value), F.coalesce(f"_{i}", F.lit(0.0))).alias(a) for i, a in enumerate(AFFINITIES)])


#: Radius and factor of each erosion of an axis, and the affinity below which an edge counts as weak.
EROSIONS = ((10, 0.7), (10, 0.7), (2, 0.7))
WEAK = 0.5


def erode(df: DataFrame, radii: dict[int, list[int]], factor: float = 0.7, weak: float = WEAK) -> DataFrame:
    """Around runs of weak edges all channels are lessened: for each axis and radius, larger radii first.

    A voxel is scaled if all voxels within the radius on the axis have 0 < a < ``weak``; voxels outside the volume
    do not count. Later axes see what earlier ones did.
    """
    for axis, sizes in radii.items():
        a, channel = AXES[axis], AFFINITIES[axis]
        for r in sorted(sizes, reverse=True):
            line = Window.partitionBy(*[c for c in KEY if c != a]).orderBy(a).rangeBetween(-r, r)
            flag = F.when((F.col(channel) > 0) & (F.col(channel) < weak), 1).otherwise(0)
            df = df.withColumn("_weak", F.min(flag).over(line))
            df = df.select(*[F.when(F.col("_weak") == 1, F.col(c) * factor).otherwise(F.col(c)).alias(c) if c in AFFINITIES else F.col(c) for c in df.columns if c != "_weak"])
    return df


def close_runs(df: DataFrame, axis: int, radius: int) -> DataFrame:
    """Grey closing of one channel along an axis: the greatest within the radius, then the least of those."""
    a, channel = AXES[axis], AFFINITIES[axis]
    line = Window.partitionBy(*[c for c in KEY if c != a]).orderBy(a).rangeBetween(-radius, radius)
    df = df.withColumn("_max", F.max(channel).over(line)).withColumn(channel, F.min("_max").over(line))
    return df.drop("_max")


def close_gaps(df: DataFrame, radii: tuple[int, int, int], factors: tuple[float, float, float] = (0.7, 0.7, 0.7), threshold: float = WEAK, chunk: tuple[int, int, int] = CHUNK) -> DataFrame:
    """Gaps between weak edges lessened (see :func:`kernels.close_affinities`), block by block.

    A block sees the voxels that its radii can bring into play, twice the greatest on each side, also across corners.
    """
    def run(block: Block) -> dict:
        aff = np.stack([block.array(a) for a in AFFINITIES])
        out = kernels.close_affinities(aff, radii, factors, threshold)
        at = np.nonzero(block.there[block.inner])
        return {**block.coordinates(at), **{a: out[i][block.inner][at] for i, a in enumerate(AFFINITIES)}}

    return per_block(df, chunk, AFFINITIES, run, "x int, y int, z int, ax double, ay double, az double", halo=2 * max(radii), corners=True)


def noise(df: DataFrame, sigma: float, seed: int) -> DataFrame:
    """Gaussian noise on affinities other than 0, the same for a voxel whatever the partitioning; clipped to 0..1.

    Two uniform numbers come from the first 52 bits of the MD5 of ``seed:channel:number:x:y:z``.
    """
    def uniform(i: int, j: int) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(f"{seed}:{i}:{j}"), *[F.col(c).cast("string") for c in KEY]))
        return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)

    def gauss(i: int) -> Column:
        return F.sqrt(-2 * F.ln(uniform(i, 0))) * F.cos(2 * F.pi() * uniform(i, 1))

    out = {a: F.when(F.col(a) != 0, clip(F.col(a) + sigma * gauss(i))).otherwise(0.0) for i, a in enumerate(AFFINITIES)}
    return df.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


def pad(df: DataFrame, extent: tuple[int, int, int], low: dict[str, int], high: dict[str, int]) -> DataFrame:
    """The volume with planes of zero affinity beyond its real ends: so many before 0 and behind ``extent`` on each axis.

    Only the planes are made, each cell numbered by a range that is spread over the tasks; voxels that the volume
    itself lacks stay absent, which counts as zero as well.
    """
    spark = df.sparkSession
    lo = [-low.get(c, 0) for c in KEY]
    size = [e + low.get(c, 0) + high.get(c, 0) for c, e in zip(KEY, extent)]
    out = df.select(*KEY, *AFFINITIES)
    for i, c in enumerate(KEY):
        planes = [*range(lo[i], 0), *range(extent[i], extent[i] + high.get(c, 0))]
        # what earlier axes have covered is left to them
        first = [0 if j < i else a for j, a in enumerate(lo)]
        span = [len(planes) if j == i else extent[j] if j < i else n for j, n in enumerate(size)]
        n = span[0] * span[1] * span[2]
        if not n:
            continue
        cells = spark.range(n)
        place, at = F.col("id"), []
        for j in range(3):
            k = place % span[j]
            at.append(F.element_at(F.array(*[F.lit(p) for p in planes]), (k + 1).cast("int")) if j == i else k + first[j])
            place = F.floor(place / span[j])
        out = out.unionByName(cells.select(*[a.cast("int").alias(k) for a, k in zip(at, KEY)], *[F.lit(0.0).alias(a) for a in AFFINITIES]))
    return out


def source_index(c: Column, ratio: int, offset: int, size: int) -> Column:
    """Nearest source coordinate of an upsampled one, kept within the source."""
    return F.least(F.greatest(F.floor((c + ratio // 2) / ratio) + offset, F.lit(0)), F.lit(size - 1)).cast("int")


def upsample(df: DataFrame, source: DataFrame, value: str, ratio: tuple[int, int, int], offset: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """``df`` with the nearest ``value`` of a coarser volume; 0 where the source has no voxel."""
    keyed = df.select("*", *[source_index(F.col(c), r, o, n).alias(f"_{c}") for c, r, o, n in zip(KEY, ratio, offset, size)])
    coarse = source.select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col(value).alias("_value"))
    joined = keyed.join(coarse, [f"_{c}" for c in KEY], "left")
    return joined.select(*[F.col(c) for c in df.columns], F.coalesce("_value", F.lit(0)).alias(f"{value}_up"))


def in_box(df: DataFrame, lo: tuple[int, int, int], hi: tuple[int, int, int]) -> DataFrame:
    """A cutout, stop exclusive; the predicate reaches the scan."""
    for c, a, b in zip(KEY, lo, hi):
        df = df.where((F.col(c) >= a) & (F.col(c) < b))
    return df


def checked_range(c: Column, low: int, high: int, what: str) -> Column:
    """The value as bigint; one outside ``low``..``high`` is an error, null stays null."""
    wide = c.cast("bigint")
    return F.when(wide.isNull() | ((wide >= low) & (wide <= high)), wide).otherwise(F.raise_error(F.lit(f"{what} out of range")).cast("bigint"))
