"""Contact surfaces between segments: connected patches of the voxels at which a pair touches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volseg.operators import kernels
from volseg.operators.condition import KEY
from volseg.operators.graph import component_labels, per_component


def contact_voxels(contact: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """``s1, s2, x, y, z, axes``: the coordinates of each pair's contact with the axes they touch along as bits.

    With ``low``/``high`` only edges with an affinity strictly between count.
    """
    if low is not None:
        contact = contact.where(F.col("aff") > low)
    if high is not None:
        contact = contact.where(F.col("aff") < high)
    return contact.groupBy("s1", "s2", *KEY).agg(F.bit_or(F.expr("shiftleft(1, axis)")).alias("axes"))


def patches(voxels: DataFrame) -> DataFrame:
    """Adds ``patch``, the least coordinate of the connected part (26 neighbours) as ``x * 2^42 + y * 2^21 + z``.

    A pair's contact is bounded by the surface of a segment and is labelled in one task; pairs share tasks, and a
    hash only brings a pair's rows together.
    """
    keyed = voxels.withColumn("_pair", F.xxhash64("s1", "s2"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        group = pdf.groupby(["s1", "s2"], sort=False).ngroup().to_numpy()
        xyz = pdf[["x", "y", "z"]].to_numpy(dtype=np.int64)
        root = kernels.touching_groups(xyz, group)
        code = (xyz[:, 0] << 42) + (xyz[:, 1] << 21) + xyz[:, 2]
        least = np.full(len(code), np.iinfo(np.int64).max)
        np.minimum.at(least, root, code)
        return pdf.assign(patch=least[root])[["s1", "s2", "x", "y", "z", "axes", "patch"]]

    return per_component(keyed, "_pair", run, "s1 bigint, s2 bigint, x int, y int, z int, axes int, patch bigint")


def _axis(i: int) -> Column:
    return F.sum(F.when(F.col("axes").bitwiseAND(F.lit(1 << i)) != 0, 1).otherwise(0)).alias(f"size_{KEY[i]}")


def summaries(patched: DataFrame) -> DataFrame:
    """One row for each patch: voxel count, coordinate sums, edges by axis and box."""
    out = patched.groupBy("s1", "s2", "patch").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("bigint")).alias(f"sum_{c}") for c in KEY], *[_axis(i) for i in range(3)],
        *[f(c).cast("bigint").alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in KEY],
    )
    return out


def touches_face(summary: DataFrame, lo: tuple[int, int, int], hi: tuple[int, int, int], open_faces: tuple[bool, ...]) -> DataFrame:
    """Adds ``incomplete``: the patch's box reaches a face beyond which the volume goes on (low x, y, z, high x, y, z)."""
    hit = F.lit(False)
    for k in range(6):
        if open_faces[k]:
            c = KEY[k % 3]
            hit = hit | ((F.col(f"min_{c}") <= lo[k % 3]) if k < 3 else (F.col(f"max_{c}") >= hi[k % 3]))
    return summary.withColumn("incomplete", hit)


def merge_over_faces(parts: DataFrame, chunk: tuple[int, int, int], scratch) -> DataFrame:
    """Patches found block by block, joined where they meet: ``s1, s2, x, y, z, axes, patch``.

    ``parts``: voxels with a ``patch`` that is unique within block and pair. Two patches of a pair are one if voxels
    of theirs in different blocks are 26-neighbours. The links are met by one equi join on shifted coordinates.
    """
    block = [F.floor(F.col(c) / n).alias(f"_c{c}") for c, n in zip(KEY, chunk)]
    keys = ["s1", "s2", "patch", *[f"_c{c}" for c in KEY]]
    placed = parts.select("*", *block)
    # a number for each piece, fixed once it is written
    pieces = scratch.save(placed.select(*keys).distinct().withColumn("piece", F.monotonically_increasing_id()))
    named = scratch.save(placed.join(pieces, keys))
    near = F.lit(False)
    for c, n in zip(KEY, chunk):
        near = near | (F.col(c) % n == 0) | (F.col(c) % n == n - 1)
    rim = named.where(near)
    steps = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) > (0, 0, 0)]
    looks = F.explode(F.array(*[F.struct(*[(F.col(k) + d).cast("int").alias(f"n{k}") for k, d in zip(KEY, s)]) for s in steps])).alias("q")
    here = rim.select("s1", "s2", F.col("piece").alias("a"), looks).select("s1", "s2", "a", *[F.col(f"q.n{k}").alias(k) for k in KEY])
    links = here.join(rim.select("s1", "s2", *KEY, F.col("piece").alias("b")), ["s1", "s2", *KEY]).where("a <> b").select(F.col("a").alias("s1"), F.col("b").alias("s2")).distinct()
    cc = component_labels(links, scratch)
    whole = named.join(cc, F.col("piece") == F.col("id"), "left").withColumn("group", F.coalesce("cc", "piece"))
    least = whole.groupBy("group").agg(F.min("patch").alias("least"))
    return whole.join(least, "group").select("s1", "s2", *KEY, "axes", F.col("least").alias("patch"))


def reweighted(contact: DataFrame) -> DataFrame:
    """``s1, s2, aff, area``: the reweighted local mean affinity of each pair (see the kernel)."""
    at = contact.groupBy("s1", "s2", *KEY).agg(F.sum("aff").alias("a"), F.count(F.lit(1)).alias("n"), F.max("aff").alias("m"))
    keyed = at.withColumn("_pair", F.xxhash64("s1", "s2"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for (s1, s2), part in pdf.groupby(["s1", "s2"], sort=False):
            where = zip(zip(part["x"].tolist(), part["y"].tolist(), part["z"].tolist()), zip(part["a"].tolist(), part["n"].tolist(), part["m"].tolist()))
            rows.append((s1, s2, *kernels.reweighted_mean(dict(where))))
        return pd.DataFrame(rows, columns=["s1", "s2", "aff", "area"])

    return per_component(keyed, "_pair", run, "s1 bigint, s2 bigint, aff double, area bigint")
