"""Contacts between segments, the region adjacency graph and what is derived from it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volseg.operators.blocks import CHUNK, Block, per_block
from volseg.operators.condition import AFFINITIES, KEY


def _touching(block: Block) -> list[tuple[np.ndarray, ...]]:
    """For each axis what is on both sides of an inner face between two segments, with its affinity and place."""
    sid = block.array("_sid")
    here, out = sid[block.inner], []
    for i, a in enumerate(AFFINITIES):
        before = sid[block.shifted(i, -1)]
        at = np.nonzero((here != before) & (here != 0) & (before != 0))
        u, v = here[at], before[at]
        out.append((np.minimum(u, v), np.maximum(u, v), block.array(a)[block.inner][at], at))
    return out


def _read(voxels: DataFrame, sid: str) -> DataFrame:
    return voxels.where(F.col(sid) != 0).select(*KEY, F.col(sid).alias("_sid"), *[F.coalesce(a, F.lit(0.0)).cast("double").alias(a) for a in AFFINITIES])


def contacts(voxels: DataFrame, sid: str = "sid", chunk: tuple[int, int, int] = CHUNK) -> DataFrame:
    """``s1, s2, axis, x, y, z, aff``: a row for every pair of adjacent voxels of different segments, s1 < s2.

    Id 0 and null are background and touch nothing. The affinity is that of the voxel with the greater coordinate;
    a null one is 0. The volume is shuffled once, by block.
    """

    def run(block: Block) -> dict:
        parts = [{"s1": s1, "s2": s2, "axis": np.full(len(s1), i, np.int32), **block.coordinates(at), "aff": aff} for i, (s1, s2, aff, at) in enumerate(_touching(block))]
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}

    return per_block(_read(voxels, sid), chunk, ["_sid", *AFFINITIES], run, "s1 bigint, s2 bigint, axis int, x int, y int, z int, aff double", after=False)


def graph_of_volume(voxels: DataFrame, sid: str = "sid", chunk: tuple[int, int, int] = CHUNK) -> DataFrame:
    """``s1, s2, sum_aff, area`` of a volume: each block sends one row for each of its pairs, not its contacts."""

    def run(block: Block) -> dict:
        s1, s2, aff = (np.concatenate(part) for part in list(zip(*_touching(block)))[:3])
        pairs, at = np.unique(np.stack([s1, s2], axis=1), axis=0, return_inverse=True)
        at = at.reshape(-1)
        return {"s1": pairs[:, 0], "s2": pairs[:, 1], "sum_aff": np.bincount(at, weights=aff, minlength=len(pairs)), "area": np.bincount(at, minlength=len(pairs))}

    parts = per_block(_read(voxels, sid), chunk, ["_sid", *AFFINITIES], run, "s1 bigint, s2 bigint, sum_aff double, area bigint", after=False)
    return parts.groupBy("s1", "s2").agg(F.sum("sum_aff").alias("sum_aff"), F.sum("area").alias("area"))


def region_graph(contact: DataFrame) -> DataFrame:
    """``s1, s2, sum_aff, area``."""
    return contact.groupBy("s1", "s2").agg(F.sum("aff").alias("sum_aff"), F.count(F.lit(1)).alias("area"))


def per_axis(contact: DataFrame) -> DataFrame:
    """Affinity sum and area of each pair by axis."""
    cols = []
    for i, a in enumerate(KEY):
        on = F.col("axis") == i
        cols += [F.sum(F.when(on, F.col("aff")).otherwise(0.0)).alias(f"aff_{a}"), F.count_if(on).alias(f"area_{a}")]
    return contact.groupBy("s1", "s2").agg(*cols)


def scored(contact: DataFrame, score: str, percentile: float | None = None) -> DataFrame:
    """``score, s1, s2`` with the edge score ``max``, ``mean`` or ``percentile``.

    The percentile is of nearest rank, ``floor(p/100 * (n-1) + 0.5)``. Equal affinities of a pair are counted before
    the shuffle; the counted values of a pair are then run through in order, not gathered.
    """
    if score != "percentile":
        value: Column = F.max("aff") if score == "max" else F.sum("aff") / F.count(F.lit(1))
        return contact.groupBy("s1", "s2").agg(value.alias("score")).select("score", "s1", "s2")
    counted = contact.groupBy("s1", "s2", "aff").agg(F.count(F.lit(1)).alias("n"))
    pair = Window.partitionBy("s1", "s2")
    upto, total = F.sum("n").over(pair.orderBy("aff").rowsBetween(Window.unboundedPreceding, 0)), F.sum("n").over(pair)
    rows = counted.select("s1", "s2", "aff", "n", upto.alias("upto"), F.floor(F.lit(percentile / 100.0) * (total - 1) + 0.5).alias("rank"))
    return rows.where((F.col("rank") >= F.col("upto") - F.col("n")) & (F.col("rank") < F.col("upto"))).select(F.col("aff").alias("score"), "s1", "s2")


def remap_ids(df: DataFrame, remap: DataFrame, *columns: str) -> DataFrame:
    """Ids replaced by the remap's (``old, new``, one row for each old); others stay."""
    for i, c in enumerate(columns):
        table = remap.select(F.col("old").alias(f"_old{i}"), F.col("new").alias(f"_new{i}"))
        df = df.join(table, F.col(c) == F.col(f"_old{i}"), "left").withColumn(c, F.coalesce(f"_new{i}", c)).drop(f"_old{i}", f"_new{i}")
    return df


def remap_edges(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Edges between the new ids, merged; those that have become loops or touch 0 are gone."""
    moved = remap_ids(edges, remap, "s1", "s2").where((F.col("s1") != F.col("s2")) & (F.col("s1") != 0) & (F.col("s2") != 0))
    ends = moved.select(F.least("s1", "s2").alias("s1"), F.greatest("s1", "s2").alias("s2"), "sum_aff", "area")
    return ends.groupBy("s1", "s2").agg(F.sum("sum_aff").alias("sum_aff"), F.sum("area").alias("area"))


def split_incomplete(edges: DataFrame, boundary: DataFrame) -> DataFrame:
    """Edges with ``incomplete``: both ends are in ``boundary`` (``sid``)."""
    ids = boundary.select("sid").distinct()
    both = edges.join(ids.select(F.col("sid").alias("_b1")), F.col("s1") == F.col("_b1"), "left").join(ids.select(F.col("sid").alias("_b2")), F.col("s2") == F.col("_b2"), "left")
    return both.select(*edges.columns, (F.col("_b1").isNotNull() & F.col("_b2").isNotNull()).alias("incomplete"))


def drop_vetoed(edges: DataFrame, vetoes: DataFrame) -> DataFrame:
    """Edges that no veto (``s1, s2`` in either order) names."""
    pairs = vetoes.select(F.least("s1", "s2").alias("s1"), F.greatest("s1", "s2").alias("s2")).distinct()
    return edges.join(pairs, ["s1", "s2"], "left_anti")


def by_chunk(contact: DataFrame, chunk: tuple[int, int, int], remap: DataFrame | None = None) -> DataFrame:
    """Pairs with where they lie: ``in`` one chunk, ``between`` two, or ``fake`` once a remap makes the ends equal."""
    step = [F.when(F.col("axis") == i, F.col(c) - 1).otherwise(F.col(c)) for i, c in enumerate(KEY)]
    same = F.lit(True)
    for c, b, n in zip(KEY, step, chunk):
        same = same & (F.floor(F.col(c) / n) == F.floor(b / n))
    rows = contact.withColumn("place", F.when(same, "in").otherwise("between"))
    if remap is not None:
        rows = remap_ids(rows.withColumn("_o1", F.col("s1")).withColumn("_o2", F.col("s2")), remap, "_o1", "_o2")
        rows = rows.withColumn("place", F.when(F.col("_o1") == F.col("_o2"), "fake").otherwise(F.col("place")))
    return rows.groupBy("s1", "s2", "place").agg(F.sum("aff").alias("sum_aff"), F.count(F.lit(1)).alias("area"))


def with_representative(edges: DataFrame) -> DataFrame:
    """Parallel edges (``s1, s2, u1, u2, sum_aff, area``) merged, keeping the largest atomic edge; ties keep the least ids."""
    order = F.struct("area", F.bitwise_not("u1"), F.bitwise_not("u2"))
    atom = F.max_by(F.struct("u1", "u2", F.col("sum_aff").alias("u_aff"), F.col("area").alias("u_area")), order)
    out = edges.groupBy("s1", "s2").agg(F.sum("sum_aff").alias("sum_aff"), F.sum("area").alias("area"), atom.alias("r"))
    return out.select("s1", "s2", "sum_aff", "area", "r.u1", "r.u2", "r.u_aff", "r.u_area")
