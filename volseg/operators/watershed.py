"""Watershed basins per block, their region graph, and stitching over block faces."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volseg.operators import kernels
from volseg.operators.blocks import CHUNK, Block, per_block
from volseg.operators.condition import AFFINITIES, AXES, KEY
from volseg.operators.graph import component_labels, in_order, relabel, spanning_forest
from volseg.operators.grid import COORD_LIMIT, IDS_PER_CHUNK
from volseg.storage import Scratch

#: Edges of a component that one task may hold; wider components are taken in stages.
MOST_EDGES = 1_000_000
#: Settings that are worked on at a time.
SIDE_BY_SIDE = 3


def _bits(block: Block, low: float, high: float) -> np.ndarray:
    there = block.there
    before, after = [], []
    for i, a in enumerate(AFFINITIES):
        aff = block.array(a)
        before.append(np.where(there[block.shifted(i, -1)], aff[block.inner], low))
        after.append(np.where(there[block.shifted(i, 1)], aff[block.shifted(i, 1)], low))
    edges = np.stack([*before, *after])
    best = edges.max(axis=0)
    bits = (((edges == best) | (edges >= high)) * np.array(kernels.BITS).reshape(6, 1, 1, 1)).sum(axis=0)
    return np.where((best > low) & there[block.inner], bits, 0)


def direction_bits(voxels: DataFrame, low: float, high: float, chunk: tuple[int, int, int] = CHUNK) -> DataFrame:
    """``x, y, z, bits``: the steepest edges of each voxel, and all of at least ``high``.

    Bits 1, 2, 4 are the edges to the voxels before on x, y, z; 8, 16, 32 those after. A voxel whose best edge is
    not above ``low`` has no bits; beyond the last voxel an edge counts as ``low``.
    """

    def run(block: Block) -> dict:
        at = np.nonzero(block.there[block.inner])
        return {**block.coordinates(at), "bits": _bits(block, low, high)[at].astype(np.int32)}

    return per_block(voxels, chunk, AFFINITIES, run, "x int, y int, z int, bits int")


def halo_bits(voxels: DataFrame, extent: tuple[int, int, int], high: float) -> DataFrame:
    """``face, x, y, z, bits``: voxels just outside a block point inwards where the edge across is at least ``high``.

    Faces 0..5 are the low sides of x, y, z, then the high ones; only edges that the volume holds are named.
    """
    out = None
    for k in range(3):
        c, a, n = AXES[k], AFFINITIES[k], extent[k]
        for face, at, bit in ((k, 0, kernels.BITS[k + 3]), (k + 3, n, kernels.BITS[k])):
            plane = voxels.where(F.col(c) == at)
            moved = [(F.col(q) - 1).alias(q) if q == c and face < 3 else F.col(q) for q in KEY]
            part = plane.select(F.lit(face).alias("face"), *moved, F.when(F.col(a) >= high, bit).otherwise(0).alias("bits"))
            out = part if out is None else out.unionByName(part)
    return out


def _first_id(cx: int, cy: int, cz: int) -> int:
    """What a block's ids count from: its coordinates as in packed ids, and what they have beyond ten bits above those,
    where packed ids have the layer: two bits of x and y, three of z."""
    if max(cx, cy) >= 4 * COORD_LIMIT or cz >= 8 * COORD_LIMIT:
        raise ValueError(f"block {cx}, {cy}, {cz} is out of range")
    return cx // COORD_LIMIT << 61 | cy // COORD_LIMIT << 59 | cz // COORD_LIMIT << 56 | cx % COORD_LIMIT << 46 | cy % COORD_LIMIT << 36 | cz % COORD_LIMIT << 26


def basins(voxels: DataFrame, chunk: tuple[int, int, int], low: float, high: float) -> DataFrame:
    """``x, y, z, sid, bits``: basins of every block with ids that name their block, and the direction bits.

    A block sees one voxel beyond its faces: a basin that drains out of the block does so by its own voxel there,
    and plateaus (edges of at least ``high``) lead out and in again. Each block is one task; stitching joins what a
    face cuts. Id 0 is background.
    """

    def run(block: Block) -> dict:
        there = block.there
        bits = np.zeros(there.shape, dtype=np.int64)
        bits[block.inner] = _bits(block, low, high)
        for i, a in enumerate(AFFINITIES):
            strong = block.array(a) >= high
            plane = [list(block.inner) for _ in range(4)]
            for p, k in zip(plane, (0, 1, -1, -2)):
                p[i] = k
            first, second, last, _ = map(tuple, plane)
            bits[first] = np.where(there[first] & strong[second], kernels.BITS[i + 3], 0)
            bits[last] = np.where(there[last] & strong[last], kernels.BITS[i], 0)
        label = kernels.basins(bits, halo=True)
        at = np.nonzero(there[block.inner])
        base = _first_id(*(o // n for o, n in zip(block.low, block.size)))
        found = label[at]
        return {**block.coordinates(at), "sid": np.where(found > 0, found + base, 0), "bits": bits[block.inner][at].astype(np.int32)}

    return per_block(voxels, chunk, AFFINITIES, run, "x int, y int, z int, sid bigint, bits int")


def sizes_and_border(labels: DataFrame, chunk: tuple[int, int, int], extent: tuple[int, int, int]) -> DataFrame:
    """``sid, size, on_border``: the border is where the volume goes on in another block."""
    edge = F.lit(False)
    for c, n, e in zip(KEY, chunk, extent):
        edge = edge | ((F.col(c) % n == 0) & (F.col(c) > 0)) | ((F.col(c) % n == n - 1) & (F.col(c) < e - 1))
    return labels.groupBy("sid").agg(F.count(F.lit(1)).alias("size"), F.bool_or(edge & (F.col("sid") != 0)).alias("on_border"))


def inside(labels: DataFrame, chunk: tuple[int, int, int]) -> DataFrame:
    """The volume without the edges across block faces: what the blocks know of their region graph."""
    cut = {a: F.when(F.col(c) % n == 0, None).otherwise(F.col(a)) for c, a, n in zip(KEY, AFFINITIES, chunk)}
    return labels.select(*[cut[c].alias(c) if c in cut else F.col(c) for c in labels.columns])


def face_planes(voxels: DataFrame, chunk: tuple[int, int, int], *extra: str) -> DataFrame:
    """``axis, x, y, z, sid_o, sid_i, aff``: at every block face the voxel before, the one behind, and the edge.

    ``extra`` columns come out for both voxels, with ``_o`` and ``_i`` after their names.
    """
    out = None
    for i, (c, a, n) in enumerate(zip(AXES, AFFINITIES, chunk)):
        inner = voxels.where((F.col(c) % n == 0) & (F.col(c) > 0)).select(*KEY, *[F.col(k).alias(f"{k}_i") for k in ("sid", *extra)], F.col(a).alias("aff"))
        outer = voxels.where(F.col(c) % n == n - 1).select(*[(F.col(k) + 1).alias(k) if k == c else F.col(k) for k in KEY], *[F.col(k).alias(f"{k}_o") for k in ("sid", *extra)])
        part = inner.join(outer, KEY).select(F.lit(i).alias("axis"), *KEY, "sid_o", "sid_i", *[f"{k}_{s}" for k in extra for s in "oi"], "aff")
        out = part if out is None else out.unionByName(part)
    return out


def classify_faces(faces: DataFrame, high: float) -> DataFrame:
    """``s1, s2, same, aff``: pairs that meet over a face; the same basin if an edge is at least ``high``."""
    pairs = faces.where((F.col("sid_i") != 0) & (F.col("sid_o") != 0)).select(F.least("sid_i", "sid_o").alias("s1"), F.greatest("sid_i", "sid_o").alias("s2"), "aff")
    return pairs.groupBy("s1", "s2").agg((F.max("aff") >= high).alias("same"), F.max("aff").alias("aff"))


def descents(faces: DataFrame, low: float, high: float) -> DataFrame:
    """``sid, descent``: the affinity by which a basin drains over a face, where a voxel of it does (see its bits).

    ``faces``: :func:`face_planes` with ``bits``. Edges below ``low``, and plateaus of at least ``high``, are none.
    """
    across = faces.where((F.col("sid_i") != 0) & (F.col("sid_o") != 0) & (F.col("aff") >= low) & (F.col("aff") < high))
    ends = F.array_compact(F.array(
        F.when(F.expr("shiftright(bits_o, axis + 3) % 2 = 1"), F.col("sid_o")),
        F.when(F.expr("shiftright(bits_i, axis) % 2 = 1"), F.col("sid_i")),
    ))
    return across.select(F.explode(ends).alias("sid"), "aff").groupBy("sid").agg(F.max("aff").alias("descent"))


def stitch_plateaus(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """``old, new``: basins that are the same across faces, by their least id."""
    same = classes.where("same").select("s1", "s2")
    return component_labels(same, scratch).select(F.col("id").alias("old"), F.col("cc").alias("new"))


def _draining(edges: DataFrame, nodes: DataFrame, top: float) -> DataFrame:
    """The edges along which :func:`kernels.join_descents` may join: a basin's descent is always one of those that the
    basins have had at first, or ``top``, and only an edge of that score joins."""
    met = nodes.select(F.col("descent").alias("score")).unionByName(edges.sparkSession.range(1).select(F.lit(top).alias("score"))).distinct()
    return edges.join(met, "score", "left_semi")


def stitch_descents(classes: DataFrame, inner_best: DataFrame, low: float, scratch: Scratch, top: float = 1.0, most: int = MOST_EDGES) -> DataFrame:
    """``old, new``: basins cut by a face joined where the edge across is the steepest way out of either.

    ``inner_best``: ``sid, descent``, the best edge of each basin at the face. Edges below ``low`` are passed over.
    """
    edges = classes.where((F.col("aff") >= low) & ~F.col("same")).select(F.col("aff").alias("score"), "s1", "s2")
    ids = edges.select(F.explode(F.array("s1", "s2")).alias("sid")).distinct()
    nodes = ids.join(inner_best, "sid", "left").select("sid", F.lit(0).cast("bigint").alias("size"), F.lit(False).alias("border"), F.coalesce("descent", F.lit(-1.0)).alias("descent"))
    labels, _ = in_order(_draining(edges, nodes, top), nodes, lambda e, n: kernels.join_descents(e, n, top), "size bigint, border boolean, descent double", scratch, most)
    return labels.select(F.col("id").alias("old"), F.col("cc").alias("new"))


@dataclass(frozen=True)
class Level:
    """What stitching a level gives: ``remap`` (old, new; 0 is dust), ``edges`` (score, s1, s2) and ``sizes``."""

    remap: DataFrame
    edges: DataFrame
    sizes: DataFrame


def _grown(edges: DataFrame, sizes: DataFrame, limit: int, dust: int, scratch: Scratch, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels after :func:`kernels.join_small`, the remap with dust as 0, and the sizes that are left."""
    nodes = sizes.where("sid <> 0").select("sid", "size", F.col("on_border").alias("border"))

    def big(u: str, v: str):
        return (F.col(f"{u}size") >= limit) & (F.col(f"{v}size") >= limit)  # sizes only grow

    labels, states = in_order(edges, nodes, lambda e, n: kernels.join_small(e, n, limit), "size bigint, border boolean", scratch, most, big)
    kept = scratch.save(states.where(F.col("border") | (F.col("size") >= dust)))
    there = kept.select(F.col("sid").alias("_k"))
    remap = labels.join(there, F.col("cc") == F.col("_k"), "left").select(F.col("id").alias("old"), F.coalesce("_k", F.lit(0)).cast("bigint").alias("new"))
    return labels, scratch.save(remap), kept.select("sid", "size", F.col("border").alias("on_border"))


def _between(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """The best edge of each pair of what is left."""
    moved = relabel(edges, remap.select(F.col("old").alias("id"), F.col("new").alias("cc")), "s1", "s2").where("s1 <> s2 AND s1 <> 0 AND s2 <> 0")
    return moved.select("score", F.least("s1", "s2").alias("s1"), F.greatest("s1", "s2").alias("s2")).groupBy("s1", "s2").agg(F.max("score").alias("score")).select("score", "s1", "s2")


def stitch(faces: DataFrame, graph: DataFrame, sizes: DataFrame, p, scratch: Scratch, most: int = MOST_EDGES) -> Level:
    """One level of the octree: the basins on both sides of its inner faces become one segmentation.

    ``faces``: :func:`face_planes` with ``bits``; ``graph``: ``score, s1, s2`` of the parts; ``sizes``: ``sid, size,
    on_border``, the border being that of the level; ``p``: thresholds (``high, low, size, dust``). In this order:
    plateaus across faces are joined; then, along falling scores of at least ``low``, basins that a face has cut
    from the way they drain; then small basins; interior ones smaller than dust go to 0. What is handed on are the
    edges of the maximum spanning forest both ends of which are at the border.
    """
    classes = scratch.save(classify_faces(faces.where(F.col("aff") >= p.low), p.high))
    same = scratch.save(component_labels(classes.where("same"), scratch))
    best = descents(faces, p.low, p.high)
    rg = graph.select("score", "s1", "s2").unionByName(classes.where(F.col("aff") < p.high).select(F.col("aff").alias("score"), "s1", "s2"))
    rg = scratch.save(relabel(rg.where(F.col("score") >= p.low), same, "s1", "s2"))
    known = sizes.where("sid <> 0").join(best, "sid", "left").join(same, F.col("sid") == F.col("id"), "left")
    nodes = known.groupBy(F.coalesce("cc", "sid").alias("sid")).agg(
        F.sum("size").alias("size"), F.bool_or("on_border").alias("border"),
        # what a plateau joins drains along it
        F.when(F.count(F.lit(1)) > 1, F.lit(p.high)).otherwise(F.coalesce(F.max("descent"), F.lit(-1.0))).alias("descent"),
    )
    nodes = scratch.save(nodes)
    drained, states = in_order(_draining(rg, nodes, p.high), nodes, lambda e, n: kernels.join_descents(e, n, p.high), "size bigint, border boolean, descent double", scratch, most)
    rg = scratch.save(relabel(rg, drained, "s1", "s2").where("s1 <> s2"))
    grown, remap, left = _grown(rg, states.select("sid", "size", F.col("border").alias("on_border")), p.size, p.dust, scratch, most)
    new = remap.select(F.col("old").alias("id"), F.col("new").alias("cc"))
    old = sizes.where("sid <> 0").select(F.col("sid").alias("old"), F.col("sid").alias("new"))
    for step in (same, drained, new):
        old = relabel(old, step, "new")
    forest = spanning_forest(_between(rg, remap), scratch)
    border = left.where("on_border").select("sid")
    return Level(scratch.save(old), border_edges(forest.select("score", "s1", "s2"), border), left)


def merge_segments(graph: DataFrame, sizes: DataFrame, limit: int, dust: int, above: float, scratch: Scratch, most: int = MOST_EDGES) -> DataFrame:
    """Small basins joined along falling scores: ``kind, a, b, score``.

    ``remap`` rows hold old and new id (0: dust); ``edge`` rows the spanning forest of what is left. ``graph``:
    ``score, s1, s2``; ``sizes``: ``sid, size, on_border``. Edges up to the threshold play no part.
    """
    edges = scratch.save(graph.where(F.col("score") > above).select("score", "s1", "s2"))
    _, remap, _ = _grown(edges, sizes, limit, dust, scratch, most)
    forest = spanning_forest(_between(edges, remap), scratch)
    out = remap.select(F.lit("remap").alias("kind"), F.col("old").alias("a"), F.col("new").alias("b"), F.lit(0.0).alias("score"))
    return out.unionByName(forest.select(F.lit("edge").alias("kind"), F.col("s1").alias("a"), F.col("s2").alias("b"), "score"))


def compact_segments(merged: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of :func:`merge_segments` with the new ids numbered 1, 2, ... in rising order; 0 stays."""
    new = scratch.save(compact_ids(merged.where("kind = 'remap'").select(F.col("b").alias("sid"))))
    to = new.select(F.col("old").alias("id"), F.col("new").alias("cc"))
    remap = relabel(merged.where("kind = 'remap'"), to, "b")
    return remap.unionByName(relabel(merged.where("kind = 'edge'"), to, "a", "b"))


def merge_segments_at(graph: DataFrame, sizes: DataFrame, thresholds: list[tuple[int, int, float]], scratch: Scratch) -> DataFrame:
    """:func:`merge_segments` for several (limit, dust, above), each from the same basins, with ``setting`` 0, 1, ...

    The settings do not depend on one another and run side by side, a few at a time.
    """

    def at(setting: tuple[int, tuple[int, int, float]]) -> DataFrame:
        i, given = setting
        return merge_segments(graph, sizes, *given, Scratch(scratch.spark, f"setting{i}")).withColumn("setting", F.lit(i))

    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return reduce(DataFrame.unionByName, pool.map(at, enumerate(thresholds)))


def compact_ids(ids: DataFrame) -> DataFrame:
    """``old, new``: distinct ids but 0 numbered 1, 2, ... in rising order, by partition offsets of one sort.

    The ids' totals per partition are added up in a window of one row for each partition.
    """
    from volseg.operators.ordered import running_totals

    rows = ids.select(F.col("sid").alias("old")).where("old <> 0").distinct().withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_totals(rows, [], ["old"], "_one", Scratch(ids.sparkSession, "compact"))
    return ranked.select("old", (F.col("start") + 1).alias("new"))


def offset_ids(labels: DataFrame, offset: int) -> DataFrame:
    """Ids moved by a block's offset; 0 stays 0."""
    return labels.withColumn("sid", F.when(F.col("sid") != 0, F.col("sid") + F.lit(offset)).otherwise(F.col("sid")))


def route_remap(remap: DataFrame, border: DataFrame) -> DataFrame:
    """``old, new, route``: where a remap row goes once a level is stitched.

    Rows whose new id is still at the border are ``ongoing``: of each owner chunk and new id the least old id is the
    ``ongoing`` representative, the others are ``done_pre`` and are settled through it. The rest are ``done_post``.
    """
    flagged = remap.join(border.select(F.col("sid").alias("_b")).distinct(), F.col("new") == F.col("_b"), "left")
    owner = F.col("old") - F.col("old") % IDS_PER_CHUNK
    flagged = flagged.select("old", "new", owner.alias("ac"), F.col("_b").isNotNull().alias("open"))
    first = F.row_number().over(Window.partitionBy("ac", "new").orderBy("old"))
    return flagged.withColumn("_n", first).select("old", "new", "ac", F.when(~F.col("open"), "done_post").when(F.col("_n") == 1, "ongoing").otherwise("done_pre").alias("route"))


def border_edges(graph: DataFrame, border: DataFrame) -> DataFrame:
    """``score, s1, s2``: the best edge of each pair of which both are at the border (``sid``); the rest is settled."""
    best = graph.groupBy("s1", "s2").agg(F.max("score").alias("score"))
    ids = border.select("sid").distinct()
    both = best.join(ids.withColumnRenamed("sid", "s1"), "s1", "left_semi").join(ids.withColumnRenamed("sid", "s2"), "s2", "left_semi")
    return both.select("score", "s1", "s2")
