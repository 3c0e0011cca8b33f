"""Nuclei: geometry, competition for segments with several of them, and the overlay of its outcome."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volseg.operators import kernels
from volseg.operators.condition import KEY, source_index
from volseg.operators.graph import component_labels
from volseg.operators.rag import remap_ids
from volseg.storage import Scratch

#: Owner ids are minted from here on; ids of the volume are below the other bound.
MINTED, NATIVE_LIMIT = 1 << 60, 1 << 57


def mint(col: Column, prefix: str = "nucleus-owner") -> Column:
    """A minted id: 2^60 plus the first seven bytes of the SHA-256 of ``prefix:id``."""
    digest = F.sha2(F.concat(F.lit(f"{prefix}:"), col.cast("string")), 256)
    return F.lit(MINTED) + F.conv(F.substring(digest, 1, 14), 16, 10).cast("bigint")


def mint_id(value: str | int, prefix: str = "nucleus-owner") -> int:
    return MINTED + int.from_bytes(hashlib.sha256(f"{prefix}:{value}".encode()).digest()[:7], "big")


def mint_territory(parent: Column, anchor: Column) -> Column:
    """The internal id of an anchor's territory in a parent segment."""
    digest = F.sha2(F.concat(F.lit("nucleus-territory:"), parent.cast("string"), F.lit(":"), anchor.cast("string")), 256)
    return F.lit(MINTED) + F.conv(F.substring(digest, 1, 14), 16, 10).cast("bigint")


def geometry(voxels: DataFrame, nuc: str = "nuc") -> DataFrame:
    """``nuc``, voxel count, coordinate sums and box (stop exclusive) of every nucleus."""
    rows = voxels.where(F.col(nuc) != 0).groupBy(F.col(nuc).alias("nuc"))
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("bigint")).alias(f"sum_{c}") for c in KEY], *[F.min(c).cast("bigint").alias(f"{c}0") for c in KEY], *[(F.max(c) + 1).cast("bigint").alias(f"{c}1") for c in KEY])


def sphere(geo: DataFrame, voxel_um: tuple[float, float, float]) -> DataFrame:
    """``nuc``, physical centre and the radius of the sphere of equal volume, in micrometres."""
    volume = F.col("n") * float(np.prod(voxel_um))
    centre = [((F.col(f"sum_{c}") / F.col("n") + 0.5) * u).alias(f"u{c}") for c, u in zip(KEY, voxel_um)]
    return geo.select("nuc", *centre, F.cbrt(volume * 0.75 / F.pi()).alias("radius"))


def histogram(voxels: DataFrame, nuclei: DataFrame, ratio: tuple[int, int, int], size: tuple[int, int, int]) -> DataFrame:
    """``sid, nuc, n, support``: voxels of each segment under each nucleus of a coarser volume (``x, y, z, nuc``), and
    the same in voxels of the coarser volume."""
    keyed = voxels.where("sid <> 0").select("sid", *[source_index(F.col(c), r, 0, n).alias(f"_{c}") for c, r, n in zip(KEY, ratio, size)])
    coarse = nuclei.where("nuc <> 0").select(*[F.col(c).alias(f"_{c}") for c in KEY], "nuc")
    counted = keyed.join(coarse, [f"_{c}" for c in KEY]).groupBy("sid", "nuc").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("support", F.col("n") / F.lit(float(np.prod(ratio))))


def targets(hist: DataFrame, min_share: float, totals: DataFrame | None = None) -> DataFrame:
    """``sid, nuc, n, total``: nuclei with at least the share of a segment, in segments with two or more of them."""
    per = totals if totals is not None else hist.groupBy("sid").agg(F.sum("n").alias("total"))
    rows = hist.join(per, "sid").where(F.col("n") >= F.col("total") * min_share)
    several = F.count(F.lit(1)).over(Window.partitionBy("sid"))
    return rows.withColumn("_k", several).where("_k >= 2").select("sid", "nuc", "n", "total")


def pair_gaps(qualified: DataFrame, spheres: DataFrame) -> DataFrame:
    """``sid, n1, n2, gap``: distance of the spheres of each two nuclei that qualify in a segment.

    Only segments with several nuclei occur, and a segment has a handful.
    """
    at = qualified.select("sid", "nuc").join(spheres, "nuc")
    a, b = at.alias("a"), at.alias("b")
    pairs = a.join(b, (F.col("a.sid") == F.col("b.sid")) & (F.col("a.nuc") < F.col("b.nuc")))
    square = F.lit(0.0)
    for c in KEY:
        square = square + (F.col(f"a.u{c}") - F.col(f"b.u{c}")) * (F.col(f"a.u{c}") - F.col(f"b.u{c}"))
    gap = F.sqrt(square) - F.col("a.radius") - F.col("b.radius")
    return pairs.select(F.col("a.sid").alias("sid"), F.col("a.nuc").alias("n1"), F.col("b.nuc").alias("n2"), gap.alias("gap"))


def contact_groups(qualified: DataFrame, gaps: DataFrame, contact_um: float, scratch: Scratch) -> DataFrame:
    """``sid, nuc, anchor, members, groups``: nuclei of a segment that nearly touch, by the least id of the group."""
    # a number for each nucleus of a segment, rising with the nucleus and fixed once it is written
    nodes = scratch.save(qualified.select("sid", "nuc").distinct().withColumn("_k", F.monotonically_increasing_id()))
    near = gaps.where(F.col("gap") < contact_um).select("sid", "n1", "n2")
    for i in (1, 2):
        near = near.join(nodes.select("sid", F.col("nuc").alias(f"n{i}"), F.col("_k").alias(f"s{i}")), ["sid", f"n{i}"])
    cc = component_labels(near.select("s1", "s2"), scratch)
    rows = nodes.join(cc, F.col("_k") == F.col("id"), "left").withColumn("_g", F.coalesce("cc", "_k"))
    within, segment = Window.partitionBy("sid", "_g"), Window.partitionBy("sid")
    rows = rows.select("sid", "nuc", F.min("nuc").over(within).alias("anchor"), F.count(F.lit(1)).over(within).alias("members"))
    return rows.withColumn("groups", F.size(F.collect_set("anchor").over(segment)).cast("bigint"))


def unit_boxes(groups: DataFrame, geo: DataFrame, margin: tuple[int, int, int], extent: tuple[int, int, int]) -> DataFrame:
    """``sid, anchor`` and the union of its nuclei's boxes with a margin, kept within the volume; groups of two or more."""
    rows = groups.where("members >= 2").join(geo, "nuc").groupBy("sid", "anchor")
    lo = [F.greatest(F.min(f"{c}0") - m, F.lit(0)).cast("bigint").alias(f"{c}0") for c, m in zip(KEY, margin)]
    hi = [F.least(F.max(f"{c}1") + m, F.lit(e)).cast("bigint").alias(f"{c}1") for c, m, e in zip(KEY, margin, extent)]
    return rows.agg(*lo, *hi)


def parent_boxes(voxels: DataFrame, boxes: DataFrame, factor: int, extent: tuple[int, int, int]) -> DataFrame:
    """The part of each box that its segment fills, aligned outwards to multiples of ``factor`` from 0, within the volume."""
    v = voxels.select("sid", *KEY).join(boxes.select("sid", "anchor", *[f"{c}{i}" for c in KEY for i in (0, 1)]), "sid")
    for c in KEY:
        v = v.where((F.col(c) >= F.col(f"{c}0")) & (F.col(c) < F.col(f"{c}1")))
    lo = [(F.floor(F.min(c) / factor) * factor).cast("bigint").alias(f"{c}0") for c in KEY]
    hi = [F.least(F.ceil((F.max(c) + 1) / factor) * factor, F.lit(e)).cast("bigint").alias(f"{c}1") for c, e in zip(KEY, extent)]
    return v.groupBy("sid", "anchor").agg(*lo, *hi)


def pool(voxels: DataFrame, value: str, factor: int) -> DataFrame:
    """``x, y, z`` of blocks with the ``low`` and ``high`` value, and ``same`` where they agree; missing voxels are 0."""
    rows = voxels.groupBy(*[F.floor(F.col(c) / factor).cast("int").alias(c) for c in KEY]).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("_n"))
    full = F.col("_n") == factor**3
    low, high = [F.when(full, F.col(c)).otherwise(f(F.col(c), F.lit(0))) for c, f in (("low", F.least), ("high", F.greatest))]
    return rows.select(*KEY, low.alias("low"), high.alias("high"), F.when(low == high, low).otherwise(0).alias("same"))


def owner_labels(voxels: DataFrame, groups: DataFrame, nuc: str = "nuc") -> DataFrame:
    """``x, y, z, owner``: nucleus tags that qualify in their segment's units, as owners; other tags are 0."""
    ok = groups.where("members >= 2").select("sid", F.col("nuc").alias("_q"))
    rows = voxels.join(ok, (voxels["sid"] == ok["sid"]) & (voxels[nuc] == ok["_q"]), "left")
    return rows.select(*[voxels[c] for c in KEY], F.coalesce("_q", F.lit(0)).alias("owner"))


def clashes(boxes: DataFrame) -> DataFrame:
    """Units of the same segment whose boxes overlap: such a segment would be shared out twice.

    Boxes of different segments may overlap. A segment has a handful of units, so this is a join on the segment.
    """
    a, b = boxes.alias("a"), boxes.alias("b")
    overlap = (F.col("a.sid") == F.col("b.sid")) & (F.col("a.anchor") < F.col("b.anchor"))
    for c in KEY:
        overlap = overlap & (F.col(f"a.{c}0") < F.col(f"b.{c}1")) & (F.col(f"b.{c}0") < F.col(f"a.{c}1"))
    return a.join(b, overlap).select(F.col("a.sid").alias("sid"), F.col("a.anchor").alias("anchor_a"), F.col("b.anchor").alias("anchor_b"))


def id_faults(groups: DataFrame) -> DataFrame:
    """``fault, id``: what keeps the units' ids from being safe; empty if nothing does.

    ``namespace``: a segment whose id is beyond those of the volume; ``owner``: nuclei that get the same minted id;
    ``territory``: territories that do, among themselves or with an owner.
    """
    units = groups.where("members >= 2").select("sid", "nuc")
    beyond = units.where(F.col("sid") >= NATIVE_LIMIT).select(F.lit("namespace").alias("fault"), F.col("sid").alias("id")).distinct()
    owners = units.select("nuc").distinct().select(mint(F.col("nuc")).alias("id"), F.lit(0).alias("kind"))
    parts = units.distinct().select(mint_territory(F.col("sid"), F.col("nuc")).alias("id"), F.lit(1).alias("kind"))
    twice = owners.unionByName(parts).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind")).where("n > 1")
    return beyond.unionByName(twice.select(F.when(F.col("kind") == 0, "owner").otherwise("territory").alias("fault"), "id"))


def checked_units(boxes: DataFrame, groups: DataFrame) -> DataFrame:
    """The boxes, once it is certain that no two of a segment overlap and that all ids are safe; else an error."""
    found = clashes(boxes).limit(1).collect()
    if found:
        raise ValueError(f"units {found[0].anchor_a} and {found[0].anchor_b} of segment {found[0].sid} overlap")
    found = id_faults(groups).limit(1).collect()
    if found:
        raise ValueError(f"{found[0].fault} id {found[0].id} is not safe")
    return boxes


def _cells(boxes: DataFrame, chunk: tuple[int, int, int], *keep: str) -> DataFrame:
    """Each box with the chunks of the volume that it reaches into, ``cx, cy, cz``."""
    rows = boxes.select(*keep, *[f"{c}{i}" for c in KEY for i in (0, 1)])
    for c, n in zip(KEY, chunk):
        rows = rows.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.col(f"{c}0") / n), F.floor((F.col(f"{c}1") - 1) / n))))
    return rows.select("*", *[F.col(f"c{c}").cast("int").alias(f"_c{c}") for c in KEY]).drop("cx", "cy", "cz").withColumnsRenamed({f"_c{c}": f"c{c}" for c in KEY})


def touched_chunks(boxes: DataFrame, chunks: DataFrame, chunk: tuple[int, int, int]) -> DataFrame:
    """Which boxes reach into which of the chunks (``mip, cx, cy, cz``, of mip 0): the chunks follow from the box."""
    return _cells(boxes, chunk, "sid", "anchor").join(chunks.select("mip", "cx", "cy", "cz"), ["cx", "cy", "cz"]).select("sid", "anchor", "mip", "cx", "cy", "cz")


def flood_units(voxels: DataFrame, boxes: DataFrame, groups: DataFrame, factor: int = 1, chunk: tuple[int, int, int] = (64, 64, 64)) -> DataFrame:
    """``sid, anchor, px, py, pz, territory``: each unit's segment shared out among its nuclei from their cores outwards.

    Everything is pooled to blocks of ``factor`` voxels on a side first, absent voxels being 0: the least affinity of
    a block over the channels, whether the segment is in it, and its nucleus where all voxels agree; so a unit is
    small enough for one task. Blocks flood at a cost of 1 minus the affinity, the cheapest first, the oldest at equal
    cost, over six neighbours; ``territory`` is the nucleus, or 0 where no core reaches. A nucleus without a block
    of its own is an error. ``voxels``: ``x, y, z, ax, ay, az, sid, nuc``; ``boxes``: of :func:`parent_boxes`, aligned
    to ``factor``; ``groups``: of :func:`contact_groups`.
    """
    members = groups.where("members >= 2").groupBy("sid", "anchor").agg(F.array_sort(F.collect_list("nuc")).alias("_nuclei"))
    units = boxes.join(members, ["sid", "anchor"]).withColumnsRenamed({"sid": "_unit"})
    cells = _cells(units, chunk, "_unit", "anchor", "_nuclei")
    least = F.least("ax", "ay", "az")
    v = voxels.select(*KEY, "sid", "nuc", least.alias("_aff"), *[F.floor(F.col(c) / n).cast("int").alias(f"c{c}") for c, n in zip(KEY, chunk)])
    v = v.join(cells, ["cx", "cy", "cz"])
    for c in KEY:
        v = v.where((F.col(c) >= F.col(f"{c}0")) & (F.col(c) < F.col(f"{c}1")))
    pooled = v.groupBy(F.col("_unit").alias("sid"), "anchor", *[F.floor(F.col(c) / factor).cast("int").alias(f"p{c}") for c in KEY]).agg(
        F.min("_aff").alias("low"), F.max((F.col("sid") == F.col("_unit")).cast("int")).alias("own"), F.min("nuc").alias("n_low"), F.max("nuc").alias("n_high"),
        F.count(F.lit(1)).alias("n"), F.first("_nuclei").alias("_nuclei"),
    )
    full = F.col("n") == factor**3
    core = F.when(full & (F.col("n_low") == F.col("n_high")) & F.array_contains("_nuclei", F.col("n_low")) & (F.col("own") == 1), F.col("n_low")).otherwise(0)
    pooled = pooled.select("sid", "anchor", "px", "py", "pz", (1 - F.when(full, F.col("low")).otherwise(F.least("low", F.lit(0.0)))).alias("cost"), "own", core.cast("bigint").alias("core"), "_nuclei")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = [pdf[f"p{c}"].to_numpy() for c in KEY]
        lo = [int(c.min()) for c in cells]
        at = tuple(c - a for c, a in zip(cells, lo))
        shape = [int(c.max()) - a + 1 for c, a in zip(cells, lo)]
        price, seeds, mask = np.ones(shape), np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=bool)
        price[at], seeds[at], mask[at] = pdf["cost"].to_numpy(), pdf["core"].to_numpy(), pdf["own"].to_numpy() == 1
        lacking = set(pdf["_nuclei"].iloc[0]) - set(pdf["core"])
        if lacking:
            raise ValueError(f"nucleus {min(lacking)} has no block of its own in segment {pdf['sid'].iloc[0]}")
        own = mask[at]
        grown = kernels.flood(price, seeds, mask)[at][own]
        return pd.DataFrame({**{c: pdf[c][own] for c in ("sid", "anchor", "px", "py", "pz")}, "territory": grown})

    return pooled.groupBy("sid", "anchor").applyInPandas(run, "sid bigint, anchor bigint, px int, py int, pz int, territory bigint")


def ledger(territories: DataFrame) -> DataFrame:
    """``sid, owner, minted, n``: what each segment is retired into, in blocks."""
    return territories.where("territory <> 0").groupBy("sid", F.col("territory").alias("owner")).agg(F.count(F.lit(1)).alias("n")).select("sid", "owner", mint(F.col("owner")).alias("minted"), "n")


def filter_ownership(voxels: DataFrame, qualified: DataFrame, protected: DataFrame, nuc: str = "nuc") -> DataFrame:
    """Nucleus tags of protected owners (``nuc``) set to 0 where (segment, owner) does not qualify (``sid, nuc``)."""
    p = protected.select(F.col("nuc").alias("_p")).distinct()
    q = qualified.select(F.col("sid").alias("_s"), F.col("nuc").alias("_q")).distinct()
    rows = voxels.join(p, voxels[nuc] == F.col("_p"), "left").join(q, (voxels["sid"] == F.col("_s")) & (voxels[nuc] == F.col("_q")), "left")
    tag = F.when(F.col("_p").isNotNull() & F.col("_q").isNull(), F.lit(0)).otherwise(voxels[nuc])
    return rows.select(*[tag.cast("bigint").alias(c) if c == nuc else voxels[c] for c in voxels.columns])


def canonical_segments(voxels: DataFrame, qualified: DataFrame) -> DataFrame:
    """Segments with exactly one qualifying owner take the owner's minted id."""
    single = qualified.groupBy("sid").agg(F.min("nuc").alias("owner"), F.count_distinct("nuc").alias("k")).where("k = 1")
    return remap_ids(voxels, single.select(F.col("sid").alias("old"), mint(F.col("owner")).alias("new")), "sid")


def overlay(voxels: DataFrame, territories: DataFrame, factor: int = 1) -> DataFrame:
    """Territories laid over a volume: in the blocks of :func:`flood_units` voxels of the shared-out segment take the
    minted id of their territory's nucleus, and its tag if there is a ``nuc`` column.

    One equi join on segment and block. The boxes of a segment must not overlap (:func:`checked_units`).
    """
    t = territories.where("territory <> 0").select(F.col("sid").alias("_s"), "px", "py", "pz", F.col("territory").alias("_t"))
    on = [F.floor(voxels[c] / factor).cast("int") == F.col(f"p{c}") for c in KEY] + [voxels["sid"] == F.col("_s")]
    rows = voxels.join(t, on, "left")
    new = {"sid": F.coalesce(mint(F.col("_t")), voxels["sid"])}
    if "nuc" in voxels.columns:
        new["nuc"] = F.coalesce("_t", voxels["nuc"])
    return rows.select(*[new[c].alias(c) if c in new else voxels[c] for c in voxels.columns])


def critical_path(tasks: DataFrame) -> DataFrame:
    """``serial_s, longest_s, speedup`` of ``unit, seconds``: what running the units side by side can gain."""
    return tasks.agg(F.sum("seconds").alias("serial_s"), F.max("seconds").alias("longest_s"), (F.sum("seconds") / F.max("seconds")).alias("speedup"))
