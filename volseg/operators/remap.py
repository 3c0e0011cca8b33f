"""Remap tables: closure, application, size maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volseg.operators.graph import component_labels
from volseg.operators.rag import remap_ids
from volseg.storage import Scratch


def closure(remap: DataFrame, scratch: Scratch) -> DataFrame:
    """``old, new`` resolved: every id of a chain, of whatever direction, to the least id of its group."""
    labels = component_labels(remap.select(F.col("old").alias("s1"), F.col("new").alias("s2")), scratch)
    return labels.select(F.col("id").alias("old"), F.col("cc").alias("new"))


def apply(labels: DataFrame, remap: DataFrame) -> DataFrame:
    """A volume's ids replaced; ids that the remap does not name stay."""
    return remap_ids(labels, remap, "sid")


def chunk_map(labels: DataFrame, remap: DataFrame, chunk_of: list[Column]) -> DataFrame:
    """For each chunk and new id the least old id that stands for it: ``chunk columns, old, new``."""
    rows = labels.where("sid <> 0").select(*chunk_of, F.col("sid").alias("old")).distinct()
    names = [c for c in rows.columns if c != "old"]
    rows = remap_ids(rows.withColumn("new", F.col("old")), remap, "new")
    return rows.groupBy(*names, "new").agg(F.min("old").alias("old")).select(*names, "old", "new")


def size_map(labels: DataFrame, sizes: DataFrame, threshold: int, clefts: DataFrame | None = None, least_cleft: int = 10) -> DataFrame:
    """``x, y, z, small``: 255 on segments below the size threshold, else 0; an unknown size is 0.

    With ``clefts`` (``sid, n_cleft``) only segments with more cleft voxels than ``least_cleft`` are marked.
    """
    rows = labels.join(sizes.select(F.col("sid").alias("_s"), F.col("size").alias("_size")), F.col("sid") == F.col("_s"), "left")
    small = (F.col("sid") != 0) & (F.coalesce("_size", F.lit(0)) < threshold)
    if clefts is not None:
        rows = rows.join(clefts.select(F.col("sid").alias("_k"), "n_cleft"), F.col("sid") == F.col("_k"), "left")
        small = small & (F.coalesce("n_cleft", F.lit(0)) > least_cleft)
    return rows.select("x", "y", "z", F.when(small, 255).otherwise(0).alias("small"))


def drop_small(labels: DataFrame, sizes: DataFrame, threshold: int) -> DataFrame:
    """Segments below the threshold set to 0."""
    keep = sizes.where(F.col("size") >= threshold).select(F.col("sid").alias("_s"))
    rows = labels.join(keep, F.col("sid") == F.col("_s"), "left")
    return rows.select(*[F.when(F.col("_s").isNotNull(), F.col(c)).otherwise(F.lit(0).cast("bigint")).alias(c) if c == "sid" else F.col(c) for c in labels.columns])


def unresolved(ids: DataFrame, remap: DataFrame) -> DataFrame:
    """Ids that a lookup would miss; an empty result is the assertion that none is."""
    return ids.select("sid").distinct().join(remap.select(F.col("old").alias("sid")), "sid", "left_anti")


def split_routes(remap: DataFrame, frozen: DataFrame, sizes: DataFrame) -> DataFrame:
    """``old, new, ac, route, size`` after agglomeration: new ids in ``frozen`` are ongoing, the others done."""
    from volseg.operators.watershed import route_remap

    routed = route_remap(remap, frozen)
    return routed.join(sizes.select(F.col("sid").alias("_s"), "size"), F.col("new") == F.col("_s"), "left").drop("_s")


def bags(metadata: DataFrame, resolved: DataFrame) -> DataFrame:
    """Per-supervoxel rows (``sid, ...``) with the ``root`` of their object, to be written partitioned by it."""
    return remap_ids(metadata.withColumn("root", F.col("sid")), resolved, "root")
