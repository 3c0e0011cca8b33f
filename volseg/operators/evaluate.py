"""A segmentation against a ground truth: marginal and joint counts, and scores made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(seg: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """``sid, gt, n`` of voxels where neither is 0; ``truth`` (``x, y, z, gt``) is joined by position."""
    rows = seg if truth is None else seg.join(truth, ["x", "y", "z"])
    return rows.where("sid <> 0 AND gt <> 0").groupBy("sid", "gt").agg(F.count(F.lit(1)).alias("n"))


def counts(joint: DataFrame) -> DataFrame:
    """``kind, i, j, n``: s_i, t_j and p_ij in one table."""
    zero = F.lit(0).cast("bigint")
    s = joint.groupBy(F.col("sid").alias("i")).agg(F.sum("n").alias("n")).select(F.lit("s").alias("kind"), "i", zero.alias("j"), "n")
    t = joint.groupBy(F.col("gt").alias("j")).agg(F.sum("n").alias("n")).select(F.lit("t").alias("kind"), zero.alias("i"), "j", "n")
    p = joint.select(F.lit("p").alias("kind"), F.col("sid").alias("i"), F.col("gt").alias("j"), "n")
    return s.unionByName(t).unionByName(p)


def rand_scores(counted: DataFrame) -> DataFrame:
    """``sum_s2, sum_t2, sum_p2, n``: the pair counts that Rand split and merge scores are ratios of."""
    def squares(kind: str):
        return F.sum(F.when(F.col("kind") == kind, F.col("n") * F.col("n")).otherwise(0))

    return counted.agg(squares("s").alias("sum_s2"), squares("t").alias("sum_t2"), squares("p").alias("sum_p2"), F.sum(F.when(F.col("kind") == "p", F.col("n")).otherwise(0)).alias("n"))
