"""Exact percentiles per group from one distributed sort, and summaries of days that can be merged.

Equal values of a group are counted first. The counted values of all groups are sorted together over all partitions;
partition counts give every group's offsets, from which the positions wanted are known, and the order statistics
next to each are read off and interpolated. The error is 0. No group is gathered anywhere: a group with a third of
all rows spans a third of the partitions.

A summary keeps of each group the values at every k-th rank, with k - 1 ranks of uncertainty. Summaries of several
groups merge by adding weights; the uncertainties add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volseg.operators.ordered import running_totals
from volseg.storage import Scratch

#: Share of a group's ranks that a summary may be off.
EPSILON = 0.01


def finite(name: str) -> Column:
    return F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(F.col(name)) < float("inf"))


def counted(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """``group, v, n``: the finite values with their counts; -0.0 counts as 0.0."""
    return df.where(finite(value)).groupBy(*group, (F.col(value) + F.lit(0.0)).alias("v")).agg(F.count(F.lit(1)).alias("n"))


def ranked(counts: DataFrame, group: list[str], scratch: Scratch) -> DataFrame:
    """``group, v, n, start, total``: the sort; a value holds the ranks from ``start`` on, out of ``total``."""
    return running_totals(counts, group, ["v"], "n", scratch)


def _position(p: Column) -> Column:
    return p / F.lit(100.0) * (F.col("total") - 1)


def percentiles(ranks: DataFrame, group: list[str], wanted: list[float]) -> DataFrame:
    """``group, percentile, n_values, value``: the wanted percentiles (0 to 100), linearly interpolated.

    At p the position is p/100 * (n - 1); between two order statistics the value is lo + (hi - lo) * fraction.
    Groups without a finite value have no rows.
    """

    def holds(rank: Column) -> Column:
        return (rank >= F.col("start")) & (rank < F.col("start") + F.col("n"))

    def low(p: Column) -> Column:
        return F.floor(_position(p)).cast("bigint")

    def high(p: Column) -> Column:
        return F.least(low(p) + 1, F.col("total") - 1)

    # the test for all percentiles is one small loop: written out it would be too large a method to be compiled
    hits = F.filter(F.array(*[F.lit(float(p)) for p in wanted]), lambda p: holds(low(p)) | holds(high(p)))
    rows = ranks.withColumn("_hits", hits).where(F.size("_hits") > 0).withColumn("percentile", F.explode("_hits"))
    p = F.col("percentile")
    found = rows.groupBy(*group, "percentile").agg(
        F.max("total").alias("n_values"), F.max(_position(p) - F.floor(_position(p))).alias("f"),
        F.max(F.when(holds(low(p)), F.col("v"))).alias("lo"), F.max(F.when(holds(high(p)), F.col("v"))).alias("hi"),
    )
    return found.select(*group, "percentile", "n_values", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("f")).alias("value"))


def summaries(ranks: DataFrame, group: list[str], epsilon: float = EPSILON) -> DataFrame:
    """``group, v, weight, slack``: values at every k-th rank and the last, k = max(1, floor(epsilon * n)).

    ``weight`` is the number of ranks from the value on to the next one kept; ``slack`` = k - 1 bounds how far a
    rank read off the summary is off.
    """
    k = F.greatest(F.lit(1), F.floor(F.col("total") * F.lit(epsilon))).cast("bigint")
    end = F.col("start") + F.col("n")
    first = F.ceil(F.col("start") / k).cast("bigint") * k  # the first grid rank at or after start
    on_grid = first < end
    last = end == F.col("total")
    kept = ranks.where(on_grid | last)
    grid = F.floor((end - 1 - first) / k).cast("bigint") + 1
    weight = F.when(on_grid, F.least(grid * k, F.col("total") - first)).otherwise(F.lit(0))
    out = kept.select(*group, "v", weight.cast("bigint").alias("weight"), (k - 1).alias("slack"))
    return out.where("weight > 0 OR slack > 0")


def span_percentiles(summary: DataFrame, part: list[str], span: list[str], wanted: list[float]) -> DataFrame:
    """Percentiles of unions of summarised groups: ``span, percentile, n_values, value, rank_error``.

    ``part`` are the summaries' group columns, from which ``span`` can be computed by the caller; both must be in
    ``summary``. The true rank of ``value`` is within ``rank_error`` ranks of the position wanted; the bound is at
    most epsilon times the number of values.
    """
    slack = summary.groupBy(*span, *[c for c in part if c not in span]).agg(F.max("slack").alias("slack")).groupBy(*span).agg(F.sum("slack").alias("rank_error"))
    # a window over summaries: about 1/epsilon rows for each day of the span, whatever the number of values
    merged = summary.groupBy(*span, "v").agg(F.sum("weight").alias("n"))
    window = Window.partitionBy(*span)
    merged = merged.withColumn("start", F.sum("n").over(window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("total", F.sum("n").over(window))
    hits = F.filter(F.array(*[F.lit(float(p)) for p in wanted]), lambda p: (F.floor(_position(p)) >= F.col("start")) & (F.floor(_position(p)) < F.col("start") + F.col("n")))
    rows = merged.select(*span, "v", "total", F.explode(hits).alias("percentile"))
    out = rows.select(*span, "percentile", F.col("total").alias("n_values"), F.col("v").alias("value"))
    return out.join(slack, span)
