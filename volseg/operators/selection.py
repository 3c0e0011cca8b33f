"""Exact selection by refining value histograms, for keys of any popularity.

A wanted rank starts with the range of its key's values. Each round counts the values of every range that still holds
one in 65,536 equal steps; the counts, with the least and greatest value met in a step, are combined before the
shuffle, so a key that holds a third of all rows reaches it as counts, never as rows. The step that holds the rank is
the next range, cut to the values met in it, until that is one value. Counts of parts, days or tables add up, so the
histograms can be merged before they are searched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volseg.storage import Scratch, broadcast_if_small

#: Steps of a range in one round, and the share of all rows from which a key's ranges are broadcast.
STEPS, HOT = 1 << 16, 1000


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, v, n``: the finest histogram; rows with a null value are left out, null keys are kept."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))


def merge_histograms(*parts: DataFrame) -> DataFrame:
    """Add histograms of the same keys, for instance of several days."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    keys = [c for c in whole.columns if c not in ("v", "n")]
    return whole.groupBy(*keys, "v").agg(F.sum("n").alias("n"))


def key_ranges(hist: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, total, lo, hi, n_rows``: count, least and greatest value of every key, and its rows in ``hist``."""
    return hist.groupBy(*keys).agg(F.sum("n").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n_rows"))


def _step(kind: T.DataType) -> Column:
    """The step of ``v`` in ``lo..hi``: it never falls as v rises, and it is 0 at ``lo`` and the last one at ``hi``."""
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    if isinstance(kind, T.DoubleType):
        far = (hi - lo) > F.lit(1.7e308)  # beyond the doubles; then both sides are halved
        at, width = F.when(far, v / 2 - lo / 2).otherwise(v - lo), F.when(far, hi / 2 - lo / 2).otherwise(hi - lo)
    else:
        a, b = F.shiftright(hi, 1) - F.shiftright(lo, 1), F.shiftright(v, 1) - F.shiftright(lo, 1)
        far = a > F.lit(1 << 60)  # beyond the 64-bit integers; then the last bit is left out
        at, width = F.when(far, b).otherwise(F.when(~far, v) - F.when(~far, lo)).cast("double"), F.when(far, a).otherwise(F.when(~far, hi) - F.when(~far, lo)).cast("double")
    return F.least(F.floor(at / width * F.lit(float(STEPS - 1))), F.lit(STEPS - 1)).cast("int")


def _counted(hist: DataFrame, ranges: DataFrame, whole: int, keys: list[str], scratch: Scratch) -> DataFrame:
    """``keys, lo, step, n, least, greatest`` of the values within the ranges (``keys, lo, hi, n_rows``).

    ``whole``: the rows of ``hist``. Ranges of keys with at least a thousandth of the rows are at most as many as a thousand keys have; they are
    broadcast, so that popular keys are not shuffled. The others meet their rows in a shuffle, unless they are few.
    """
    ranges = scratch.save(ranges)
    hot = F.col("n_rows") * HOT >= whole
    n_hot, n_cold = ranges.agg(F.count_if(hot), F.count_if(~hot)).first()
    kind = hist.schema["v"].dataType
    out = None
    parts = [(ranges, True)] if n_cold <= 200_000 else [(ranges.where(hot), True), (ranges.where(~hot), False)]
    for part, small in parts:
        r = part.select(*[F.col(k).alias(f"_{k}") for k in keys], "lo", "hi")
        on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("v") >= F.col("lo"), F.col("v") <= F.col("hi")]
        rows = hist.join(broadcast_if_small(r, n_hot + n_cold if part is ranges else n_hot) if small else r, on)
        counts = rows.groupBy(*keys, "lo", _step(kind).alias("step")).agg(F.sum("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("greatest"))
        out = counts if out is None else out.unionByName(counts)
    return out


def select_ranks(hist: DataFrame, targets: DataFrame, keys: list[str], scratch: Scratch, ranges: DataFrame | None = None) -> DataFrame:
    """``keys, target, rank, v, n``: the value at each wanted rank and how often its key has it.

    ``hist``: ``keys, v, n`` with v bigint or double (finite); rows may repeat, and it is read once a round, so pass
    a table. ``targets``: ``keys, target, rank`` with 0-based ranks; a rank outside the key's count gives no row.
    Keys must not be null. ``ranges``: :func:`key_ranges` of ``hist`` if they are known already.
    """
    ranges = key_ranges(hist, keys) if ranges is None else ranges
    start = targets.select(*keys, "target", "rank").join(ranges, keys).where((F.col("rank") >= 0) & (F.col("rank") < F.col("total")))
    state = scratch.save(start.select(*keys, "target", "rank", F.col("rank").alias("left"), "lo", "hi", F.col("total").alias("n"), "n_rows"))
    whole = ranges.agg(F.sum("n_rows")).first()[0] or 0
    found = []
    while True:
        found.append(state.where("lo = hi").select(*keys, "target", "rank", F.col("lo").alias("v"), "n"))
        wide = state.where("lo < hi")
        if not wide.limit(1).count():
            break
        counts = _counted(hist, wide.select(*keys, "lo", "hi", "n_rows").distinct(), whole, keys, scratch)
        # at most 65,536 rows in a window: one for each step of the range
        within = Window.partitionBy(*keys, "lo").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.sum("n").over(within)).withColumnRenamed("n", "n_step")
        met = wide.drop("hi", "n").join(counts, [*keys, "lo"]).where((F.col("left") >= F.col("upto") - F.col("n_step")) & (F.col("left") < F.col("upto")))
        state = scratch.save(met.select(*keys, "target", "rank", (F.col("left") - F.col("upto") + F.col("n_step")).alias("left"), F.col("least").alias("lo"), F.col("greatest").alias("hi"), F.col("n_step").alias("n"), "n_rows"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def quantile_targets(counts: DataFrame, keys: list[str], quantiles: list[float]) -> DataFrame:
    """``keys, target, rank`` of the lower nearest rank of each quantile; ``counts`` holds ``keys, total``."""
    pairs = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q")) for q in quantiles])).alias("_q")
    return counts.select(*keys, "total", pairs).select(*keys, F.col("_q.q").alias("target"), F.floor(F.col("_q.q") * (F.col("total") - 1)).cast("bigint").alias("rank"))


def frequent_values(df: DataFrame, key: str, value: str, totals: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Values that make up at least ``percent`` per cent of a key's rows: ``key, v, n``.

    ``totals``: ``key, total`` with the row count that the share refers to, nulls included. A value that fills m
    rows in value order covers a multiple of m, so the values at ranks m-1, 2m-1, ... hold all that are frequent
    enough. :func:`select_ranks` finds them from the rows themselves, at most 100 / ``percent`` ranges for each key,
    and with each the exact count, which decides. Null values are no cases.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(key, F.col(value).alias("v"), F.lit(1).cast("bigint").alias("n"))
    ranges = scratch.save(key_ranges(rows, [key]))
    least = F.greatest(F.ceil(F.col("total") * percent / 100), F.lit(1)).cast("bigint")
    ranks = totals.select(key, least.alias("m")).join(ranges.select(key, F.col("total").alias("have")), key).where("have >= m")
    ranks = ranks.select(key, F.explode(F.sequence(F.col("m") - 1, F.col("have") - 1, F.col("m"))).alias("rank"))
    got = select_ranks(rows, ranks.select(key, F.col("rank").alias("target"), "rank"), [key], scratch, ranges)
    return got.select(key, "v", "n").distinct().join(totals, key).where(F.col("n") * 100 >= F.col("total") * percent).select(key, "v", "n")


def keyed_totals(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Row count and sums for every key; partial sums before the shuffle make popular keys cheap."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[F.sum(c).alias(name) for name, c in sums.items()])
