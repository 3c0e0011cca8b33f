"""A mixture of sources at target weights, by weighted fair queueing.

Each source's documents are shuffled by a hash; a document's virtual finish time is the sum of its source's tokens up
to and including it, divided by the source's weight. In the order of these times every source has at any moment its
share of the tokens taken so far, up to one document. The order is a global range sort, cut off at the budget. A
further pass over a source comes after the one before, up to the source's repeats.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volseg.operators.ordered import running_totals
from volseg.storage import Scratch

SEED = 20_250


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    repeats: int


def canonical(col: Column) -> Column:
    """A source's name without the differences in case, separators and surrounding space."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s_-]+", "_")


def largest_budget(totals: dict[str, int], targets: list[Target]) -> float:
    """The most tokens at which no source runs out, the shares of sources without documents being spread."""
    present = [t for t in targets if totals.get(t.source, 0) > 0 and t.share > 0 and t.repeats > 0]
    whole = sum(t.share for t in present)
    return min((totals[t.source] * t.repeats / (t.share / whole) for t in present), default=0.0)


def mix(counts: DataFrame, targets: list[Target], scratch: Scratch, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """``position, doc_id, source, repeat_no, n_tokens, virtual_finish``; ``position`` counts tokens before the row.

    ``counts``: ``doc_id, source, n_tokens``. Documents of other sources, of none, and without tokens are not
    taken. ``targets`` is a small fixed list. ``budget``: tokens in all; by default the most at which all sources
    keep their shares. Beyond that a source that has run out leaves its share to the others.
    """
    names = [t.source for t in targets]
    rows = counts.select("doc_id", canonical(F.col("source")).alias("source"), "n_tokens").where(F.col("source").isin(names) & (F.col("n_tokens") > 0))
    rows = rows.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id"))
    lined = scratch.save(running_totals(rows, ["source"], ["_key", "doc_id", "n_tokens"], "n_tokens", scratch))
    # one row for each target at most
    sizes = {r.source: (r.total, r.longest) for r in lined.groupBy("source").agg(F.max("total").alias("total"), F.max("n_tokens").alias("longest")).collect()}
    totals = {s: t for s, (t, _) in sizes.items()}
    most = largest_budget(totals, targets)
    budget = int(most) if budget is None else int(budget)
    used = [t for t in targets if t.source in sizes and t.share > 0 and t.repeats > 0]
    whole = sum(t.share for t in used)
    if not used:
        empty = lined.limit(0)
        return empty.select(F.lit(0).cast("bigint").alias("position"), "doc_id", "source", F.lit(0).alias("repeat_no"), "n_tokens", F.lit(0.0).alias("virtual_finish"))
    share = F.coalesce(*[F.when(F.col("source") == t.source, F.lit(t.share / whole)) for t in used])
    repeats = F.coalesce(*[F.when(F.col("source") == t.source, F.lit(int(t.repeats))) for t in used])
    lined = lined.where(F.col("source").isin([t.source for t in used]))
    copies = lined.select("doc_id", "source", "n_tokens", "start", "total", share.alias("share"), F.explode(F.sequence(F.lit(0), repeats - 1)).alias("repeat_no"))
    finish = (F.col("repeat_no").cast("bigint") * F.col("total") + F.col("start") + F.col("n_tokens")) / F.col("share")
    copies = copies.select("doc_id", "source", "n_tokens", "repeat_no", finish.alias("virtual_finish"))
    if budget <= most:
        # by that time the sources have filled the budget, each to within its longest document
        copies = copies.where(F.col("virtual_finish") <= F.lit(float(budget + sum(sizes[t.source][1] for t in used))))
    queue = running_totals(copies, [], ["virtual_finish", "source", "doc_id", "repeat_no"], "n_tokens", scratch, start="position", total="_all")
    return queue.where(F.col("position") + F.col("n_tokens") <= budget).select("position", "doc_id", "source", "repeat_no", "n_tokens", "virtual_finish")


def shares_report(mixture: DataFrame, targets: list[Target]) -> DataFrame:
    """``source, target_share, max_repeats, n_rows, n_docs, n_tokens, actual_share, most_repeats`` of every target."""
    spark = mixture.sparkSession
    wanted = spark.createDataFrame([(t.source, float(t.share), int(t.repeats)) for t in targets], "source string, target_share double, max_repeats int")
    got = mixture.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("repeat_no") == 0).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), (F.max("repeat_no") + 1).alias("most_repeats"),
    )
    both = wanted.join(got, "source", "left")
    both = both.withColumn("all_tokens", F.sum("n_tokens").over(Window.partitionBy(F.lit(0))))  # a row for each target
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_rows", "n_docs", "n_tokens", "most_repeats")]
    return both.select("source", "target_share", "max_repeats", *zero, F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"))


def kept_report(mixture: DataFrame, counts: DataFrame, targets: list[Target]) -> DataFrame:
    """For every target ``source, present, n_too_often, n_out_of_turn, on_target``.

    ``n_too_often``: documents taken more often than ``max_repeats`` or twice in one pass. ``n_out_of_turn``: rows
    taken in a further pass while a document of the source had not been taken in the one before. ``on_target``: the
    source's tokens are within its longest document, and those of the others, of its share; true for absent ones.
    """
    spark = mixture.sparkSession
    wanted = spark.createDataFrame([(t.source, float(t.share), int(t.repeats)) for t in targets], "source string, share double, repeats int")
    rows = counts.select(canonical(F.col("source")).alias("source"), "n_tokens").where("n_tokens > 0")
    have = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_tokens").alias("longest"))
    times = mixture.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("repeat_no").alias("passes"))
    often = times.join(wanted, "source").groupBy("source").agg(F.count_if((F.col("n") > F.col("repeats")) | (F.col("n") != F.col("passes"))).alias("n_too_often"))
    passes = mixture.groupBy("source", "repeat_no").agg(F.count(F.lit(1)).alias("n"))
    later = passes.select("source", (F.col("repeat_no") - 1).alias("repeat_no"), F.col("n").alias("n_later"))
    turns = passes.join(later, ["source", "repeat_no"]).join(have, "source").groupBy("source").agg(F.sum(F.when(F.col("n") != F.col("n_docs"), F.col("n_later")).otherwise(0)).alias("n_out_of_turn"))
    took = mixture.groupBy("source").agg(F.sum("n_tokens").alias("took"))
    out = wanted.join(have, "source", "left").join(often, "source", "left").join(turns, "source", "left").join(took, "source", "left")
    # windows over a row for each target
    every = Window.partitionBy(F.lit(0))
    present = F.col("n_docs").isNotNull()
    out = out.withColumn("part", F.col("share") / F.sum(F.when(present & (F.col("share") > 0) & (F.col("repeats") > 0), F.col("share"))).over(every)).withColumn("all", F.sum("took").over(every)).withColumn("slack", F.sum("longest").over(every))
    near = F.abs(F.col("took") - F.col("part") * F.col("all")) <= F.col("slack")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_too_often", "n_out_of_turn")]
    return out.select("source", present.alias("present"), *zero, (~present | F.coalesce(near, F.col("part") == 0, F.lit(False))).alias("on_target"))
