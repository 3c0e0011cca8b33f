"""Groups of directly or indirectly linked ids, by deterministic Borůvka hooking.

In every round each component picks its smallest outgoing edge; the picks form trees (two components that picked the
same edge make the only kind of loop, and the smaller of the two is taken as root), the trees collapse by pointer
doubling, and the remaining edges are relabelled and made distinct. At least half of the components with edges vanish
in each round. All state lives in tables of the shared folder; the driver sees counts only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volseg.storage import Scratch


def link_edges(*pairs: tuple[DataFrame, str, str]) -> DataFrame:
    """``a, b`` with a < b: the distinct undirected links. Null and 0 are no ids; an id linked to itself is no link."""
    out = None
    for df, x, y in pairs:
        u, v = F.col(x), F.col(y)
        part = df.where((u != 0) & (v != 0) & (u != v)).select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def link_ids(*pairs: tuple[DataFrame, str, str]) -> DataFrame:
    """``id``: every distinct id on either side, linked or not."""
    out = None
    for df, *cols in pairs:
        for c in cols:
            part = df.select(F.col(c).alias("id")).where(F.col("id") != 0)
            out = part if out is None else out.unionByName(part)
    return out.distinct()


def _hook(edges: DataFrame) -> DataFrame:
    """``id, nxt``: each component's other end of its smallest edge, edges compared as (a, b).

    An edge to a smaller component is always less than one to a larger one, so the smallest edge leads to the
    smallest neighbour. A component that picked an edge which its other end picked as well, and is the smaller end,
    is a root and points to itself.
    """
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("nxt")), F.struct(F.col("b").alias("id"), F.col("a").alias("nxt")))).alias("e")
    picks = edges.select(ends).select("e.id", "e.nxt").groupBy("id").agg(F.min("nxt").alias("nxt"))
    return picks


def _collapse(picks: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, nxt`` with ``nxt`` the root of each tree."""
    back = picks.select(F.col("id").alias("at"), F.col("nxt").alias("nxt2"))
    twin = F.col("nxt2") == F.col("id")
    rooted = picks.join(back, F.col("nxt") == F.col("at")).select(
        "id", F.when(twin & (F.col("id") < F.col("nxt")), F.col("id")).otherwise(F.col("nxt")).alias("nxt"),
    )
    state = scratch.save(rooted)
    while True:
        ahead = state.select(F.col("id").alias("at"), F.col("nxt").alias("nxt2"))
        step = scratch.save(state.join(ahead, F.col("nxt") == F.col("at")).select("id", F.col("nxt2").alias("nxt"), (F.col("nxt") != F.col("nxt2")).alias("moved")))
        moved = step.where("moved").limit(1).count()
        scratch.drop(state)
        at = step.saved_at
        state = step.drop("moved")
        state.saved_at = at
        if not moved:
            return state


def components(edges: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, group_id`` for every id, ``group_id`` being the smallest id of its group.

    ``edges``: ``a, b`` with a < b, distinct; ``ids``: every id, also those without links. Empty tables give an
    empty result.
    """
    edges = scratch.save(edges)
    label = None
    while edges.limit(1).count():
        picks = scratch.save(_hook(edges))
        trees = _collapse(picks, scratch)
        low = trees.groupBy("nxt").agg(F.least(F.min("id"), F.col("nxt")).alias("low"))
        root = scratch.save(trees.join(low, "nxt").select(F.col("id").alias("at"), F.col("low")))
        scratch.drop(picks, trees)
        left = edges.join(root, F.col("a") == F.col("at")).select(F.col("low").alias("a"), "b")
        left = left.join(root, F.col("b") == F.col("at")).select("a", F.col("low").alias("b")).where("a <> b")
        done, edges = edges, scratch.save(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if label is None:
            label = root.select(F.col("at").alias("id"), F.col("low").alias("group_id"))
            label.saved_at = root.saved_at
            scratch.drop(done)
        else:
            merged = label.join(root, F.col("group_id") == F.col("at"), "left").select("id", F.coalesce("low", "group_id").alias("group_id"))
            old, label = label, scratch.save(merged)
            scratch.drop(done, old, root)
    if label is None:
        return ids.select("id", F.col("id").alias("group_id"))
    return ids.join(label, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))
