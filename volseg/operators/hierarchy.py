"""Root, depth and path of every node of a child-to-parent table.

Some nodes, chosen by a hash of their id, are splitters. Every node walks up to its next splitter or root, doubling
its stride each round; the splitters alone form a graph some eight times smaller, which is solved the same way, and
each node adds its own walk to what its splitter found. Walks that never meet a splitter or a root run into a loop
without splitters; those nodes are labelled on their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volseg.storage import Scratch, broadcast_if_small

#: One node in so many is a splitter.
SPLIT = 8
OPEN, SPLITTER, ROOT = 0, 1, 2
#: Links of a walk without an end; sums with it stay negative.
ENDLESS = -(1 << 60)


def is_splitter(col: Column) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(SPLIT)) == 0


def parents(df: DataFrame, child: str, parent: str, weight: str) -> DataFrame:
    """``id, up``: of a child's several parents the heaviest (null is lightest), then the smallest id.

    Null and 0 are no ids, and a row of a node with itself links nothing.
    """
    c, p = F.col(child), F.col(parent)
    rows = df.where((c != 0) & (p != 0) & (c != p)).select(c.alias("id"), p.alias("up"), F.col(weight).alias("w"))
    return rows.groupBy("id").agg(F.max_by("up", F.struct("w", F.bitwise_not("up"))).alias("up"))


def all_ids(df: DataFrame, *cols: str) -> DataFrame:
    """``id``: the distinct ids of the columns, without null and 0."""
    out = None
    for c in cols:
        part = df.select(F.col(c).alias("id")).where(F.col("id") != 0)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _stride(state: DataFrame, paths: bool) -> DataFrame:
    """One doubling: an open node takes over what the node it has reached knows."""
    ahead = state.select(F.col("id").alias("at"), F.col("nxt").alias("nxt2"), F.col("hops").alias("hops2"), F.col("low").alias("low2"), F.col("kind").alias("kind2"), *([F.col("walk").alias("walk2")] if paths else []))
    here = state.where(F.col("kind") == OPEN).join(ahead, F.col("nxt") == F.col("at"))
    moved = here.select(
        "id", F.col("nxt2").alias("nxt"), (F.col("hops") + F.col("hops2")).alias("hops"), F.least("low", "low2").alias("low"), F.col("kind2").alias("kind"),
        *([F.concat("walk", "walk2").alias("walk")] if paths else []),
    )
    return state.where(F.col("kind") != OPEN).unionByName(moved)


def _walk(state: DataFrame, scratch: Scratch, paths: bool) -> DataFrame:
    """Double until no node is open, or none was closed in a round: then all open ones run into a loop.

    While a finite walk is open, the node on it that is just beyond the present stride closes in the next round,
    so a round that closes nothing proves that only endless walks are left.
    """
    n = state.where(F.col("kind") == OPEN).count()
    while n:
        step = scratch.save(_stride(state, paths))
        left = step.where(F.col("kind") == OPEN).count()
        scratch.drop(state)
        state, n, before = step, left, n
        if left == before:
            break
    return state


def _loops(state: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, low``: for nodes whose walks never end, the smallest id on the loop they run into.

    All have strides of the same length. The nodes reached are on loops for certain once as many are reached with
    twice the stride; the least id passed is that of the loop once twice the stride lowers it no more.
    """
    state = scratch.save(state.select("id", "nxt", "low"))
    reached = state.select("nxt").distinct().count()
    while True:
        ahead = state.select(F.col("id").alias("at"), F.col("nxt").alias("nxt2"), F.col("low").alias("low2"))
        step = state.join(ahead, F.col("nxt") == F.col("at")).select("id", F.col("nxt2").alias("nxt"), F.least("low", "low2").alias("low"), F.col("low").alias("was"))
        step = scratch.save(step)
        on = step.select(F.col("nxt").alias("id")).distinct()
        now = on.count()
        lowered = step.where("low <> was").join(on, "id", "left_semi").count() if now == reached else 1
        scratch.drop(state)
        state, done, reached = step.drop("was"), now == reached and not lowered, now
        state.saved_at = step.saved_at
        if done:
            break
    ring = state.select(F.col("id").alias("at"), F.col("low").alias("loop_low"))
    return state.join(ring, F.col("nxt") == F.col("at")).select("id", F.col("loop_low").alias("low"))


def resolve(links: DataFrame, ids: DataFrame, scratch: Scratch, paths: bool = False) -> DataFrame:
    """``id, root, n_links`` for every id, and with ``paths`` also ``path``, the ids from the root down to the node.

    ``links``: ``id, up`` with one row per child; ``ids``: all ids. A node on a loop, or below one, gets the
    smallest id on the loop, -1 links and a null path. Ids without a parent are their own root. Empty tables give
    an empty result.
    """
    links = scratch.save(links)
    above = links.select(F.col("id").alias("at"))
    up = F.col("up")
    kind = F.when(F.col("at").isNull(), ROOT).when(is_splitter(up), SPLITTER).otherwise(OPEN)
    walk = [F.array("id").alias("walk")] if paths else []
    state = scratch.save(links.join(above, up == F.col("at"), "left").select("id", up.alias("nxt"), F.lit(1).cast("bigint").alias("hops"), F.col("id").alias("low"), kind.alias("kind"), *walk))
    state = _walk(state, scratch, paths)

    lost = state.where(F.col("kind") == OPEN)
    lost = scratch.save(_loops(lost, scratch)) if lost.limit(1).count() else None

    # the reduced graph: splitters point to splitters or roots; one below a loop without splitters ends there
    reduced = state.where(is_splitter(F.col("id")) & (F.col("kind") != OPEN))
    reduced = reduced.withColumn("kind", F.when(F.col("kind") == ROOT, ROOT).otherwise(OPEN))
    tail = [F.col("walk").alias("walk2")] if paths else []
    none = [F.lit(None).cast("array<bigint>").alias("walk2")] if paths else []
    if lost is not None:
        ends = lost.where(is_splitter(F.col("id"))).select("id", F.col("low").alias("nxt"), F.lit(ENDLESS).alias("hops"), "low", F.lit(ROOT).alias("kind"))
        reduced = reduced.unionByName(ends.withColumn("walk", F.array("id")) if paths else ends)
    reduced = _walk(scratch.save(reduced), scratch, paths)
    solved = reduced.where(F.col("kind") == ROOT).select(F.col("id").alias("at"), F.col("nxt").alias("root2"), F.col("hops").alias("hops2"), *tail)
    endless = reduced.where(F.col("kind") == OPEN)
    if endless.limit(1).count():
        solved = solved.unionByName(_loops(endless, scratch).select(F.col("id").alias("at"), F.col("low").alias("root2"), F.lit(ENDLESS).alias("hops2"), *none))

    by_splitter = state.where(F.col("kind") == SPLITTER).join(solved, F.col("nxt") == F.col("at"))
    path = [F.when(F.col("hops2") >= 0, F.reverse(F.concat("walk", "walk2", F.array("root2")))).alias("path")] if paths else []
    out = by_splitter.select("id", F.col("root2").alias("root"), F.when(F.col("hops2") < 0, F.lit(-1)).otherwise(F.col("hops") + F.col("hops2")).cast("bigint").alias("n_links"), *path)
    path = [F.reverse(F.concat("walk", F.array("nxt"))).alias("path")] if paths else []
    out = out.unionByName(state.where(F.col("kind") == ROOT).select("id", F.col("nxt").alias("root"), F.col("hops").alias("n_links"), *path))
    if lost is not None:
        path = [F.lit(None).cast("array<bigint>").alias("path")] if paths else []
        out = out.unionByName(lost.select("id", F.col("low").alias("root"), F.lit(-1).cast("bigint").alias("n_links"), *path))
    tops = ids.join(links, "id", "left_anti")
    path = [F.array("id").alias("path")] if paths else []
    return out.unionByName(tops.select("id", F.col("id").alias("root"), F.lit(0).cast("bigint").alias("n_links"), *path))


def cut_loops(links: DataFrame, resolved: DataFrame, scratch: Scratch) -> DataFrame | None:
    """``id, root, n_links, path, ring`` for the nodes on or below loops, None if there are none.

    ``links`` and ``resolved`` are what :func:`resolve` takes and gives. The path runs from the smallest id on the
    loop (``root``) down to the node, as if that id had no parent; ``ring`` has all ids on the loop in the same order.
    """
    lost = scratch.save(resolved.where("n_links < 0").select("id", "root"))
    if not lost.limit(1).count():
        return None
    own = scratch.save(links.join(lost, "id").select("id", "up", "root"))
    down = scratch.save(resolve(own.where("id <> root").select("id", "up"), lost.select("id"), scratch, True))
    ends = own.where("id = root").select("root", F.col("up").alias("id"))
    rings = scratch.save(ends.join(down.select("id", F.col("path").alias("ring")), "id").select("root", "ring"))
    n = rings.agg(F.sum(F.size("ring"))).first()[0]
    return down.join(broadcast_if_small(rings, n), "root").select("id", "root", "n_links", "path", "ring")


def descendants(resolved: DataFrame, looped: DataFrame | None = None) -> DataFrame:
    """``ancestor, id, distance``: every pair of a node and another node below it, from the paths of :func:`resolve`.

    The result has as many rows as all depths add up to. Nodes on or below loops have their pairs only if ``looped``,
    from :func:`cut_loops`, is given: all ids on its loop are above each of them.
    """
    rows = resolved.where("n_links > 0").select("id", "n_links", "path")
    if looped is not None:
        rows = rows.unionByName(looped.where("n_links > 0").select("id", "n_links", "path"))
    pairs = rows.select("id", "n_links", F.posexplode("path").alias("pos", "ancestor"))
    pairs = pairs.where(F.col("pos") < F.col("n_links")).select("ancestor", "id", (F.col("n_links") - F.col("pos")).alias("distance"))
    if looped is None:
        return pairs
    # the ids on the loop that the cut has put out of reach; they lie beyond the smallest one
    top = F.size(F.array_intersect("ring", "path"))
    rest = looped.select("id", (F.col("n_links") + F.size("ring")).alias("far"), top.alias("top"), F.posexplode("ring").alias("pos", "ancestor"))
    return pairs.unionByName(rest.where(F.col("pos") >= F.col("top")).select("ancestor", "id", (F.col("far") - F.col("pos")).alias("distance")))
