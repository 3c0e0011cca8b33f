"""Mean-affinity agglomeration over the region graph, component by component and in stages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volseg.config import Agglomeration
from volseg.operators import graph, kernels
from volseg.operators.features import join_records, merge_counts
from volseg.operators.graph import component_labels, per_component, relabel, spanning_forest
from volseg.operators.rag import drop_vetoed, region_graph, remap_edges, remap_ids
from volseg.schema import NONE, PROPER
from volseg.storage import Scratch

NODE_COLUMNS = ("supervoxels", "size", "frozen", "n0", "n1", "n2", "state", "id", "count", "total")
EVENTS = "kind string, a bigint, b bigint, sum_aff double, area bigint"
_STATES = EVENTS + "".join(f", {c} {'boolean' if c == 'frozen' else 'bigint'}" for c in NODE_COLUMNS)
#: Edges of a component that one task may hold; wider components are merged in stages.
MOST_EDGES = 1_000_000


def nodes_of(edges: DataFrame, sizes: DataFrame | None = None, counts: DataFrame | None = None, semantics: DataFrame | None = None, nuclei: DataFrame | None = None, frozen: DataFrame | None = None) -> DataFrame:
    """One row of what is known for every id of the edges; inputs that are absent count as nothing."""
    rows = edges.select(F.explode(F.array("s1", "s2")).alias("sid")).distinct()
    zero = F.lit(0).cast("bigint")
    if counts is not None:
        rows = rows.join(counts.groupBy("sid").agg(F.sum("n").alias("supervoxels")), "sid", "left")
    if sizes is not None:
        rows = rows.join(sizes.groupBy("sid").agg(F.sum("size").alias("size")), "sid", "left")
    if semantics is not None:
        rows = rows.join(semantics.groupBy("sid").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(3)]), "sid", "left")
    if nuclei is not None:
        rows = rows.join(join_records(nuclei), "sid", "left")
    if frozen is not None:
        rows = rows.join(frozen.select("sid").distinct().withColumn("frozen", F.lit(True)), "sid", "left")
    have = set(rows.columns)
    out = [F.col("sid")]
    for c in NODE_COLUMNS:
        default = F.lit(1).cast("bigint") if c == "supervoxels" else F.lit(False) if c == "frozen" else zero
        out.append((F.coalesce(F.col(c).cast("boolean" if c == "frozen" else "bigint"), default) if c in have else default).alias(c))
    return rows.select(*out)


def _kernel(p: Agglomeration, by_degree: bool, stop: float | None):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["is_edge"].astype(bool)
        e, n = pdf[at], pdf[~at]
        nodes = {
            int(r.a): kernels.Node(int(r.supervoxels), int(r.size), bool(r.frozen), (int(r.n0), int(r.n1), int(r.n2)), (int(r.state), int(r.id), int(r.count_), int(r.total)))
            for r in n.rename(columns={"count": "count_"}).itertuples(index=False)
        }
        found = kernels.agglomerate(zip(e["a"].tolist(), e["b"].tolist(), e["sum_aff"].tolist(), e["area"].tolist()), nodes, p, by_degree, stop)
        none = (None,) * len(NODE_COLUMNS)
        rows = [("remap", a, b, 0.0, 0, *none) for a, b in found["remap"]]
        stand = dict(found["remap"])
        for old in reversed(list(stand)):
            stand[old] = stand.get(stand[old], stand[old])  # what an id went into is settled before the id itself
        rows += [("stand", a, b, 0.0, 0, *none) for a, b in stand.items()]
        rows += [(kind, *row, *none) for kind, part in found.items() if kind != "remap" for row in part]
        rows += [("node", a, 0, 0.0, 0, v.supervoxels, v.size, v.frozen, *v.labels, *v.nucleus) for a, v in nodes.items()]
        return pd.DataFrame(rows, columns=["kind", "a", "b", "sum_aff", "area", *NODE_COLUMNS])

    return run


def _mean() -> Column:
    return F.when(F.col("area") != 0, F.col("sum_aff") / F.col("area")).otherwise(0.0)


def _summed(edges: DataFrame) -> DataFrame:
    ends = edges.where("s1 <> s2").select(F.least("s1", "s2").alias("s1"), F.greatest("s1", "s2").alias("s2"), "sum_aff", "area")
    return ends.groupBy("s1", "s2").agg(F.sum("sum_aff").alias("sum_aff"), F.sum("area").alias("area"))


def _stage(edges: DataFrame, target: float, most: int, scratch: Scratch) -> tuple[float, DataFrame, DataFrame]:
    """The least threshold at or above the target at which no component has more than ``most`` edges inside, as far as
    halving the edges above it finds one; the edges with the components of their ends; the components.

    Edges of one and the same mean cannot be told apart: a component of such edges stays whole.
    """
    t = target
    while True:
        strong = edges.where(_mean() > t)
        cc = scratch.save(component_labels(strong, scratch))
        ends = edges.join(cc.select(F.col("id").alias("s1"), F.col("cc").alias("c1")), "s1", "left").join(cc.select(F.col("id").alias("s2"), F.col("cc").alias("c2")), "s2", "left")
        ends = scratch.save(ends.withColumn("inner", F.coalesce(F.col("c1") == F.col("c2"), F.lit(False))))
        widest = ends.where("inner").groupBy("c1").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if widest <= most:
            return t, ends, cc
        middle = strong.agg(F.percentile_approx(_mean(), 0.5)).first()[0]
        if not edges.where(_mean() > middle).limit(1).count():
            return t, ends, cc
        scratch.drop(ends, cc)
        t = middle


def agglomerate(edges: DataFrame, nodes: DataFrame, p: Agglomeration, scratch: Scratch, by_degree: bool = True, most: int = MOST_EDGES) -> DataFrame:
    """Merges and edges set aside: ``kind, a, b, sum_aff, area``.

    ``remap`` rows give for each merge the old and the new id. Edges, named by the ids that their segments had at
    that time: ``residual`` (next to frozen segments), ``nucleus``, ``semantic``, ``size`` (vetoed), ``twig`` (merged
    under the twig rule), ``final`` (not above the target).

    Components of the edges above the target do not influence each other: an average of edges that are all at most
    the target is at most the target. Each is one task, unless it has more than ``most`` edges. Then a stage with a
    higher threshold comes first, at which the components are small enough; what it leaves (merged segments with
    their sizes, labels, nuclei and frozen marks, and edges without those set aside) goes into the next stage. The
    merges are those of one queue over the whole graph, as no edge rises above a threshold that a stage has reached.
    Only ``by_degree`` sees a stage: an edge to another component does not count in the degree that names the
    merged segment.
    """
    left = scratch.save(_summed(edges))
    nodes = scratch.save(nodes)
    events = None
    while True:
        t, ends, cc = _stage(left, p.target, most, scratch)
        last = t <= p.target
        e = ends.where("inner").select(F.col("c1").alias("cc"), F.lit(True).alias("is_edge"), F.col("s1").alias("a"), F.col("s2").alias("b"), "sum_aff", "area")
        n = nodes.join(cc.select(F.col("id").alias("_member"), "cc"), F.col("sid") == F.col("_member")).select("cc", F.lit(False).alias("is_edge"), F.col("sid").alias("a"), *NODE_COLUMNS)
        out = scratch.save(per_component(e.unionByName(n, allowMissingColumns=True), "cc", _kernel(p, by_degree, None if last else t), _STATES))
        said = out.where("kind NOT IN ('node', 'stand', 'open')").select("kind", "a", "b", "sum_aff", "area")
        events = said if events is None else events.unionByName(said)
        apart = nodes.join(cc, nodes["sid"] == cc["id"], "left_anti")
        now = scratch.save(out.where("kind = 'node'").select(F.col("a").alias("sid"), *NODE_COLUMNS).unionByName(apart))
        stand = out.where("kind = 'stand'").select(F.col("a").alias("id"), F.col("b").alias("cc"))
        outer = _summed(relabel(ends.where(~F.col("inner")).select("s1", "s2", "sum_aff", "area"), stand, "s1", "s2"))
        if last:
            frozen = now.where("frozen").select("sid")
            outer = outer.join(frozen.select(F.col("sid").alias("s1"), F.lit(True).alias("f1")), "s1", "left").join(frozen.select(F.col("sid").alias("s2"), F.lit(True).alias("f2")), "s2", "left")
            kind = F.when(F.col("f1") & F.col("f2"), "residual").otherwise("final")
            return events.unionByName(outer.select(kind.alias("kind"), F.col("s1").alias("a"), F.col("s2").alias("b"), "sum_aff", "area"))
        opened = out.where("kind = 'open'").select(F.col("a").alias("s1"), F.col("b").alias("s2"), "sum_aff", "area")
        done, left = left, scratch.save(_summed(opened.unionByName(outer)))
        scratch.drop(done, nodes)
        nodes = now


def resolved(events: DataFrame, scratch: Scratch) -> DataFrame:
    """``old, new`` with the least member id for every merged segment."""
    merges = events.where("kind = 'remap'").select(F.col("a").alias("s1"), F.col("b").alias("s2"))
    return component_labels(merges, scratch).select(F.col("id").alias("old"), F.col("cc").alias("new"))


def done_and_ongoing(sizes: DataFrame, remap: DataFrame, frozen: DataFrame) -> DataFrame:
    """``sid, size, route``: merged segment sizes, ``ongoing`` if any member is frozen."""
    rows = remap_ids(sizes.withColumn("_sid", F.col("sid")), remap, "_sid")
    rows = rows.join(frozen.select(F.col("sid").alias("_f")).distinct(), F.col("sid") == F.col("_f"), "left")
    out = rows.groupBy("_sid").agg(F.sum("size").alias("size"), F.max(F.col("_f").isNotNull()).alias("open"))
    return out.select(F.col("_sid").alias("sid"), "size", F.when(F.col("open"), "ongoing").otherwise("done").alias("route"))


def match(rows: DataFrame, nuclei: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Matches of segments over chunk faces, the largest agglomerate first: ``kind, a, b``.

    ``remap`` rows hold each id and what stands for it, the ``nid`` of its group's first match; ``cut`` rows the pairs
    that their nuclei forbid. ``rows``: ``oid, boundary_size, nid, agg_size`` (null and 0 ends, and repeats, are passed
    over; a null size is least). Matches come by falling ``agg_size``, then rising ``nid`` and ``oid``.

    No queue is needed. A group without a nucleus is certain to accept its first match to another group, whatever
    comes before, so in each round all such groups take theirs at once; a tree of them holds at most one nucleus.
    When no group without a nucleus is left with a match, matches between groups of the same nucleus join them,
    in any order, and the others are cut.
    """
    rows = rows.where((F.col("oid") != 0) & (F.col("nid") != 0)).select("oid", "nid", F.coalesce("agg_size", F.lit(-1)).cast("bigint").alias("agg_size"))
    rows = scratch.save(rows.groupBy("oid", "nid").agg(F.max("agg_size").alias("agg_size")))
    key = F.struct("agg_size", F.bitwise_not("nid").alias("n"), F.bitwise_not("oid").alias("o"))
    if nuclei is None:
        labels = scratch.save(component_labels(rows, scratch, "oid", "nid"))
    else:
        ids = rows.select(F.explode(F.array("oid", "nid")).alias("id")).distinct()
        known = join_records(nuclei).where(F.col("state") != NONE).select(F.col("sid").alias("id"), "state", F.col("id").alias("nucleus"))
        zero = F.lit(0).cast("bigint")
        labels = scratch.save(ids.join(known, "id", "left").select("id", F.col("id").alias("cc"), F.coalesce(F.col("state").cast("bigint"), zero).alias("state"), F.coalesce(F.col("nucleus").cast("bigint"), zero).alias("nucleus")))
        groups = labels.select("cc", "state", "nucleus")
        left = scratch.save(rows.where("oid <> nid").select(F.col("oid").alias("a"), F.col("nid").alias("b"), key.alias("key")))
        while True:
            bare = groups.where(F.col("state") == NONE).select(F.col("cc").alias("_g"))
            picks = scratch.save(graph.best_edges(left, F.col("key")).join(bare, F.col("id") == F.col("_g"), "left_semi").select("a", "b").distinct())
            if not picks.limit(1).count():
                break
            tree = scratch.save(component_labels(picks, scratch, "a", "b"))
            labels, left, groups = _regroup(labels, left, tree, scratch)
            scratch.drop(tree, picks)
        own = groups.where(F.col("state") == PROPER).select("cc", "nucleus")
        alike = left.join(own.select(F.col("cc").alias("a"), F.col("nucleus").alias("n1")), "a").join(own.select(F.col("cc").alias("b"), F.col("nucleus").alias("n2")), "b").where("n1 = n2")
        tree = scratch.save(component_labels(alike, scratch, "a", "b"))
        labels, _, _ = _regroup(labels, left, tree, scratch)
    to = labels.select("id", "cc")
    ends = scratch.save(rows.join(to.select(F.col("id").alias("oid"), F.col("cc").alias("g1")), "oid").join(to.select(F.col("id").alias("nid"), F.col("cc").alias("g2")), "nid"))
    first = ends.where("g1 = g2").groupBy(F.col("g1").alias("cc")).agg(F.max_by("nid", key).alias("first"))
    remap = to.join(first, "cc", "left").select(F.lit("remap").alias("kind"), F.col("id").alias("a"), F.coalesce("first", "id").alias("b"))
    return remap.unionByName(ends.where("g1 <> g2").select(F.lit("cut").alias("kind"), F.col("oid").alias("a"), F.col("nid").alias("b")))


def stand_ins(matches: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """``old, new`` of the ``remap`` rows of :func:`match`; ``extra`` remaps (``old, new``) are followed by them."""
    own = matches.where("kind = 'remap'").select(F.col("a").alias("old"), F.col("b").alias("new"))
    if extra is None:
        return own
    moved = remap_ids(extra.select("old", "new"), own, "new")
    return own.unionByName(moved.join(own.select("old"), "old", "left_anti"))


def matched(stand: DataFrame, edges: DataFrame | None = None, cuts: DataFrame | None = None, boundary: DataFrame | None = None, counts: DataFrame | None = None, sizes: DataFrame | None = None, semantics: DataFrame | None = None, nuclei: DataFrame | None = None) -> dict[str, DataFrame]:
    """What is known of the parts of segments, for the matched segments; each table that is given comes back merged.

    ``stand``: ``old, new``. ``edges`` lose those that have become loops and the pairs in ``cuts`` (``s1, s2``);
    ``boundary`` (``face, sid``) is made distinct; ``counts`` (``sid, n, boundary``) of overlapping parts share a
    supervoxel; ``sizes`` and ``semantics`` add up; ``nuclei`` are joined as records.
    """
    def moved(df: DataFrame) -> DataFrame:
        return remap_ids(df, stand, "sid")

    out = {}
    if edges is not None:
        merged = remap_edges(edges, stand)
        out["edges"] = merged if cuts is None else drop_vetoed(merged, remap_ids(cuts.select("s1", "s2"), stand, "s1", "s2"))
    if boundary is not None:
        out["boundary"] = moved(boundary).select("face", "sid").distinct()
    if counts is not None:
        out["counts"] = merge_counts(moved(counts))
    if sizes is not None:
        out["sizes"] = moved(sizes).groupBy("sid").agg(F.sum("size").alias("size"))
    if semantics is not None:
        out["semantics"] = moved(semantics).groupBy("sid").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(3)])
    if nuclei is not None:
        out["nuclei"] = join_records(moved(nuclei))
    return out


def _regroup(labels: DataFrame, left: DataFrame, tree: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, matches between groups, and the groups' nuclei once the groups of ``tree`` (``id, cc``) are one."""
    moved = labels.join(tree.select(F.col("id").alias("_g"), F.col("cc").alias("_to")), F.col("cc") == F.col("_g"), "left").select("id", F.coalesce("_to", "cc").alias("cc"), "state", "nucleus")
    moved = scratch.save(moved)
    # of the groups in a tree at most one has a nucleus, or all have the same
    groups = scratch.save(moved.groupBy("cc").agg(F.max("state").alias("state"), F.max("nucleus").alias("nucleus")))
    left = relabel(left, tree, "a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "key")
    return moved, scratch.save(left.groupBy("a", "b").agg(F.max("key").alias("key"))), groups


__all__ = ["MOST_EDGES", "agglomerate", "done_and_ongoing", "match", "matched", "nodes_of", "region_graph", "resolved", "spanning_forest", "stand_ins"]
