"""Connected components, spanning forests and grouped execution of sequential kernels over components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from volseg.operators.kernels import stars
from volseg.storage import Scratch

#: Edges that a task folds into its stars at a time, and rows for which a kernel is called at once.
FOLD_ROWS, CALL_ROWS = 1 << 20, 50_000


def _contract(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars: each id with the least one it is linked to within the partition.

    ``whole`` keeps the least ids as well, each with itself.
    """
    a = b = np.array([], dtype=np.int64)
    held: list[pa.RecordBatch] = []

    def fold() -> None:
        nonlocal a, b
        new = [np.concatenate([s, *[x.column(i).to_numpy(zero_copy_only=False) for x in held]]) for i, s in enumerate((a, b))]
        held.clear()
        ids, low = stars(*new)
        keep = (ids != low) | whole
        a, b = ids[keep], low[keep]

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= FOLD_ROWS:
            fold()
    fold()
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _dealt(rows: DataFrame, n: int, key: str) -> DataFrame:
    """``rows``, ``n`` of them, in partitions of some ``FOLD_ROWS`` that are ranges of ``key``."""
    parts = -(-n // FOLD_ROWS)
    return rows.coalesce(1) if parts <= 1 else rows.repartitionByRange(parts, key)


def component_labels(edges: DataFrame, scratch: Scratch, a: str = "s1", b: str = "s2", contract: bool = True) -> DataFrame:
    """``id, cc`` for every id in an edge, ``cc`` the smallest id of its component. Null ends link nothing.

    Each partition replaces its edges by stars, first where they lie, then in ranges of ids of some million links. Ids
    that are met in several ranges tie together the least ids of their stars there; these ties are a smaller graph,
    which is solved likewise. One whose ties are not much fewer, and every graph with ``contract=False``, is taken by
    alternating stars.
    """
    links = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b"))
    links = links.select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b")).where("a IS NOT NULL")
    if not contract:
        return _star_rounds(links, scratch)

    def stars_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _contract(batches, True)

    stars_here = scratch.save(links.mapInArrow(stars_of, "a bigint, b bigint"))
    n = stars_here.count()
    parts = _dealt(stars_here, n, "a").mapInArrow(stars_of, "a bigint, b bigint")
    if n <= FOLD_ROWS:
        out = scratch.save(parts.select(F.col("a").alias("id"), F.col("b").alias("cc")))
        scratch.drop(stars_here)
        return out
    # an id has at most one star in each partition
    met = scratch.save(parts.groupBy("a").agg(F.collect_set("b").alias("_lows")).select(F.col("a").alias("id"), F.array_min("_lows").alias("m"), "_lows"))
    ties = met.where("size(_lows) > 1").select(F.explode("_lows").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    ties = scratch.save(ties)
    scratch.drop(stars_here)
    to = component_labels(ties, scratch, "a", "b", contract=ties.count() < 0.7 * n)
    to = scratch.save(to.select(F.col("id").alias("_low"), "cc"))
    scratch.drop(ties)
    return met.join(to, F.col("m") == F.col("_low"), "left").select("id", F.coalesce("cc", "m").alias("cc"))


def _star_rounds(links: DataFrame, scratch: Scratch) -> DataFrame:
    """The labels of ``a, b`` by stars that alternate over all partitions: in a large star each node's greater neighbours
    are tied to the least id it knows, in a small star its smaller ones. The number of rounds grows with the logarithm
    of the graph; an edge only ever moves to a smaller end, and popular ids meet others as aggregates."""
    ids = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    # two hashes of the edge set tell when it has come to rest
    state = [F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))]
    signature = links.agg(*state).first()
    while signature[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = scratch.save(rest.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        now = small.agg(*state).first()
        scratch.drop(links)
        links = small
        if now == signature:
            break
        signature = now
    roots = links.groupBy("a").agg(F.min("b").alias("cc"))
    return ids.join(roots, F.col("id") == F.col("a"), "left").select("id", F.coalesce("cc", "id").alias("cc"))


def relabel(edges: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
    """Ids replaced by their ``cc``; ids without a label stay."""
    for i, c in enumerate(columns):
        to = labels.select(F.col("id").alias(f"_id{i}"), F.col("cc").alias(f"_cc{i}"))
        edges = edges.join(to, F.col(c) == F.col(f"_id{i}"), "left").withColumn(c, F.coalesce(f"_cc{i}", c)).drop(f"_id{i}", f"_cc{i}")
    return edges


def best_edges(edges: DataFrame, order: Column) -> DataFrame:
    """``id, a, b, key``: for each id at either end the edge of greatest ``order``, which no two edges share."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("id"), "a", "b", order.alias("key"))
    return ends.groupBy("id").agg(F.max(F.struct("key", "a", "b")).alias("_m")).select("id", "_m.a", "_m.b", "_m.key")


def _own_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one partition that are in its maximum spanning forest, by ``score``, ``n1`` and ``n2`` as Spark orders
    them: null, numbers, NaN."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    a, b, n1, n2, score = (table.column(c).to_numpy() for c in ("a", "b", "n1", "n2", "score"))
    null, nan = table.column("score").is_null().to_numpy(), np.isnan(score)
    kind = np.where(null, 0, np.where(nan, 2, 1))
    order = np.lexsort((-n2, -n1, -np.where(nan, 0.0, score), -kind))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, kept = list(range(len(ids))), []
    for i, x, y in zip(order.tolist(), at[: len(a)][order].tolist(), at[len(a) :][order].tolist()):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append(i)
    yield from table.take(np.array(kept, dtype=np.int64)).to_batches()


def spanning_forest(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``s1, s2, score``: the maximum spanning forest of ``score, s1, s2``; ties go to the smaller pair of ids.

    In each round every partition, of some million edges, keeps the forest of its own: what closes a cycle there is in
    no forest of the whole. Then every component takes its best edge to another one; components so linked become
    one, edges within are dropped and of parallel ones the best is kept. At least half of the components vanish in a
    round, until what is left is one partition. Edges of an id with itself and edges with a null end are passed over.
    """
    key = F.struct("score", F.bitwise_not("s1").alias("n1"), F.bitwise_not("s2").alias("n2"))
    rows = edges.where("s1 <> s2").select(F.least("s1", "s2").alias("s1"), F.greatest("s1", "s2").alias("s2"), "score")
    state = scratch.save(rows.groupBy("s1", "s2").agg(F.max("score").alias("score")).select(F.col("s1").alias("a"), F.col("s2").alias("b"), key.alias("key")))
    kept = []
    while n := state.count():
        flat = _dealt(state, n, "a").select("a", "b", "key.*")
        own = scratch.save(flat.mapInArrow(_own_forest, flat.schema).select("a", "b", F.struct("score", "n1", "n2").alias("key")))
        done, state = state, own
        scratch.drop(done)
        if n <= FOLD_ROWS:
            break
        picks = scratch.save(best_edges(state, F.col("key")).select("a", "b", "key").distinct())
        kept.append(picks)
        labels = scratch.save(component_labels(picks, scratch, "a", "b"))
        left = relabel(state, labels, "a", "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "key")
        done, state = state, scratch.save(left.groupBy("a", "b").agg(F.max("key").alias("key")))
        scratch.drop(done, labels)
    out = state.select("key")
    for picks in kept:
        out = out.unionByName(picks.select("key"))
    return out.select(F.bitwise_not("key.n1").alias("s1"), F.bitwise_not("key.n2").alias("s2"), F.col("key.score").alias("score"))


def in_order(edges: DataFrame, nodes: DataFrame, kernel: Callable[[list, dict], dict], state: str, scratch: Scratch, most: int, dead: Callable[[str, str], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups that come of taking edges by falling score, one after the other.

    ``edges``: ``score, s1, s2``; ``nodes``: ``sid`` and the columns named in ``state`` (a DDL string), one row for
    each id. ``kernel(edges, nodes)`` gets (score, a, b) in order and a dict of id to its state as a list; it changes
    the states and returns what stands for each id that was joined to another. Ties go to the smaller pair of ids.

    Components of the edges are independent, so each is one task. Of more than ``most`` edges only those above a higher
    score are taken first, at which no component has more than ``most``, and what comes of them goes into the next
    stage, which takes more of them the smaller the components have been; edges of one and the same score stay together. ``dead(u, v)`` may name pairs, by the
    prefixes of their state columns, between which nothing can happen any more, in whatever order.

    Returns ``id, cc`` for every node and the states of the groups by ``sid``.
    """
    names = [f.name for f in StructType.fromDDL(state)]
    labels = scratch.save(nodes.select(F.col("sid").alias("id"), F.col("sid").alias("cc")))
    nodes = scratch.save(nodes.select("sid", *names))
    left = scratch.save(edges.select("score", F.col("s1").alias("a"), F.col("s2").alias("b"), F.col("s1").alias("o1"), F.col("s2").alias("o2")).where("a <> b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["score"].notna()
        e, n = pdf[at].sort_values(["score", "o1", "o2"], ascending=[False, True, True], kind="stable"), pdf[~at]
        states = dict(zip(n["a"].tolist(), map(list, zip(*[n[c].tolist() for c in names]))))
        stand = kernel(list(zip(e["score"].tolist(), e["a"].tolist(), e["b"].tolist())), states)
        stand = {i: to for i, to in stand.items() if i != to}
        rows = [("stand", i, to, *[None] * len(names)) for i, to in stand.items()]
        rows += [("node", i, None, *v) for i, v in states.items() if i not in stand]
        return pd.DataFrame(rows, columns=["kind", "a", "b", *names])

    room = most
    while True:
        if dead is not None:
            u, v = ([F.col("sid").alias(f"_{p}"), *[F.col(c).alias(f"{p}{c}") for c in names]] for p in "uv")
            both = left.join(nodes.select(*u), F.col("a") == F.col("_u")).join(nodes.select(*v), F.col("b") == F.col("_v"))
            left = scratch.save(both.where(~dead("u", "v")).select("score", "a", "b", "o1", "o2"))
        n = left.count()
        if not n:
            return labels, nodes
        t, now = None, left
        if n > room:
            t = left.agg(F.percentile_approx("score", 1 - room / n)).first()[0]
            now = left.where(F.col("score") > t)
            if not now.limit(1).count():
                t, now = None, left
        while True:
            cc = scratch.save(component_labels(now, scratch, "a", "b"))
            rows = now.join(cc, F.col("a") == F.col("id")).select("cc", "score", "a", "b", "o1", "o2")
            taken, widest = rows.groupBy("cc").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
            if widest <= most:
                break
            middle = now.agg(F.percentile_approx("score", 0.5)).first()[0]
            above = left.where(F.col("score") > middle)
            if not above.limit(1).count():
                break
            t, now = middle, above
        known = nodes.join(cc, F.col("sid") == F.col("id")).select("cc", F.col("sid").alias("a"), *names)
        out = scratch.save(per_component(rows.unionByName(known, allowMissingColumns=True), "cc", run, f"kind string, a bigint, b bigint, {state}"))
        stand = out.where("kind = 'stand'").select(F.col("a").alias("id"), F.col("b").alias("cc"))
        nodes = scratch.save(out.where("kind = 'node'").select(F.col("a").alias("sid"), *names).unionByName(nodes.join(cc, F.col("sid") == F.col("id"), "left_anti")))
        labels = scratch.save(relabel(labels, stand, "cc"))
        rest = left.where(F.lit(False)) if t is None else left.where(F.col("score") <= t)
        left = scratch.save(relabel(rest, stand, "a", "b").where("a <> b"))
        room = max(most, taken * (4 if 8 * widest <= most else 2))


def per_component(rows: DataFrame, cc: str, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run a kernel over all rows of whole components (``cc``, a bigint that is not null).

    Rows are shuffled by component and sorted; a task streams through its own and calls the kernel for some fifty
    thousand rows of whole components at a time, so it holds no more than that or one component. Kernels must not
    depend on which components they see together. Null integers reach them as None, not by way of floats.
    """
    names = rows.columns
    at = names.index(cc)
    target = to_arrow_schema(StructType.fromDDL(schema))
    least = CALL_ROWS

    def call(part: pa.Table) -> pa.RecordBatch:
        out = kernel(part.to_pandas(integer_object_nulls=True))
        return pa.RecordBatch.from_pandas(out, schema=target, preserve_index=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, most = 0, least
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < most:
                continue
            whole = pa.Table.from_batches(held)
            keys = whole.column(at).to_numpy()
            before = np.flatnonzero(keys != keys[-1])
            if len(before):
                cut = int(before[-1]) + 1
                yield call(whole.slice(0, cut))
                held, n, most = whole.slice(cut).to_batches(), whole.num_rows - cut, least
            else:
                most *= 2  # a component larger than a call
        if n:
            yield call(pa.Table.from_batches(held))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, cc).sortWithinPartitions(cc).mapInArrow(run, schema)
