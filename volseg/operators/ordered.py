"""Prefix sums over a distributed sort.

The input is range-partitioned and sorted, and each partition keeps its own running totals. Only the first and the
last group of a partition may go on in another one; the totals of these (partition, group) pairs, a handful for each
partition whatever the number of groups, give the offsets. No group is gathered in one task, however large it is: a
group that holds a third of all rows simply spans a third of the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volseg.storage import Scratch, broadcast_if_small

PID, LOCAL, TOTAL = "_pid", "_local", "_total"
#: Rows of a group that a task holds back until it knows the sum; longer ones are treated like those at the ends.
HELD_ROWS = 1 << 20


def _changes(batch: pa.RecordBatch, names: list[str], before: list | None) -> np.ndarray:
    """True where a row's group differs from the row above it (``before`` for the first row)."""
    n = batch.num_rows
    out = np.zeros(n, dtype=bool)
    out[0] = before is None
    for i, name in enumerate(names):
        col = batch.column(name)
        if before is not None and col[0].as_py() != before[i]:
            out[0] = True
        if n > 1:
            a, b = col.slice(1), col.slice(0, n - 1)
            differ = pc.fill_null(pc.not_equal(a, b), False)
            differ = pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b)))
            out[1:] |= differ.to_numpy(zero_copy_only=False)
    return out


def _totals_within(group: list[str], weight: str):
    most = HELD_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        before, carry = None, 0
        held: list[tuple[pa.RecordBatch, np.ndarray]] = []
        known = False  # whether the sum of the group in hand can be known here: not that of the first one

        def out(batch: pa.RecordBatch, local: np.ndarray, totals: np.ndarray | int | None) -> pa.RecordBatch:
            n = batch.num_rows
            total = pa.nulls(n, pa.int64()) if totals is None else pa.array(np.broadcast_to(totals, n), mask=np.broadcast_to(totals, n) < 0)
            cols = [*batch.columns, pa.array(np.full(n, pid, dtype=np.int32)), pa.array(local), total]
            return pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, PID, LOCAL, TOTAL])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            w = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = _changes(batch, group, before)
            ends = np.cumsum(w)
            begun = ends - w
            at = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
            local = begun - np.where(at >= 0, begun[np.maximum(at, 0)], -carry)
            cuts = np.flatnonzero(starts)
            if len(cuts):
                head = int(cuts[0])
                closed = int(local[head - 1] + w[head - 1]) if head else carry
                yield from (out(b, x, closed) for b, x in held)
                held.clear()
                if head:
                    yield out(batch.slice(0, head), local[:head], closed if known else None)
                inner = int(cuts[-1])
                if inner > head:
                    sums = np.add.reduceat(w[:inner], cuts[:-1])
                    if before is None:
                        sums[0] = -1  # the partition's first group
                    yield out(batch.slice(head, inner - head), local[head:inner], np.repeat(sums, np.diff(cuts)))
                known = before is not None or len(cuts) > 1
                rest, place = batch.slice(inner), local[inner:]
            else:
                rest, place = batch, local
            if known:
                held.append((rest, place))
                if sum(b.num_rows for b, _ in held) > most:
                    known = False
                    yield from (out(b, x, None) for b, x in held)
                    held.clear()
            else:
                yield out(rest, place, None)
            before = [batch.column(g)[n - 1].as_py() for g in group]
            carry = int(local[-1] + w[-1])
        yield from (out(b, x, None) for b, x in held)  # the last group

    return run


def running_totals(df: DataFrame, group: list[str], order: list[str], weight: str, scratch: Scratch, start: str = "start", total: str = "total") -> DataFrame:
    """Add ``start``, the sum of ``weight`` over the group's earlier rows, and ``total``, the group's sum.

    ``weight`` is a non-null bigint. Group columns may be null (null equals null). ``order`` should be total
    within a group; otherwise ties keep the sort's order, which is fixed once written. An empty input gives an
    empty result.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*df.schema.fields, T.StructField(PID, T.IntegerType()), T.StructField(LOCAL, T.LongType()), T.StructField(TOTAL, T.LongType())])
    keys = [*group, *order]
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    rows = scratch.save(ranged.mapInArrow(_totals_within(group, weight), schema))
    whole = rows.where(F.col(TOTAL).isNotNull()).select(*df.columns, F.col(LOCAL).alias(start), F.col(TOTAL).alias(total))
    split = rows.where(F.col(TOTAL).isNull())
    per = split.groupBy(PID, *group).agg(F.sum(weight).alias("_w"))
    within = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    per = per.select(
        F.col(PID).alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.coalesce(F.sum("_w").over(within.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_w").over(within).alias(total),
    )
    per = scratch.save(per)
    same = split[PID] == per["_p"]
    for i, g in enumerate(group):
        same = same & split[g].eqNullSafe(per[f"_g{i}"])
    joined = split.join(broadcast_if_small(per, per.count()), same)
    return whole.unionByName(joined.select(*[split[c] for c in df.columns], (split[LOCAL] + per["_off"]).alias(start), per[total]))
