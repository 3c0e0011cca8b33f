"""Containers of fixed capacity filled with documents, by linear grouping.

Large lengths are rounded up within groups of equal cardinality, which leaves a few sizes; the best mix of container
configurations over these sizes is the solution of a small linear program, solved by column generation. Actual
documents then take the places of the sizes, and the small documents go, largest first, where they fit best. A text
is split only if it exceeds the capacity: into pieces of exactly the capacity, which fill a container each, and a rest
that is packed like any other document.

Documents are packed in shards by a hash of their id, so tasks are equally large whatever the data; a shard wastes at
most about one container.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volseg.storage import Scratch

#: Documents in a shard, and the share of the capacity from which a length is large.
SHARD = 25_000
LARGE = 1 / 7
#: Relative gap at which the linear program counts as solved.
GAP = 1e-3
#: Exchanges of a configuration within which a linear program must be solved; a few hundred are usual.
ROUNDS = 20_000


def distinct_sizes(capacity: int) -> int:
    """Sizes after rounding: more for small containers, where a token of rounding weighs more and pricing is cheap."""
    return min(128, max(48, (1 << 17) // capacity))


def _best_pattern(sizes: np.ndarray, values: np.ndarray, capacity: int, most: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest total value: a knapsack over the number of items placed."""
    best = np.zeros(capacity + 1)
    choices = []
    useful = [k for k in range(len(sizes)) if values[k] > 1e-12]
    for _ in range(most):
        nxt, pick = best.copy(), np.full(capacity + 1, -1, dtype=np.int32)
        for k in useful:
            s = int(sizes[k])
            candidate = best[: capacity + 1 - s] + values[k]
            better = candidate > nxt[s:] + 1e-12
            nxt[s:][better] = candidate[better]
            pick[s:][better] = k
        choices.append(pick)
        if np.array_equal(nxt, best):
            break
        best = nxt
    pattern, w = np.zeros(len(sizes), dtype=np.int64), capacity
    for pick in reversed(choices):
        k = pick[w]
        if k >= 0:
            pattern[k] += 1
            w -= int(sizes[k])
    return float(best[capacity]), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (one in each column) and how often to use each: the linear program min sum x, Ax = demand.

    Ends once the best further configuration has a value of at most 1 + ``GAP``: the containers used are then
    within that factor of the least possible. The demand is shifted by tiny unequal amounts against stalling; a
    program that is not solved after ``ROUNDS`` exchanges is an error.
    """
    k = len(sizes)
    basis = np.diag(np.maximum(1, capacity // sizes)).astype(float)
    most = int(capacity // sizes.min())
    demand = demand + 1e-4 * (1 + np.arange(k)) / k
    inverse = np.diag(1 / np.diag(basis))
    for _ in range(ROUNDS):
        x = inverse @ demand
        duals = inverse.sum(axis=0)
        value, pattern = _best_pattern(sizes, np.maximum(duals, 0), capacity, most)
        if value <= 1 + GAP:
            break
        u = inverse @ pattern
        ratio = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
        leaving = int(np.argmin(ratio))
        if not np.isfinite(ratio[leaving]):
            raise ArithmeticError("the linear program of the configurations is unbounded")
        basis[:, leaving] = pattern
        # the inverse follows by one elimination step
        inverse[leaving] /= u[leaving]
        u[leaving] = 0
        inverse -= np.outer(u, inverse[leaving])
    else:
        raise ArithmeticError(f"the linear program of the configurations is not solved after {ROUNDS} exchanges")
    x = np.linalg.solve(basis, demand)
    return np.rint(basis).astype(np.int64), np.maximum(x, 0)


def pack(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each length; every length must be between 1 and the capacity."""
    n = len(lengths)
    container = np.full(n, -1, dtype=np.int64)
    if not n:
        return container
    order = np.argsort(-lengths, kind="stable")
    n_large = int((lengths > capacity * LARGE).sum())
    rooms: list[int] = []  # what is left in each container

    if n_large:
        groups = [g for g in np.array_split(order[:n_large], min(distinct_sizes(capacity), n_large)) if len(g)]
        demands: dict[int, int] = {}
        for g in groups:
            demands[int(lengths[g[0]])] = demands.get(int(lengths[g[0]]), 0) + len(g)
        sizes = np.array(sorted(demands, reverse=True), dtype=np.int64)
        demand = np.array([demands[int(s)] for s in sizes], dtype=float)
        patterns, times = configurations(sizes, demand, capacity)
        waiting = sorted((int(lengths[i]), int(i)) for i in order[:n_large])
        for j in np.argsort(-times, kind="stable"):
            places = [int(sizes[k]) for k, c in enumerate(patterns[:, j]) for _ in range(c)]
            for _ in range(int(np.floor(times[j] + 1e-6))):
                # a place takes the largest document that leaves the later places the sizes they were planned for
                room, kept, at = capacity, sum(places), len(rooms)
                for size in places:
                    kept -= size
                    found = bisect_left(waiting, (room - kept + 1, -1)) - 1
                    if found < 0:
                        continue
                    length, i = waiting.pop(found)
                    container[i] = at
                    room -= length
                if room < capacity:
                    rooms.append(room)

    # what the fractions left over, and the small ones: largest first, each where least room stays
    free = sorted((r, c) for c, r in enumerate(rooms) if r)
    for i in order:
        if container[i] >= 0:
            continue
        size = int(lengths[i])
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, c = free.pop(at)
        else:
            room, c = capacity, len(rooms)
            rooms.append(capacity)
        container[i] = c
        if room > size:
            insort(free, (room - size, c))
    return container


def pack_documents(counts: DataFrame, bins: list[tuple[str, int]], scratch: Scratch) -> DataFrame:
    """``bin_code, container, doc_id, piece_no, start_token, n_tokens`` for every kind of container.

    ``counts``: ``doc_id, n_tokens``, a saved table; ``bins``: code and capacity of the container kinds, a small
    fixed list (codes of null or capacities below 1 are passed over). Documents without tokens have nothing to put
    anywhere: they come out with a null container and piece 0. Rows with the same id are packed each on its own.
    """
    bins = [(code, int(c)) for code, c in bins if code is not None and c and c > 0]
    shards = max(1, -(-counts.count() // SHARD))
    kinds = F.explode(F.array(*[F.struct(F.lit(code).alias("bin_code"), F.lit(c).cast("bigint").alias("capacity")) for code, c in bins])).alias("_bin")
    each = counts.select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n"), kinds).select("doc_id", "n", "_bin.bin_code", "_bin.capacity")
    full = F.when(F.col("n") > F.col("capacity"), F.floor(F.col("n") / F.col("capacity"))).otherwise(0).cast("bigint")
    each = each.withColumn("n_full", full)

    none = each.where("n = 0").select("bin_code", F.lit(None).cast("string").alias("container"), "doc_id", F.lit(0).cast("bigint").alias("piece_no"), F.lit(0).cast("bigint").alias("start_token"), F.lit(0).cast("bigint").alias("n_tokens"))
    whole = each.where("n_full > 0").select("bin_code", "capacity", "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_full") - 1)).alias("piece_no"), F.monotonically_increasing_id().alias("_row"))
    whole = whole.select("bin_code", F.concat(F.lit("full-"), F.col("_row").cast("string"), F.lit("-"), F.col("piece_no").cast("string")).alias("container"), "doc_id", "piece_no", (F.col("piece_no") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"))

    rest = each.withColumn("size", F.col("n") - F.col("n_full") * F.col("capacity")).where("size > 0")
    rest = rest.select("bin_code", "capacity", "doc_id", F.col("n_full").alias("piece_no"), "size", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        code, shard = key
        pdf = pdf.sort_values(["doc_id", "size"], kind="stable")
        at = pack(pdf["size"].to_numpy(), int(pdf["capacity"].iloc[0]))
        return pd.DataFrame({
            "bin_code": code, "container": [f"shard-{shard}-{c}" for c in at], "doc_id": pdf["doc_id"].to_numpy(), "piece_no": pdf["piece_no"].to_numpy(),
            "start_token": (pdf["piece_no"] * pdf["capacity"]).to_numpy(), "n_tokens": pdf["size"].to_numpy(),
        })

    schema = "bin_code string, container string, doc_id bigint, piece_no bigint, start_token bigint, n_tokens bigint"
    # a group is a shard and a kind; several of them share a task once there are more than the session's partitions
    parts = min(shards * len(bins), int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = rest.repartition(parts, "bin_code", "shard").groupBy("bin_code", "shard").applyInPandas(run, schema)
    return packed.unionByName(whole).unionByName(none)


def fill_report(packed: DataFrame, bins: list[tuple[str, int]]) -> DataFrame:
    """``bin_code, capacity_tokens, n_containers, n_tokens, unused_share, fewest``: how full the containers are.

    ``fewest`` is the number of containers that no packing can go below.
    """
    capacity = F.coalesce(*[F.when(F.col("bin_code") == code, F.lit(int(c))) for code, c in bins if code is not None and c and c > 0])
    loads = packed.where("container IS NOT NULL").groupBy("bin_code", "container").agg(F.sum("n_tokens").alias("load"))
    out = loads.groupBy("bin_code").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("load").alias("n_tokens"), F.max("load").alias("fullest"))
    out = out.withColumn("capacity_tokens", capacity)
    space = F.col("n_containers") * F.col("capacity_tokens")
    return out.select("bin_code", "capacity_tokens", "n_containers", "n_tokens", "fullest", ((space - F.col("n_tokens")) / space).alias("unused_share"), F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).cast("bigint").alias("fewest"))


def kept_report(packed: DataFrame, counts: DataFrame, bins: list[tuple[str, int]]) -> DataFrame:
    """``bin_code, capacity_tokens, n_docs`` and, for each kind, how many containers are overfull, documents have not
    all their tokens placed, are split though they fit, or have pieces that overlap: all 0 if the packing is right.

    Rows with the same id count as one document with the sum of their tokens.
    """
    capacity = F.coalesce(*[F.when(F.col("bin_code") == code, F.lit(int(c))) for code, c in bins if code is not None and c and c > 0]).cast("bigint")
    loads = packed.where("container IS NOT NULL").groupBy("bin_code", "container").agg(F.sum("n_tokens").alias("load"))
    full = loads.groupBy("bin_code").agg(F.count_if(F.col("load") > capacity).alias("n_overfull"))
    pieces = packed.groupBy("bin_code", "doc_id").agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("n_pieces"), F.count_distinct("piece_no").alias("n_numbers"), F.max(F.col("start_token") + F.col("n_tokens")).alias("until"))
    known = counts.groupBy("doc_id").agg(F.sum(F.coalesce("n_tokens", F.lit(0))).alias("want"), F.count(F.lit(1)).alias("n_rows"))
    both = pieces.join(known, "doc_id", "left")
    once = F.col("n_rows") == 1
    docs = both.groupBy("bin_code").agg(
        F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("want").isNull() | (F.col("placed") != F.col("want"))).alias("n_incomplete"),
        F.count_if(once & (F.col("want") <= capacity) & (F.col("n_pieces") > 1)).alias("n_split_without_need"),
        F.count_if(once & ((F.col("n_pieces") != F.col("n_numbers")) | (F.col("until") != F.col("placed")))).alias("n_overlapping"),
    )
    return docs.join(full, "bin_code").select("bin_code", capacity.alias("capacity_tokens"), "n_docs", "n_overfull", "n_incomplete", "n_split_without_need", "n_overlapping")
