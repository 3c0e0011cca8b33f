"""Features of segments; each is one aggregation with partial sums before the shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volseg.operators.condition import KEY
from volseg.operators.rag import remap_ids
from volseg.schema import CONFLICT, NONE, PROPER

#: Feature name to (columns of the voxel table it needs, aggregates); see :func:`register_feature`.
_FEATURES: dict[str, Callable[[], list[Column]]] = {}


def register_feature(name: str, aggregates: Callable[[], list[Column]]) -> None:
    """Add a feature: a function that returns the aggregates, computed with the others in one pass."""
    _FEATURES[name] = aggregates


def size() -> list[Column]:
    return [F.count(F.lit(1)).alias("size")]


def bounding_box() -> list[Column]:
    return [f(c).cast("bigint").alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in KEY]


def centre_of_mass() -> list[Column]:
    return [*[F.sum(F.col(c).cast("bigint")).alias(f"sum_{c}") for c in KEY], F.count(F.lit(1)).alias("volume")]


def semantic_label(code: Column) -> Column:
    """Codes 2, 3, 4, 5 stand for the labels 1, 0, 2, 2; 0 and 1 for none; others are an error."""
    return (
        F.when(code.isNull() | code.isin(0, 1), F.lit(None).cast("int")).when(code == 2, 1).when(code == 3, 0).when(code.isin(4, 5), 2)
        .otherwise(F.raise_error(F.lit("semantic code out of range")).cast("int"))
    )


def semantic_histogram() -> list[Column]:
    return [F.count_if(semantic_label(F.col("sem")) == i).alias(f"n{i}") for i in range(3)]


register_feature("size", size)
register_feature("bbox", bounding_box)
register_feature("com", centre_of_mass)


def features(voxels: DataFrame, *names: str) -> DataFrame:
    """The named features of every segment but 0 in one pass over the voxels."""
    return voxels.where("sid <> 0").groupBy("sid").agg(*[c for n in names for c in _FEATURES[n]()])


def semantics(voxels: DataFrame, remap: DataFrame | None = None) -> DataFrame:
    """``sid, n0, n1, n2`` of segments with at least one labelled voxel."""
    rows = voxels.where("sid <> 0")
    rows = remap_ids(rows, remap, "sid") if remap is not None else rows
    return rows.groupBy("sid").agg(*semantic_histogram()).where("n0 + n1 + n2 > 0")


def sizes_remapped(voxels: DataFrame, remap: DataFrame) -> DataFrame:
    """Sizes counted by old id first, so that the join meets one row for each segment."""
    counts = voxels.where("sid <> 0").groupBy("sid").agg(F.count(F.lit(1)).alias("size"))
    return remap_ids(counts, remap, "sid").groupBy("sid").agg(F.sum("size").alias("size"))


def supervoxel_counts(voxels: DataFrame, chunk: tuple[int, int, int]) -> DataFrame:
    """``sid, n``: one for each chunk that a segment occurs in."""
    place = [F.floor(F.col(c) / n).alias(f"c{c}") for c, n in zip(KEY, chunk)]
    return voxels.where("sid <> 0").select("sid", *place).distinct().groupBy("sid").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(counts: DataFrame) -> DataFrame:
    """Counts of ``sid, n, boundary`` from overlapping parts: the parts share one supervoxel, which counts once.

    Rows of a frozen list have a null ``n``; a segment that only they name counts as 1.
    """
    n = F.coalesce(F.sum("n") - (F.count("n") - 1), F.lit(1)).cast("bigint")
    return counts.groupBy("sid").agg(n.alias("n"), F.bool_or("boundary").alias("boundary"))


def boundary_sets(voxels: DataFrame, extent: tuple[int, int, int], remap: DataFrame | None = None) -> DataFrame:
    """``face, sid``: the segments on each of the six faces of the volume."""
    faces = F.array_compact(F.array(*[F.when(F.col(KEY[k % 3]) == (0 if k < 3 else extent[k % 3] - 1), F.lit(k)) for k in range(6)]))
    rows = voxels.where("sid <> 0").select("sid", F.explode(faces).alias("face")).distinct()
    rows = remap_ids(rows, remap, "sid").distinct() if remap is not None else rows
    return rows.select("face", "sid")


def sparse_counts(voxels: DataFrame, flag: Column, name: str) -> DataFrame:
    """``sid`` and the number of voxels with the flag, where there are any."""
    return voxels.where("sid <> 0").groupBy("sid").agg(F.count_if(flag).alias(name)).where(F.col(name) > 0)


def nucleus_records(voxels: DataFrame, min_tagged: int, num: int, den: int, nuc: str = "nuc") -> DataFrame:
    """``sid, state, id, count, total``: the nucleus that a segment's tagged voxels speak for.

    The most frequent nucleus, the smaller id at ties. Fewer tagged voxels than the floor: NONE with zeros. A share
    of at least num/den: PROPER. Otherwise CONFLICT. The ratio is compared in whole numbers.
    """
    votes = voxels.where((F.col("sid") != 0) & (F.col(nuc) != 0)).groupBy("sid", F.col(nuc).alias("nuc")).agg(F.count(F.lit(1)).alias("n"))
    return records_of_votes(votes, min_tagged, num, den)


def records_of_votes(votes: DataFrame, min_tagged: int, num: int, den: int) -> DataFrame:
    """As :func:`nucleus_records`, from ``sid, nuc, n``."""
    best = votes.groupBy("sid", "nuc").agg(F.sum("n").alias("n")).groupBy("sid").agg(F.sum("n").alias("total"), F.max(F.struct("n", (-F.col("nuc")).alias("neg"))).alias("b"))
    wide = "decimal(20,0)"
    dominant = F.col("b.n").cast(wide) * F.lit(den).cast("decimal(4,0)") >= F.lit(num).cast("decimal(4,0)") * F.col("total").cast(wide)
    state = F.when(F.col("total") < min_tagged, NONE).when(dominant, PROPER).otherwise(CONFLICT)
    rows = best.withColumn("state", state)
    proper = F.col("state") == PROPER
    zero = F.lit(0).cast("bigint")
    return rows.select("sid", "state", F.when(proper, -F.col("b.neg")).otherwise(zero).alias("id"), F.when(proper, F.col("b.n")).otherwise(zero).alias("count"), F.when(F.col("state") == NONE, zero).otherwise(F.col("total")).alias("total"))


def nucleus_counters(votes: DataFrame, min_tagged: int, num: int, den: int) -> DataFrame:
    """Quality counters over ``sid, nuc, n``: conflicting and minority segments, and those below the floor."""
    rec = records_of_votes(votes, min_tagged, num, den)
    totals = votes.groupBy("sid").agg(F.sum("n").alias("tagged"))
    both = rec.join(totals, "sid")
    return both.agg(
        F.count_if(F.col("state") == CONFLICT).alias("conflict_sv"), F.count_if((F.col("state") == PROPER) & (F.col("count") < F.col("total"))).alias("minority_sv"),
        F.count_if(F.col("state") == NONE).alias("subfloor_sv"), F.coalesce(F.sum(F.when(F.col("state") == NONE, F.col("tagged"))), F.lit(0)).alias("subfloor_voxels"),
    )


def join_records(records: DataFrame, key: str = "sid") -> DataFrame:
    """Records of the same key joined: totals add up; one CONFLICT, or two nuclei, make a CONFLICT.

    The operation is commutative and associative, so the order of the rows does not matter.
    """
    proper = F.col("state") == PROPER
    out = records.groupBy(key).agg(
        F.bool_or(F.col("state") == CONFLICT).alias("_c"), F.min(F.when(proper, F.col("id"))).alias("_lo"), F.max(F.when(proper, F.col("id"))).alias("_hi"),
        F.sum(F.when(proper, F.col("count"))).alias("_n"), F.sum("total").alias("total"),
    )
    state = F.when(F.col("_c") | (F.col("_lo") != F.col("_hi")), CONFLICT).when(F.col("_lo").isNull(), NONE).otherwise(PROPER)
    out = out.withColumn("state", state)
    zero = F.lit(0).cast("bigint")
    return out.select(key, "state", F.when(F.col("state") == PROPER, F.col("_lo")).otherwise(zero).alias("id"), F.when(F.col("state") == PROPER, F.col("_n")).otherwise(zero).alias("count"), "total")


def can_merge(state_a: Column, id_a: Column, state_b: Column, id_b: Column) -> Column:
    """Whether two records may end up in one segment.

    Always if one has no nucleus; two PROPER ones if they name the same; a CONFLICT never meets a nucleus.
    """
    return (state_a == NONE) | (state_b == NONE) | ((state_a == PROPER) & (state_b == PROPER) & (id_a == id_b))
