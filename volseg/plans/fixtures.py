"""Voxel tables derived from lineitem, in Spark and in SQL, for queries on volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volseg.storage import Scratch, table

#: Chunks of the fixture volume. Its extent is 32 x 32 on x and y; on z it grows with the table, by 16 for each
#: 15,000 rows of lineitem.
CHUNK, ROWS_PER_SLAB = (16, 16, 8), 15_000
_saved: dict[tuple[str, str, str], DataFrame] = {}
_extents: dict[tuple[str, str], tuple[int, int, int]] = {}

EXT_SQL = "ext AS (SELECT CAST(16 * greatest(1, count(*) // 15000) AS INT) AS nz FROM lineitem)"
#: The extent on z, as a scalar.
NZ = "(SELECT nz FROM ext)"
VOXELS_SQL = EXT_SQL + f""", v0 AS (
  SELECT CAST(l_orderkey % 32 AS INT) AS x, CAST(l_partkey % 32 AS INT) AS y, CAST(l_suppkey % {NZ} AS INT) AS z,
         (sum(CAST(l_quantity AS BIGINT) * 7) % 257) / 256.0 AS ax, (sum(CAST(l_quantity AS BIGINT) * 13 + l_linenumber) % 257) / 256.0 AS ay,
         (sum(CAST(l_quantity AS BIGINT) * 29 + 3 * l_linenumber) % 257) / 256.0 AS az,
         max(l_suppkey) % 7 AS nuc, max(CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 3 ELSE 4 END) AS sem
  FROM lineitem GROUP BY 1, 2, 3),
voxel AS (SELECT x, y, z, CAST(ax AS DOUBLE) AS ax, CAST(ay AS DOUBLE) AS ay, CAST(az AS DOUBLE) AS az, CAST(nuc AS BIGINT) AS nuc, sem,
  CAST(CASE WHEN ax < 0.02 THEN 0 ELSE 1 + x // 4 + 8 * ((y + z % 3) // 4) + 100 * (z // 4) END AS BIGINT) AS sid,
  CAST(1 + x // 8 + 4 * (y // 8) + 16 * (z // 8) AS BIGINT) AS gt, CAST(1 + x // 16 + 2 * (y // 16) + 4 * (z // 16) AS BIGINT) AS soma,
  CAST(CASE WHEN x % 8 BETWEEN 2 AND 5 AND y % 8 BETWEEN 2 AND 5 AND z % 8 BETWEEN 2 AND 5 THEN 1 + x // 8 + 4 * (y // 8) + 16 * (z // 8) ELSE 0 END AS BIGINT) AS core FROM v0)"""

CONTACTS_SQL = VOXELS_SQL + """,
contact AS (
  SELECT least(a.sid, b.sid) AS s1, greatest(a.sid, b.sid) AS s2, 0 AS axis, a.x, a.y, a.z, a.ax AS aff FROM voxel a JOIN voxel b ON b.x = a.x - 1 AND b.y = a.y AND b.z = a.z WHERE a.sid <> b.sid AND a.sid <> 0 AND b.sid <> 0
  UNION ALL SELECT least(a.sid, b.sid), greatest(a.sid, b.sid), 1, a.x, a.y, a.z, a.ay FROM voxel a JOIN voxel b ON b.x = a.x AND b.y = a.y - 1 AND b.z = a.z WHERE a.sid <> b.sid AND a.sid <> 0 AND b.sid <> 0
  UNION ALL SELECT least(a.sid, b.sid), greatest(a.sid, b.sid), 2, a.x, a.y, a.z, a.az FROM voxel a JOIN voxel b ON b.x = a.x AND b.y = a.y AND b.z = a.z - 1 WHERE a.sid <> b.sid AND a.sid <> 0 AND b.sid <> 0),
rag AS (SELECT s1, s2, sum(aff) AS sum_aff, count(*) AS area FROM contact GROUP BY 1, 2)"""


def saved(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A derived table written once for each session and input, since a plan used twice is computed twice."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _saved:
        _saved[key] = Scratch(spark, f"fixture-{name}").save(make())
    return _saved[key]


def side_by_side(*frames: DataFrame) -> DataFrame:
    """Frames of one row each as one row."""
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f, allowMissingColumns=True)
    return whole.agg(*[F.max(c).alias(c) for c in whole.columns])


def extent(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    """The fixture volume's extent."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _extents:
        _extents[key] = (32, 32, 16 * max(1, table(spark, sf_dir, "lineitem").count() // ROWS_PER_SLAB))
    return _extents[key]


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``x, y, z, ax, ay, az, nuc, sem, sid, gt, soma, core``: affinities are multiples of 1/256, so sums are exact;
    ``soma`` are larger segments, each with up to eight nuclei, whose small ``core`` is tagged."""

    def make() -> DataFrame:
        qty = F.col("l_quantity").cast("bigint")
        line = table(spark, sf_dir, "lineitem")
        nz = extent(spark, sf_dir)[2]
        part = [((line[k] % n).cast("int")).alias(a) for k, n, a in (("l_orderkey", 32, "x"), ("l_partkey", 32, "y"), ("l_suppkey", nz, "z"))]
        v = line.groupBy(*part).agg(
            ((F.sum(qty * 7) % 257) / 256.0).alias("ax"), ((F.sum(qty * 13 + F.col("l_linenumber")) % 257) / 256.0).alias("ay"),
            ((F.sum(qty * 29 + 3 * F.col("l_linenumber")) % 257) / 256.0).alias("az"), (F.max("l_suppkey") % 7).alias("nuc"),
            F.max(F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "N", 3).otherwise(4)).alias("sem"),
        )
        x, y, z = F.col("x"), F.col("y"), F.col("z")
        sid = 1 + F.floor(x / 4) + 8 * F.floor((y + z % 3) / 4) + 100 * F.floor(z / 4)
        gt = (1 + F.floor(x / 8) + 4 * F.floor(y / 8) + 16 * F.floor(z / 8)).cast("bigint")
        soma = 1 + F.floor(x / 16) + 2 * F.floor(y / 16) + 4 * F.floor(z / 16)
        inside = F.lit(True)
        for c in (x, y, z):
            inside = inside & (c % 8).between(2, 5)
        return v.select(
            "*", F.when(F.col("ax") < 0.02, 0).otherwise(sid).cast("bigint").alias("sid"), gt.alias("gt"), soma.cast("bigint").alias("soma"),
            F.when(inside, gt).otherwise(0).cast("bigint").alias("core"),
        )

    return saved(spark, sf_dir, "voxels", make)
