"""Queries of the general table problems: popular keys (p2), tiny files (p3), hierarchies (p5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volseg.operators import compaction, hierarchy, selection
from volseg.storage import Scratch, table

#: Share of a table's rows, in per cent, from which a value counts as popular.
POPULAR_PERCENT = 3
EDGE, COUNT = ["s1", "s2", "aff", "area"], ["sid", "size"]
EDGE_BYTES, COUNT_BYTES = 32, 16


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``field_name, key_value, aff, area``: a row for each of s1, s2 of an edge and for the size of a count."""
    edges = table(spark, sf_dir, "residual_rg")
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("key_value")) for c in ("s1", "s2")])).alias("_side")
    edges = edges.select(sides, "aff", "area").select("_side.field_name", "_side.key_value", "aff", "area")
    counts = table(spark, sf_dir, "ongoing_supervoxel_counts")
    counts = counts.select(F.lit("size").alias("field_name"), F.col("size").alias("key_value"), F.lit(None).cast("double").alias("aff"), F.lit(None).cast("bigint").alias("area"))
    return edges.unionByName(counts)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of s1, s2 or size in at least 3 % of all rows of their table."""
    rows = _keyed(spark, sf_dir).select("field_name", "key_value")
    totals = rows.groupBy("field_name").agg(F.count(F.lit(1)).alias("total"))
    scratch = Scratch(spark, "p2")
    found = selection.frequent_values(rows, "field_name", "key_value", scratch.save(totals), POPULAR_PERCENT, scratch)
    return found.select("field_name", F.col("v").alias("key_value"))


P2_FOUND_SQL = """
WITH k AS (SELECT 's1' AS field_name, s1 AS key_value FROM residual_rg UNION ALL SELECT 's2', s2 FROM residual_rg
           UNION ALL SELECT 'size', size FROM ongoing_supervoxel_counts),
     t AS (SELECT field_name, count(*) AS total FROM k GROUP BY 1)
SELECT field_name, key_value FROM k JOIN t USING (field_name) WHERE key_value IS NOT NULL
GROUP BY field_name, key_value, total HAVING count(*) * 100 >= total * 3"""


def _finite(x: str) -> Column:
    """The value if it is finite, else null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.col(x))


#: Sums of affinities are taken in units of 2**-30, which holds the values of 32-bit floats above 2**-7 exactly.
UNITS = float(1 << 30)


def p2_key_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row count of every value of s1, s2 and size, with the sums of area and of finite aff for s1 and s2.

    The null key is a key of its own. Affinities that are null, NaN or infinite add nothing. They are summed as
    whole multiples of 2**-30, so the sum does not depend on the order of the rows.
    """
    units = F.round(_finite("aff") * UNITS).cast("decimal(28,0)")
    out = selection.keyed_totals(_keyed(spark, sf_dir), ["field_name", "key_value"], {"aff_units": units, "sum_area": F.col("area")})
    return out.select("field_name", "key_value", "n_rows", (F.col("aff_units").cast("double") / UNITS).alias("sum_aff"), "sum_area")


P2_KEY_TOTALS_SQL = """
WITH k AS (SELECT 's1' AS field_name, s1 AS key_value, aff, area FROM residual_rg UNION ALL SELECT 's2', s2, aff, area FROM residual_rg
           UNION ALL SELECT 'size', size, NULL, NULL FROM ongoing_supervoxel_counts)
SELECT field_name, key_value, count(*) AS n_rows,
       CAST(sum(CASE WHEN isfinite(aff) THEN CAST(round(aff * 1073741824.0) AS HUGEINT) END) AS DOUBLE) / 1073741824.0 AS sum_aff,
       CAST(sum(area) AS BIGINT) AS sum_area
FROM k GROUP BY field_name, key_value"""

QUANTILES = (0.5, 0.9)


def p2_key_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower nearest-rank quantiles of the finite aff of every value of s1 and s2.

    Values without a finite aff have no row; the null key is left out.
    """
    scratch = Scratch(spark, "p2q")
    rows = _keyed(spark, sf_dir).where("field_name <> 'size' AND key_value IS NOT NULL").select("field_name", "key_value", _finite("aff").alias("aff")).where("aff IS NOT NULL")
    rows = rows.withColumn("aff", F.col("aff") + F.lit(0.0))
    keys = ["field_name", "key_value"]
    # equal affinities of a key are merged first, as every round reads them
    hist = scratch.save(selection.histogram(rows, keys, "aff"))
    ranges = scratch.save(selection.key_ranges(hist, keys))
    targets = selection.quantile_targets(ranges, keys, list(QUANTILES))
    got = selection.select_ranks(hist, targets, keys, scratch, ranges)
    return got.select(*keys, F.col("target").alias("quantile"), F.col("rank").alias("rank_taken"), F.col("v").alias("aff"))


P2_KEY_QUANTILES_SQL = """
WITH k AS (SELECT 's1' AS field_name, s1 AS key_value, aff FROM residual_rg UNION ALL SELECT 's2', s2, aff FROM residual_rg),
     r AS (SELECT field_name, key_value, aff + 0.0 AS aff, row_number() OVER (PARTITION BY field_name, key_value ORDER BY aff) - 1 AS pos,
                  count(*) OVER (PARTITION BY field_name, key_value) AS n
           FROM k WHERE key_value IS NOT NULL AND isfinite(aff)),
     q AS (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE]) AS quantile)
SELECT field_name, key_value, quantile, pos AS rank_taken, aff FROM r JOIN q ON pos = CAST(floor(quantile * (n - 1)) AS BIGINT)"""


FAMILIES = {"residual_rg": (EDGE, EDGE_BYTES), "ongoing_supervoxel_counts": (COUNT, COUNT_BYTES)}


def _compacted(spark: SparkSession, sf_dir: str, label: str) -> dict[str, compaction.Manifest]:
    """Both families written to few files; the published manifests."""
    frames = [(table(spark, sf_dir, name), *how) for name, how in FAMILIES.items()]
    return dict(zip(FAMILIES, compaction.compact_tables(frames, Scratch(spark, label))))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the compaction leaves out, as its manifests list them: their distinct records all lie in one other,
    larger or earlier, file of the table and chunk."""
    parts = [m.files.where("kept_in IS NOT NULL").select("file_id") for m in _compacted(spark, sf_dir, "p3").values()]
    return reduce(DataFrame.unionByName, parts)


P3_FOUND_SQL = """
WITH r AS (SELECT DISTINCT 'e' AS fam, chunk_tag, file_id, s1 AS a, s2 AS b, aff AS c, area AS d FROM residual_rg
           UNION ALL SELECT DISTINCT 'c', chunk_tag, file_id, sid, size, NULL, NULL FROM ongoing_supervoxel_counts),
     n AS (SELECT file_id, count(*) AS n FROM r GROUP BY 1),
     m AS (SELECT x.file_id, y.file_id AS other, count(*) AS met FROM r x JOIN r y
             ON x.fam = y.fam AND x.chunk_tag IS NOT DISTINCT FROM y.chunk_tag AND x.file_id <> y.file_id
            AND x.a IS NOT DISTINCT FROM y.a AND x.b IS NOT DISTINCT FROM y.b AND x.c IS NOT DISTINCT FROM y.c AND x.d IS NOT DISTINCT FROM y.d
           GROUP BY 1, 2)
SELECT DISTINCT m.file_id FROM m JOIN n a ON a.file_id = m.file_id JOIN n b ON b.file_id = m.other
WHERE met = a.n AND (b.n > a.n OR (b.n = a.n AND m.other < m.file_id))"""


def p3_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifests say, summed by family."""
    parts = [m.groups.select(F.lit(name).alias("family"), "n_records", "group_id") for name, m in _compacted(spark, sf_dir, "p3c").items()]
    out = reduce(DataFrame.unionByName, parts).groupBy("family").agg(F.count(F.lit(1)).alias("n_outputs"), F.sum("n_records").alias("n_records"))
    return out


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records read back from the files written, each with its file and slot; ``kind`` of ``c``: null, NaN or value."""
    out = []
    for name, m in _compacted(spark, sf_dir, "p3r").items():
        a, b, *rest = [F.col(c) for c in FAMILIES[name][0]]
        c, d = rest or (F.lit(None).cast("double"), F.lit(None).cast("bigint"))
        kind = F.when(c.isNull(), "null").when(F.isnan(c), "nan").otherwise("value").alias("kind")
        out.append(m.records().select(F.lit(name).alias("family"), "chunk_tag", "file_id", F.col("slot").cast("bigint").alias("slot"), a.alias("a"), b.alias("b"), kind, F.when(~F.isnan(c), c).alias("c"), d.alias("d")))
    return reduce(DataFrame.unionByName, out)


_P3_KEPT = f"""gone AS ({P3_FOUND_SQL}),
     k AS (SELECT DISTINCT 'residual_rg' AS family, chunk_tag, file_id, slot, s1 AS a, s2 AS b, aff AS c, area AS d FROM residual_rg
           UNION ALL SELECT DISTINCT 'ongoing_supervoxel_counts', chunk_tag, file_id, slot, sid, size, NULL, NULL FROM ongoing_supervoxel_counts),
     r AS (SELECT * FROM k WHERE file_id IS NULL OR file_id NOT IN (SELECT file_id FROM gone))"""

P3_COMPACTED_SQL = f"""
WITH {_P3_KEPT}, t AS (SELECT family, count(*) AS n, count(DISTINCT file_id) AS f, any_value(CASE family WHEN 'residual_rg' THEN 32 ELSE 16 END) AS w FROM r GROUP BY family)
SELECT family, CAST(greatest(32, ceil(ceil(n * w / 134217728.0) / 4) * 4) AS BIGINT) AS n_outputs, n AS n_records FROM t"""

P3_RECORDS_SQL = f"""
WITH {_P3_KEPT} SELECT family, chunk_tag, file_id, CAST(slot AS BIGINT) AS slot, a, b,
  CASE WHEN c IS NULL THEN 'null' WHEN isnan(c) THEN 'nan' ELSE 'value' END AS kind, CASE WHEN NOT isnan(c) THEN c END AS c, d FROM r"""


def p3_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing against the records: files listed, empty ones, and those whose count or size does not fit."""
    listed = table(spark, sf_dir, "slice_files").groupBy("family", "file_id").agg(F.max("n_records").alias("n_records"), F.max("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows"))
    stored = [table(spark, sf_dir, n).groupBy("file_id").agg(F.count_distinct("slot").alias("n")) for n in ("residual_rg", "ongoing_supervoxel_counts")]
    both = listed.join(stored[0].unionByName(stored[1]), "file_id", "left")
    width = F.when(F.col("family") == "residual_rg", EDGE_BYTES).otherwise(COUNT_BYTES)
    held = F.coalesce("n", F.lit(0))
    return both.groupBy("family").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_rows"), F.count_if(F.col("n").isNull()).alias("n_empty"),
        F.count_if(F.col("n_records").isNull() | (F.col("n_records") != held)).alias("n_other_count"),
        F.count_if(F.col("n_bytes").isNull() | (F.col("n_bytes") < held * width)).alias("n_too_short"),
    )


P3_LISTING_SQL = """
WITH l AS (SELECT family, file_id, max(n_records) AS n_records, max(n_bytes) AS n_bytes, count(*) AS n_rows FROM slice_files GROUP BY 1, 2),
     s AS (SELECT file_id, count(DISTINCT slot) AS n FROM residual_rg GROUP BY 1 UNION ALL SELECT file_id, count(DISTINCT slot) FROM ongoing_supervoxel_counts GROUP BY 1)
SELECT family, count(*) AS n_files, CAST(sum(n_rows) AS BIGINT) AS n_rows, count(*) FILTER (WHERE n IS NULL) AS n_empty,
       count(*) FILTER (WHERE n_records IS NULL OR n_records <> coalesce(n, 0)) AS n_other_count,
       count(*) FILTER (WHERE n_bytes IS NULL OR n_bytes < coalesce(n, 0) * (CASE family WHEN 'residual_rg' THEN 32 ELSE 16 END)) AS n_too_short
FROM l LEFT JOIN s USING (file_id) GROUP BY family"""


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    faces = table(spark, sf_dir, "matching_faces")
    return hierarchy.parents(faces, "oid", "nid", "agg_size"), hierarchy.all_ids(faces, "oid", "nid")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topmost ancestor of every segment and the links up to it."""
    out = hierarchy.resolve(*_links(spark, sf_dir), Scratch(spark, "p5"))
    return out.select(F.col("id").alias("seg_id"), F.col("root").alias("root_id"), "n_links")


_P5_UP = """
p AS (SELECT oid AS id, nid AS up FROM (SELECT oid, nid, row_number() OVER (PARTITION BY oid ORDER BY agg_size DESC NULLS LAST, nid) AS rn
        FROM matching_faces WHERE oid <> 0 AND nid <> 0 AND oid <> nid) WHERE rn = 1),
ids AS (SELECT oid AS id FROM matching_faces WHERE oid <> 0 UNION SELECT nid FROM matching_faces WHERE nid <> 0),
tops AS (SELECT id FROM ids WHERE id NOT IN (SELECT id FROM p)),
down AS (SELECT id, id AS root, CAST(0 AS BIGINT) AS n, [id] AS path FROM tops UNION ALL SELECT p.id, d.root, d.n + 1, list_append(d.path, p.id) FROM down d JOIN p ON p.up = d.id)"""

#: The walk from each looped node is followed until it returns; loops in the tables are short.
_P5_LOOPS = """bad AS (SELECT p.id, p.up FROM p WHERE p.id NOT IN (SELECT id FROM down)),
walk AS (SELECT id AS src, id AS pos FROM bad UNION SELECT w.src, b.up FROM walk w JOIN bad b ON b.id = w.pos),
back AS (SELECT b.id AS src, b.up AS pos FROM bad b UNION SELECT w.src, b.up FROM back w JOIN bad b ON b.id = w.pos),
ring AS (SELECT src AS id FROM back WHERE src = pos),
low AS (SELECT r.id, min(w.pos) AS low FROM ring r JOIN walk w ON w.src = r.id GROUP BY 1),
lost AS (SELECT src AS seg_id, min(low) AS root_id, CAST(-1 AS BIGINT) AS n_links FROM walk JOIN low ON low.id = walk.pos GROUP BY src)"""
P5_FOUND_SQL = f"""
WITH RECURSIVE {_P5_UP}, {_P5_LOOPS} SELECT id AS seg_id, root AS root_id, n AS n_links FROM down UNION ALL SELECT * FROM lost"""


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path from the root down, depth and root of every segment; a null path at or below loops."""
    out = hierarchy.resolve(*_links(spark, sf_dir), Scratch(spark, "p5p"), paths=True)
    return out.select(F.col("id").alias("seg_id"), F.col("root").alias("root_id"), "n_links", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


P5_PATHS_SQL = f"""
WITH RECURSIVE {_P5_UP}, {_P5_LOOPS} SELECT id AS seg_id, root AS root_id, n AS n_links, array_to_string(path, '/') AS path FROM down
UNION ALL SELECT *, NULL FROM lost"""


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment below every other segment, with the links between them; those on a loop are above one another."""
    scratch, (links, ids) = Scratch(spark, "p5d"), _links(spark, sf_dir)
    out = hierarchy.resolve(links, ids, scratch, paths=True)
    return hierarchy.descendants(out, hierarchy.cut_loops(links, out, scratch)).select("ancestor", F.col("id").alias("seg_id"), "distance")


P5_DESCENDANTS_SQL = f"""
WITH RECURSIVE {_P5_UP},
pairs AS (SELECT id AS seg_id, n, unnest(path) AS ancestor, unnest(range(len(path))) AS pos FROM down),
bad AS (SELECT p.id, p.up FROM p WHERE p.id NOT IN (SELECT id FROM down)),
climb AS (SELECT id AS src, up AS pos, CAST(1 AS BIGINT) AS far, [id] AS seen FROM bad
          UNION ALL SELECT c.src, b.up, c.far + 1, list_append(c.seen, c.pos) FROM climb c JOIN bad b ON b.id = c.pos WHERE NOT list_contains(c.seen, b.up))
SELECT ancestor, seg_id, CAST(n - pos AS BIGINT) AS distance FROM pairs WHERE pos < n UNION ALL SELECT pos, src, far FROM climb"""

QUERIES = {f.__name__: f for f in (p2_found, p2_key_totals, p2_key_quantiles, p3_found, p3_compacted, p3_records, p3_listing, p5_found, p5_paths, p5_descendants)}
SQL = {
    "p2_found": P2_FOUND_SQL, "p2_key_totals": P2_KEY_TOTALS_SQL, "p2_key_quantiles": P2_KEY_QUANTILES_SQL,
    "p3_found": P3_FOUND_SQL, "p3_compacted": P3_COMPACTED_SQL, "p3_records": P3_RECORDS_SQL, "p3_listing": P3_LISTING_SQL,
    "p5_found": P5_FOUND_SQL, "p5_paths": P5_PATHS_SQL, "p5_descendants": P5_DESCENDANTS_SQL,
}
