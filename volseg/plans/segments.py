"""Queries of the graph, agglomeration, contact and nucleus operators over the fixture volume."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volseg.config import Agglomeration, Watershed
from volseg.operators import agglomeration, contact_surface, features, graph, nucleus, rag, remap, watershed
from volseg.plans.fixtures import CHUNK, NZ, extent, saved, side_by_side, voxels
from volseg.plans.volume import _BITS_SQL as BITS_SQL
from volseg.plans.volume import C, V, contacts, grid_of, nuclei, regions
from volseg.storage import Scratch, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Mean affinity above which the fixture's segments are merged.
THRESHOLD = 0.5390625
PARAMETERS = replace(Agglomeration(), threshold=THRESHOLD)


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def reach(edges: str, name: str = "cc") -> str:
    """Recursive SQL: ``id, cc`` with the least id reached over ``edges`` (a table of s1, s2)."""
    return f"""{name}_e AS (SELECT s1 AS a, s2 AS b FROM {edges} UNION SELECT s2, s1 FROM {edges}),
{name}_r AS (SELECT a AS src, a AS id FROM {name}_e UNION SELECT r.src, e.b FROM {name}_r r JOIN {name}_e e ON e.a = r.id),
{name} AS (SELECT id, min(src) AS cc FROM {name}_r GROUP BY id)"""


CR, VR = C.replace("WITH ", "WITH RECURSIVE ", 1), V.replace("WITH ", "WITH RECURSIVE ", 1)
STRONG_SQL = f"strong AS (SELECT s1, s2 FROM rag WHERE sum_aff > area * {THRESHOLD})"


def strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir).where(F.col("sum_aff") > F.col("area") * THRESHOLD)


@query(f"{CR}, {STRONG_SQL}, {reach('strong')} SELECT * FROM cc")
def components_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the edges whose mean is above the threshold."""
    return graph.component_labels(strong(spark, sf_dir), Scratch(spark, "cc"))


@query(f"{CR}, {STRONG_SQL}, {reach('strong')} SELECT cc, count(*) AS n FROM cc GROUP BY cc HAVING count(*) > 1")
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of more than one segment."""
    return graph.component_labels(strong(spark, sf_dir), Scratch(spark, "cc")).groupBy("cc").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query(f"{CR}, {STRONG_SQL}, {reach('strong')} SELECT a.cc, rag.s1, rag.s2, sum_aff, area FROM rag JOIN cc a ON a.id = s1 JOIN cc b ON b.id = s2 WHERE a.cc = b.cc")
def component_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges inside each component."""
    cc = Scratch(spark, "cc").save(graph.component_labels(strong(spark, sf_dir), Scratch(spark, "cc")))
    e = regions(spark, sf_dir).join(cc.select(F.col("id").alias("s1"), F.col("cc").alias("c1")), "s1").join(cc.select(F.col("id").alias("s2"), F.col("cc").alias("c2")), "s2")
    return e.where("c1 = c2").select(F.col("c1").alias("cc"), "s1", "s2", "sum_aff", "area")


@query(f"WITH RECURSIVE pairs AS (SELECT os AS s1, ns AS s2 FROM extra_remaps WHERE os <> 0 AND ns <> 0), {reach('pairs')} SELECT id AS old, cc AS new FROM cc")
def remap_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extra remaps resolved to the least id of each group."""
    pairs = table(spark, sf_dir, "extra_remaps").where("os <> 0 AND ns <> 0").select(F.col("os").alias("old"), F.col("ns").alias("new"))
    return remap.closure(pairs, Scratch(spark, "closure"))


@query()
def agglomerate_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments merged by mean affinity, resolved to least member ids."""
    return agglomeration.resolved(_events(spark, sf_dir), Scratch(spark, "agg"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        e = regions(spark, sf_dir)
        return agglomeration.agglomerate(e, agglomeration.nodes_of(e), PARAMETERS, Scratch(spark, "agg"))

    return saved(spark, sf_dir, "agglomeration", make)


@query(f"{C} SELECT CAST(0 AS BIGINT) AS apart, CAST(0 AS BIGINT) AS above, CAST(sum(area) AS BIGINT) AS area, sum(sum_aff) AS sum_aff FROM rag")
def agglomerate_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged segments that lie in different components of strong edges (none); remaining edges between segments whose
    mean is still above the threshold (none); and the contact area and affinity inside and between segments together."""
    edges = regions(spark, sf_dir)
    scratch = Scratch(spark, "inv")
    new = scratch.save(agglomeration.resolved(_events(spark, sf_dir), scratch))
    cc = graph.component_labels(strong(spark, sf_dir), scratch)
    apart = new.join(cc.select(F.col("id").alias("old"), F.col("cc").alias("c1")), "old", "left").join(cc.select(F.col("id").alias("new"), F.col("cc").alias("c2")), "new", "left").where("c1 <> c2 OR c1 IS NULL OR c2 IS NULL")
    left = rag.remap_edges(edges, new)
    above = left.where(F.col("sum_aff") > F.col("area") * THRESHOLD)
    inner = rag.remap_ids(edges, new, "s1", "s2").where("s1 = s2").agg(F.coalesce(F.sum("area"), F.lit(0)).alias("a"), F.coalesce(F.sum("sum_aff"), F.lit(0.0)).alias("f"))
    parts = [
        apart.agg(F.count(F.lit(1)).alias("apart")).selectExpr("apart", "0L AS above", "0L AS area", "0D AS sum_aff"), above.agg(F.count(F.lit(1)).alias("above")).selectExpr("0L AS apart", "above", "0L AS area", "0D AS sum_aff"),
        inner.selectExpr("0L AS apart", "0L AS above", "a AS area", "f AS sum_aff"), left.agg(F.sum("area").alias("a"), F.sum("sum_aff").alias("f")).selectExpr("0L AS apart", "0L AS above", "a AS area", "f AS sum_aff"),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.agg(*[F.sum(c).alias(c) for c in ("apart", "above", "area", "sum_aff")])


def _frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels(spark, sf_dir).where("x = 0 AND sid <> 0").select("sid").distinct()


@query(f"""{C}, ends AS (SELECT s1 AS sid FROM rag UNION SELECT s2 FROM rag)
SELECT sid, count(DISTINCT (x // 16, y // 16, z // 8)) AS supervoxels, count(*) AS size, bool_or(x = 0) AS frozen, count(*) FILTER (WHERE sem = 3) AS n0, count(*) FILTER (WHERE sem = 2) AS n1, count(*) FILTER (WHERE sem IN (4, 5)) AS n2
FROM voxel JOIN ends USING (sid) GROUP BY sid""")
def agg_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What agglomeration knows of every segment that touches another; the sizes come in two parts, which add up."""
    v = voxels(spark, sf_dir).where("sid <> 0")
    sizes = v.groupBy("sid", F.col("z") % 2).agg(F.count(F.lit(1)).alias("size"))
    nodes = agglomeration.nodes_of(regions(spark, sf_dir), sizes, features.supervoxel_counts(v, CHUNK), features.semantics(v), None, _frozen(spark, sf_dir))
    return nodes.select("sid", "supervoxels", "size", "frozen", "n0", "n1", "n2")


def _frozen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        e = regions(spark, sf_dir)
        nodes = agglomeration.nodes_of(e, nuclei=nuclei(spark, sf_dir), frozen=_frozen(spark, sf_dir))
        return agglomeration.agglomerate(e, nodes, PARAMETERS, Scratch(spark, "aggf"), most=500)

    return saved(spark, sf_dir, "frozen-events", make)


@query()
def agglomerate_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agglomeration with nuclei and with the segments at the volume's low x face frozen: all events."""
    return _frozen_events(spark, sf_dir)


@query(f"{C} SELECT CAST(sum(area) AS BIGINT) AS area, sum(sum_aff) AS sum_aff, CAST(0 AS BIGINT) AS n_mixed, CAST(0 AS BIGINT) AS n_thawed FROM rag")
def agglomerate_vetoes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact area and affinity inside merged segments and of all edges set aside, together; merged segments of several
    nuclei or of a conflict and a nucleus (none); frozen segments that were merged (none)."""
    events, edges = _frozen_events(spark, sf_dir), regions(spark, sf_dir)
    scratch = Scratch(spark, "veto")
    new = scratch.save(agglomeration.resolved(events, scratch))
    inner = rag.remap_ids(edges, new, "s1", "s2").where("s1 = s2").select("sum_aff", "area")
    aside = events.where("kind NOT IN ('remap', 'twig')").select("sum_aff", "area")
    whole = inner.unionByName(aside).agg(F.sum("area").alias("area"), F.sum("sum_aff").alias("sum_aff"))
    tags = rag.remap_ids(nuclei(spark, sf_dir).where("state <> 0").select("sid", "state", "id", F.lit(1).alias("one")), new, "sid")
    mixed = tags.groupBy("sid").agg(F.count_distinct(F.when(F.col("state") == 1, F.col("id"))).alias("k"), F.count_if(F.col("state") == 2).alias("c")).where("k > 1 OR c > 1 OR (k > 0 AND c > 0)")
    thawed = new.join(_frozen(spark, sf_dir), F.col("old") == F.col("sid"), "left_semi")
    return side_by_side(whole, mixed.agg(F.count(F.lit(1)).alias("n_mixed")), thawed.agg(F.count(F.lit(1)).alias("n_thawed")))


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same agglomeration in stages that no component of more than 400 edges gets through in one piece."""

    def make() -> DataFrame:
        e = regions(spark, sf_dir)
        return agglomeration.agglomerate(e, agglomeration.nodes_of(e), PARAMETERS, Scratch(spark, "aggs"), by_degree=False, most=400)

    return saved(spark, sf_dir, "staged", make)


@query()
def agglomerate_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agglomeration at falling thresholds; the same partition as in one run."""
    return agglomeration.resolved(_staged(spark, sf_dir), Scratch(spark, "aggs"))


@query("SELECT CAST(0 AS BIGINT) AS n_apart, CAST(0 AS BIGINT) AS n_unknown")
def agglomerate_staged_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that one run and the run in stages put into different groups, or that only one of them merges (none)."""
    e, scratch = regions(spark, sf_dir), Scratch(spark, "same")
    alone = scratch.save(agglomeration.resolved(agglomeration.agglomerate(e, agglomeration.nodes_of(e), PARAMETERS, scratch, by_degree=False), scratch))
    staged = scratch.save(agglomeration.resolved(_staged(spark, sf_dir), scratch))
    both = alone.join(staged.withColumnRenamed("new", "staged"), "old", "full")
    return both.agg(F.count_if(F.col("new") != F.col("staged")).alias("n_apart"), F.count_if(F.col("new").isNull() | F.col("staged").isNull()).alias("n_unknown"))


@query()
def segment_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of merged segments, done or ongoing by the volume's high z face."""
    v = voxels(spark, sf_dir).where("sid <> 0")
    sizes = v.groupBy("sid").agg(F.count(F.lit(1)).alias("size"))
    new = agglomeration.resolved(_events(spark, sf_dir), Scratch(spark, "routes"))
    return agglomeration.done_and_ongoing(sizes, new, v.where(f"z = {extent(spark, sf_dir)[2] - 1}").select("sid"))


@query(f"{C} SELECT count(DISTINCT s) - 1 AS n_edges FROM (SELECT s1 AS s FROM rag UNION SELECT s2 FROM rag)")
def forest_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the maximum spanning forest of the region graph, which is connected."""
    scored = regions(spark, sf_dir).select((F.col("sum_aff") / F.col("area")).alias("score"), "s1", "s2")
    return graph.spanning_forest(scored, Scratch(spark, "forest")).agg(F.count(F.lit(1)).alias("n_edges"))


@query()
def spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximum spanning forest of the region graph by mean affinity."""
    scored = regions(spark, sf_dir).select((F.col("sum_aff") / F.col("area")).alias("score"), "s1", "s2")
    return graph.spanning_forest(scored, Scratch(spark, "forest"))


@query(f"""{C}, e AS (SELECT s1, s2, sum_aff / area AS score FROM rag), b AS (SELECT s1 AS sid, s1, s2, score FROM e UNION ALL SELECT s2, s1, s2, score FROM e)
SELECT sid, s1, s2, score FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY score DESC, s1, s2) AS rn FROM b) WHERE rn = 1""")
def forest_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best edge of every segment in the maximum spanning forest; it is its best edge of all."""
    kept = spanning_forest(spark, sf_dir).withColumn("key", F.struct("score", F.bitwise_not("s1"), F.bitwise_not("s2")))
    ends = kept.select(F.explode(F.array("s1", "s2")).alias("sid"), "s1", "s2", "score", "key")
    return ends.groupBy("sid").agg(F.max_by(F.struct("s1", "s2", "score"), "key").alias("e")).select("sid", "e.s1", "e.s2", "e.score")


def _basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved(spark, sf_dir, "basins", lambda: watershed.basins(voxels(spark, sf_dir), CHUNK, 0.25, 0.97))


@query(f"SELECT count(*) AS n_voxels, count(*) FILTER (WHERE bits = 0) AS n_background, CAST(0 AS BIGINT) AS n_adrift FROM ({BITS_SQL.replace('0.9 ', '0.97 ')})")
def ws_basins_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels and those without a basin; voxels in another basin than all the voxels that they drain to (none)."""
    b = saved(spark, sf_dir, "basin-bits", lambda: _basins(spark, sf_dir).select("x", "y", "z", "sid", "bits"))
    steps = F.array(*[F.struct(F.lit(k % 3).alias("axis"), F.lit(-1 if k < 3 else 1).alias("by"), F.lit(1 << k).alias("bit")) for k in range(6)])
    looks = b.where("sid <> 0").select("x", "y", "z", "sid", "bits", F.explode(steps).alias("s")).where("bits & s.bit <> 0")
    to = [(F.col(c) + F.when(F.col("s.axis") == i, F.col("s.by")).otherwise(0)).alias(f"n{c}") for i, c in enumerate("xyz")]
    out_of_block = F.lit(False)
    for c, n in zip("xyz", CHUNK):
        out_of_block = out_of_block | (F.floor(F.col(c) / n) != F.floor(F.col(f"n{c}") / n))
    met = looks.select("x", "y", "z", "sid", *to).join(b.select(*[F.col(c).alias(f"n{c}") for c in "xyz"], F.col("sid").alias("other")), ["nx", "ny", "nz"])
    fine = met.groupBy("x", "y", "z").agg(F.max((F.col("sid") == F.col("other")) | out_of_block).alias("fine"))
    return side_by_side(b.agg(F.count(F.lit(1)).alias("n_voxels"), F.count_if(F.col("sid") == 0).alias("n_background")), fine.agg(F.count_if(~F.col("fine")).alias("n_adrift")))


@query(f"{V} SELECT count(*) AS n_voxels, CAST(0 AS BIGINT) AS n_cut, CAST(0 AS BIGINT) AS n_joined FROM voxel")
def ws_stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basins of all blocks stitched, against those of the volume as one block: basins that stitching leaves cut, and
    groups that it makes of several (none). Affinities are told apart by place, since equal ones leave a choice."""
    e = extent(spark, sf_dir)
    scratch = Scratch(spark, "stitched")
    place = (F.col("x") * e[1] + F.col("y")) * e[2] + F.col("z")
    aff = [((F.col(a) * 256 + (place * 3 + i) / float(3 * e[0] * e[1] * e[2])) / 257).alias(a) for i, a in enumerate(("ax", "ay", "az"))]
    v = scratch.save(voxels(spark, sf_dir).select("x", "y", "z", *aff))
    p = replace(Watershed(), high=0.97, low=0.25, size=0, dust=0)
    labels = scratch.save(v.join(watershed.basins(v, CHUNK, p.low, p.high), ["x", "y", "z"]))
    parts = rag.scored(rag.contacts(watershed.inside(labels, CHUNK), chunk=CHUNK), "max")
    level = watershed.stitch(watershed.face_planes(labels, CHUNK, "bits"), parts, watershed.sizes_and_border(labels, e, e), p, scratch)
    whole = watershed.basins(v, e, p.low, p.high).select("x", "y", "z", F.col("sid").alias("one"))
    pairs = rag.remap_ids(labels.select("x", "y", "z", "sid"), level.remap, "sid").join(whole, ["x", "y", "z"])
    met = scratch.save(pairs.groupBy("sid", "one").agg(F.count(F.lit(1)).alias("n")))
    cut = met.groupBy("one").agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_cut"))
    joined = met.groupBy("sid").agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") > 1).alias("n_joined"))
    return side_by_side(met.agg(F.sum("n").alias("n_voxels")), cut, joined)


@query()
def ws_basins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watershed basins of every block."""
    return _basins(spark, sf_dir).select("x", "y", "z", "sid")


def _basin_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    labels = voxels(spark, sf_dir).drop("sid").join(_basins(spark, sf_dir).drop("bits"), ["x", "y", "z"])
    g = saved(spark, sf_dir, "basin-graph", lambda: rag.scored(rag.contacts(labels, chunk=CHUNK), "max"))
    return g, saved(spark, sf_dir, "basin-sizes", lambda: watershed.sizes_and_border(_basins(spark, sf_dir), CHUNK, extent(spark, sf_dir)))


@query()
def ws_merge_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small basins merged along falling scores, dust dropped, and the spanning forest of the rest."""
    return watershed.merge_segments(*_basin_graph(spark, sf_dir), 20, 3, 0.3, Scratch(spark, "wsm"))


@query()
def ws_merge_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same basins merged at two settings."""
    return watershed.merge_segments_at(*_basin_graph(spark, sf_dir), [(10, 2, 0.5), (20, 3, 0.3)], Scratch(spark, "wst"))


_SEAM_SQL = f"""f AS (SELECT o.sid AS sid_o, i.sid AS sid_i, i.ax AS aff FROM voxel i JOIN voxel o ON o.x = i.x - 1 AND o.y = i.y AND o.z = i.z WHERE i.x % 16 = 0 AND i.x > 0
UNION ALL SELECT o.sid, i.sid, i.ay FROM voxel i JOIN voxel o ON o.x = i.x AND o.y = i.y - 1 AND o.z = i.z WHERE i.y % 16 = 0 AND i.y > 0
UNION ALL SELECT o.sid, i.sid, i.az FROM voxel i JOIN voxel o ON o.x = i.x AND o.y = i.y AND o.z = i.z - 1 WHERE i.z % 8 = 0 AND i.z > 0),
same AS (SELECT least(sid_o, sid_i) AS s1, greatest(sid_o, sid_i) AS s2 FROM f WHERE sid_o <> 0 AND sid_i <> 0 GROUP BY 1, 2 HAVING max(aff) >= 0.9)"""


@query(f"{VR}, {_SEAM_SQL}, {reach('same')} SELECT id AS old, cc AS new FROM cc")
def stitch_plateaus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that are one across block faces."""
    classes = watershed.classify_faces(watershed.face_planes(voxels(spark, sf_dir), CHUNK), 0.9)
    return watershed.stitch_plateaus(classes, Scratch(spark, "stitch"))


@query()
def stitch_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments cut by a face joined along their steepest descent."""
    faces = watershed.face_planes(voxels(spark, sf_dir), CHUNK)
    best = faces.select(F.explode(F.array("sid_i", "sid_o")).alias("sid"), "aff").where("sid <> 0").groupBy("sid").agg(F.max("aff").alias("descent"))
    return watershed.stitch_descents(watershed.classify_faces(faces, 2.0), best, 0.25, Scratch(spark, "descent"))


@query("""WITH RECURSIVE pairs AS (SELECT oid AS s1, nid AS s2 FROM matching_faces WHERE oid <> 0 AND nid <> 0), """ + reach("pairs") + " SELECT count(*) AS n_ids, count(DISTINCT cc) AS n_groups, CAST(0 AS BIGINT) AS n_cuts FROM cc")
def match_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches without nuclei: ids, groups, and pairs cut (none)."""
    out = agglomeration.match(table(spark, sf_dir, "matching_faces"), None, Scratch(spark, "match"))
    remaps = F.col("kind") == "remap"
    return out.agg(F.count_if(remaps).alias("n_ids"), F.count_distinct(F.when(remaps, F.col("b"))).alias("n_groups"), F.count_if(~remaps).alias("n_cuts"))


def _made_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nucleus of three for every seventh segment of the matches."""
    some = table(spark, sf_dir, "matching_faces").select(F.explode(F.array("oid", "nid")).alias("sid")).where("sid <> 0 AND sid % 7 = 0").distinct()
    return some.select("sid", F.lit(1).alias("state"), (1 + F.pmod(F.col("sid"), F.lit(3))).alias("id"), F.lit(60).cast("bigint").alias("count"), F.lit(60).cast("bigint").alias("total"))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved(spark, sf_dir, "matched", lambda: agglomeration.match(table(spark, sf_dir, "matching_faces"), _made_up(spark, sf_dir), Scratch(spark, "match")))


@query()
def match_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with made-up nuclei that forbid some."""
    return _matched(spark, sf_dir)


@query("""WITH RECURSIVE pairs AS (SELECT DISTINCT oid AS s1, nid AS s2 FROM matching_faces WHERE oid <> 0 AND nid <> 0), """ + reach("pairs") + """
SELECT (SELECT count(*) FROM cc) AS n_ids, count(*) AS n_pairs, CAST(0 AS BIGINT) AS n_mixed, CAST(0 AS BIGINT) AS n_cut_inside, CAST(0 AS BIGINT) AS n_apart, CAST(0 AS BIGINT) AS n_needless FROM pairs""")
def match_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and pairs of the matches; groups of several nuclei, cuts inside a group, pairs in two groups that are not cut,
    and cuts between groups of which one has no nucleus or both the same (none of these)."""
    out = _matched(spark, sf_dir)
    to = out.where("kind = 'remap'").select(F.col("a").alias("id"), F.col("b").alias("g"))
    tags = _made_up(spark, sf_dir).select(F.col("sid").alias("id"), F.col("id").alias("nucleus")).join(to, "id")
    kinds = tags.groupBy("g").agg(F.count_distinct("nucleus").alias("k"), F.min("nucleus").alias("nucleus"))
    rows = table(spark, sf_dir, "matching_faces").where("oid <> 0 AND nid <> 0").select("oid", "nid").distinct()
    cuts = out.where("kind = 'cut'").select(F.col("a").alias("oid"), F.col("b").alias("nid"), F.lit(True).alias("cut"))
    ends = rows.join(cuts, ["oid", "nid"], "left").join(to.select(F.col("id").alias("oid"), F.col("g").alias("g1")), "oid").join(to.select(F.col("id").alias("nid"), F.col("g").alias("g2")), "nid")
    for i in (1, 2):
        ends = ends.join(kinds.select(F.col("g").alias(f"g{i}"), F.col("nucleus").alias(f"k{i}")), f"g{i}", "left")
    cut, apart = F.col("cut").isNotNull(), F.col("g1") != F.col("g2")
    pairs = ends.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(cut & ~apart).alias("n_cut_inside"), F.count_if(~cut & apart).alias("n_apart"),
        F.count_if(cut & (F.col("k1").isNull() | F.col("k2").isNull() | (F.col("k1") == F.col("k2")))).alias("n_needless"),
    )
    return side_by_side(pairs, to.agg(F.count(F.lit(1)).alias("n_ids")), kinds.agg(F.count_if(F.col("k") > 1).alias("n_mixed")))


# contact surfaces
BAND_SQL = "cv AS (SELECT s1, s2, x, y, z, bit_or(1 << axis) AS axes FROM contact WHERE aff > 0.25 AND aff < 0.75 GROUP BY 1, 2, 3, 4, 5)"
PATCH_SQL = f"""{BAND_SQL}, pn AS (SELECT s1, s2, x, y, z, axes, (x::BIGINT << 42) + (y::BIGINT << 21) + z AS k FROM cv),
pe AS (SELECT a.s1, a.s2, a.k AS a, b.k AS b FROM pn a JOIN pn b ON a.s1 = b.s1 AND a.s2 = b.s2 AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1),
pr AS (SELECT s1, s2, k AS src, k FROM pn UNION SELECT r.s1, r.s2, r.src, e.b FROM pr r JOIN pe e ON e.s1 = r.s1 AND e.s2 = r.s2 AND e.a = r.k),
pl AS (SELECT s1, s2, k, min(src) AS patch FROM pr GROUP BY 1, 2, 3),
summary AS (SELECT pn.s1, pn.s2, patch, count(*) AS n, sum(x)::BIGINT AS sum_x, sum(y)::BIGINT AS sum_y, sum(z)::BIGINT AS sum_z, count(*) FILTER (WHERE axes & 1 <> 0) AS size_x, count(*) FILTER (WHERE axes & 2 <> 0) AS size_y, count(*) FILTER (WHERE axes & 4 <> 0) AS size_z,
min(x)::BIGINT AS min_x, min(y)::BIGINT AS min_y, min(z)::BIGINT AS min_z, max(x)::BIGINT AS max_x, max(y)::BIGINT AS max_y, max(z)::BIGINT AS max_z FROM pn JOIN pl ON pn.s1 = pl.s1 AND pn.s2 = pl.s2 AND pn.k = pl.k GROUP BY 1, 2, 3)"""


@query(f"{C}, {BAND_SQL} SELECT s1, s2, x, y, z, CAST(axes AS INT) AS axes FROM cv")
def contact_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of contacts within an affinity band, with their axes."""
    return contact_surface.contact_voxels(contacts(spark, sf_dir), 0.25, 0.75)


@query(f"{CR}, {PATCH_SQL} SELECT * FROM summary")
def contact_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected patches of every contact with their summaries."""
    return contact_surface.summaries(contact_surface.patches(contact_surface.contact_voxels(contacts(spark, sf_dir), 0.25, 0.75)))


@query(f"{CR}, {PATCH_SQL} SELECT * FROM summary")
def contact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches found block by block and joined over faces: the same as those of the whole volume."""
    cv = contact_surface.contact_voxels(contacts(spark, sf_dir), 0.25, 0.75)
    block = F.floor(F.col("z") / 8) * 4 + F.floor(F.col("x") / 16) * 2 + F.floor(F.col("y") / 16)
    # a pair's voxels in different blocks are labelled apart by moving each block far away
    moved = cv.withColumn("_b", block).withColumn("x", (F.col("x") + F.col("_b") * 1000).cast("int"))
    labelled = contact_surface.patches(moved.drop("_b"))
    back = labelled.withColumn("_b", F.floor(F.col("x") / 1000)).withColumn("x", (F.col("x") - F.col("_b") * 1000).cast("int"))
    parts = back.withColumn("patch", F.col("patch") - F.shiftleft((F.col("_b") * 1000).cast("bigint"), 42)).drop("_b")
    return contact_surface.summaries(contact_surface.merge_over_faces(parts, CHUNK, Scratch(spark, "cm")))


@query(f"{CR}, {PATCH_SQL} SELECT *, (min_x <= 0 OR max_z >= {NZ} - 1) AS incomplete FROM summary")
def contact_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches that reach a face beyond which the volume goes on."""
    return contact_surface.touches_face(contact_patches(spark, sf_dir), (0, 0, 0), tuple(e - 1 for e in extent(spark, sf_dir)), (True, False, False, False, False, True))


@query()
def reweighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reweighted local mean affinity of every pair."""
    return contact_surface.reweighted(contacts(spark, sf_dir))


# nuclei: the larger segments of the fixture, with the nuclei whose cores lie in them
SOMA_SQL = "soma AS (SELECT x, y, z, ax, ay, az, soma AS sid, core AS nuc FROM voxel)"
GEO_SQL = "geo AS (SELECT nuc, count(*) AS n, sum(x)::BIGINT AS sum_x, sum(y)::BIGINT AS sum_y, sum(z)::BIGINT AS sum_z, min(x)::BIGINT AS x0, min(y)::BIGINT AS y0, min(z)::BIGINT AS z0, max(x)::BIGINT + 1 AS x1, max(y)::BIGINT + 1 AS y1, max(z)::BIGINT + 1 AS z1 FROM soma WHERE nuc <> 0 GROUP BY nuc)"
HIST_SQL = f"""coarse AS (SELECT x, y, z, nuc FROM voxel WHERE x < 16 AND y < 16 AND z < {NZ} // 2 AND nuc <> 0),
hist AS (SELECT v.sid, c.nuc, count(*) AS n FROM voxel v JOIN coarse c ON c.x = least((v.x + 1) // 2, 15) AND c.y = least((v.y + 1) // 2, 15) AND c.z = least((v.z + 1) // 2, {NZ} // 2 - 1) WHERE v.sid <> 0 GROUP BY 1, 2)"""
TARGETS_SQL = f"""{SOMA_SQL}, votes AS (SELECT sid, nuc, count(*) AS n FROM soma WHERE nuc <> 0 GROUP BY 1, 2), tot AS (SELECT sid, CAST(sum(n) AS BIGINT) AS total FROM votes GROUP BY sid),
q0 AS (SELECT votes.sid, nuc, n, total FROM votes JOIN tot ON tot.sid = votes.sid WHERE n >= total * 0.05), q AS (SELECT * FROM q0 WHERE sid IN (SELECT sid FROM q0 GROUP BY sid HAVING count(*) >= 2))"""
SPHERE_SQL = f"{GEO_SQL}, sphere AS (SELECT nuc, (sum_x / n + 0.5) * 0.5 AS ux, (sum_y / n + 0.5) * 0.5 AS uy, (sum_z / n + 0.5) * 1.0 AS uz, cbrt(n * 0.25 * 0.75 / pi()) AS radius FROM geo)"
GAPS_SQL = """gaps AS (SELECT a.sid, a.nuc AS n1, b.nuc AS n2, sqrt((s.ux - t.ux) * (s.ux - t.ux) + (s.uy - t.uy) * (s.uy - t.uy) + (s.uz - t.uz) * (s.uz - t.uz)) - s.radius - t.radius AS gap
FROM q a JOIN q b ON a.sid = b.sid AND a.nuc < b.nuc JOIN sphere s ON s.nuc = a.nuc JOIN sphere t ON t.nuc = b.nuc)"""
UNIT_UM = (0.5, 0.5, 1.0)
#: Nuclei side by side nearly touch, those above one another do not.
CONTACT_UM, MARGIN = 3.0, (2, 2, 1)


def _somas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels(spark, sf_dir).select("x", "y", "z", "ax", "ay", "az", F.col("soma").alias("sid"), F.col("core").alias("nuc"))


def _hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, half = voxels(spark, sf_dir), extent(spark, sf_dir)[2] // 2
    return nucleus.histogram(v, v.where(f"x < 16 AND y < 16 AND z < {half}").select("x", "y", "z", "nuc"), (2, 2, 2), (16, 16, half))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        v = _somas(spark, sf_dir)
        return nucleus.targets(nucleus.histogram(v, v.select("x", "y", "z", "nuc"), (1, 1, 1), extent(spark, sf_dir)), 0.05)

    return saved(spark, sf_dir, "targets", make)


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nucleus.pair_gaps(_targets(spark, sf_dir), nucleus.sphere(nucleus.geometry(_somas(spark, sf_dir)), UNIT_UM))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved(spark, sf_dir, "groups", lambda: nucleus.contact_groups(_targets(spark, sf_dir), _gaps(spark, sf_dir), CONTACT_UM, Scratch(spark, "units")))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved(spark, sf_dir, "boxes", lambda: nucleus.unit_boxes(_groups(spark, sf_dir), nucleus.geometry(_somas(spark, sf_dir)), MARGIN, extent(spark, sf_dir)))


@query(f"{V}, {SOMA_SQL}, {GEO_SQL} SELECT * FROM geo")
def nuc_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume, coordinate sums and box of every nucleus."""
    return nucleus.geometry(_somas(spark, sf_dir))


@query(f"{V}, {SOMA_SQL}, {SPHERE_SQL} SELECT nuc, round(ux, 9) AS ux, round(uy, 9) AS uy, round(uz, 9) AS uz, round(radius, 9) AS radius FROM sphere")
def nuc_spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical centre and equivalent radius, to nine decimals."""
    s = nucleus.sphere(nucleus.geometry(_somas(spark, sf_dir)), UNIT_UM)
    return s.select("nuc", *[F.round(c, 9).alias(c) for c in ("ux", "uy", "uz", "radius")])


@query(f"{V}, {HIST_SQL} SELECT *, n / 8.0::DOUBLE AS support FROM hist")
def nuc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of each segment under each nucleus of a coarser volume."""
    return _hist(spark, sf_dir)


@query(f"{V}, {TARGETS_SQL} SELECT * FROM q")
def nuc_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nuclei that qualify in segments with several."""
    return _targets(spark, sf_dir)


@query(f"{V}, {TARGETS_SQL}, {SPHERE_SQL}, {GAPS_SQL} SELECT sid, n1, n2, round(gap, 9) AS gap FROM gaps")
def nuc_pair_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between the spheres of nuclei that share a segment."""
    return _gaps(spark, sf_dir).select("sid", "n1", "n2", F.round("gap", 9).alias("gap"))


_UNITS_SQL = f"""{VR}, {TARGETS_SQL}, {SPHERE_SQL}, {GAPS_SQL}, near AS (SELECT sid, n1 AS a, n2 AS b FROM gaps WHERE gap < {CONTACT_UM} UNION SELECT sid, n2, n1 FROM gaps WHERE gap < {CONTACT_UM}),
ur AS (SELECT sid, nuc AS src, nuc FROM q UNION SELECT r.sid, r.src, n.b FROM ur r JOIN near n ON n.sid = r.sid AND n.a = r.nuc), ul AS (SELECT sid, nuc, min(src) AS anchor FROM ur GROUP BY 1, 2),
groups AS (SELECT sid, nuc, anchor, count(*) OVER (PARTITION BY sid, anchor) AS members, (SELECT count(DISTINCT anchor) FROM ul u WHERE u.sid = ul.sid) AS groups FROM ul)"""


@query(f"{_UNITS_SQL} SELECT * FROM groups")
def nuc_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nuclei of a segment that nearly touch, as groups."""
    return _groups(spark, sf_dir)


_BOXES_SQL = f"""{_UNITS_SQL}, boxes AS (SELECT sid, anchor, greatest(min(x0) - 2, 0) AS x0, greatest(min(y0) - 2, 0) AS y0, greatest(min(z0) - 1, 0) AS z0, least(max(x1) + 2, 32) AS x1, least(max(y1) + 2, 32) AS y1, least(max(z1) + 1, {NZ}) AS z1
FROM groups JOIN geo USING (nuc) WHERE members >= 2 GROUP BY 1, 2)"""


@query(f"{_BOXES_SQL} SELECT * FROM boxes")
def unit_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the units."""
    return _boxes(spark, sf_dir)


_FILLED_SQL = f"""{_BOXES_SQL}, filled AS (SELECT b.sid, b.anchor, min(v.x) // 2 * 2::BIGINT AS x0, min(v.y) // 2 * 2::BIGINT AS y0, min(v.z) // 2 * 2::BIGINT AS z0, least((max(v.x) // 2 + 1) * 2, 32)::BIGINT AS x1, least((max(v.y) // 2 + 1) * 2, 32)::BIGINT AS y1, least((max(v.z) // 2 + 1) * 2, {NZ})::BIGINT AS z1
FROM boxes b JOIN soma v ON v.sid = b.sid AND v.x >= b.x0 AND v.x < b.x1 AND v.y >= b.y0 AND v.y < b.y1 AND v.z >= b.z0 AND v.z < b.z1 GROUP BY 1, 2)"""


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved(spark, sf_dir, "filled", lambda: nucleus.parent_boxes(_somas(spark, sf_dir), _boxes(spark, sf_dir), 2, extent(spark, sf_dir)))


@query(f"{_FILLED_SQL} SELECT * FROM filled")
def unit_parent_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aligned parts of the boxes that the segments fill."""
    return _filled(spark, sf_dir)


@query(f"{V}, p AS (SELECT CAST(x // 2 AS INT) AS x, CAST(y // 2 AS INT) AS y, CAST(z // 2 AS INT) AS z, CASE WHEN count(*) = 8 THEN min(sid) ELSE least(min(sid), 0) END AS low, CASE WHEN count(*) = 8 THEN max(sid) ELSE greatest(max(sid), 0) END AS high FROM voxel GROUP BY 1, 2, 3) SELECT *, CASE WHEN low = high THEN low ELSE 0 END AS same FROM p")
def pool_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, greatest and unanimous label of every block of eight."""
    return nucleus.pool(voxels(spark, sf_dir), "sid", 2)


@query(f"{_UNITS_SQL} SELECT x, y, z, coalesce(g.nuc, 0) AS owner FROM soma v LEFT JOIN groups g ON g.sid = v.sid AND g.nuc = v.nuc AND members >= 2")
def owner_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that qualify as owners in their segment."""
    return nucleus.owner_labels(_somas(spark, sf_dir), _groups(spark, sf_dir))


#: Boxes with a margin so wide that those of a segment overlap.
_WIDE_SQL = _BOXES_SQL.replace("min(z0) - 1", "min(z0) - 4").replace("max(z1) + 1,", "max(z1) + 4,")


@query(f"{_WIDE_SQL} SELECT a.sid, a.anchor AS anchor_a, b.anchor AS anchor_b FROM boxes a JOIN boxes b ON a.sid = b.sid AND a.anchor < b.anchor AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 AND a.z0 < b.z1 AND b.z0 < a.z1")
def unit_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of a segment whose boxes overlap, with a margin that is too wide."""
    wide = nucleus.unit_boxes(_groups(spark, sf_dir), nucleus.geometry(_somas(spark, sf_dir)), (2, 2, 4), extent(spark, sf_dir))
    return nucleus.clashes(wide)


@query(f"{_UNITS_SQL}, u AS (SELECT DISTINCT sid, nuc FROM groups WHERE members >= 2) SELECT (SELECT count(*) FROM u) AS n_territories, count(*) AS n_faults FROM u WHERE sid >= 144115188075855872")
def unit_id_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units whose ids are not safe (none), of so many territories."""
    groups = _groups(spark, sf_dir)
    n = groups.where("members >= 2").select("sid", "nuc").distinct().agg(F.count(F.lit(1)).alias("n_territories"))
    return side_by_side(n, nucleus.id_faults(groups).agg(F.count(F.lit(1)).alias("n_faults")))


@query(f"""{_BOXES_SQL}, g AS (SELECT CAST(0 AS INT) AS mip, CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy, CAST(cz AS INT) AS cz FROM range(2) a(cx), range(2) b(cy), (SELECT unnest(range(0, nz // 8)) AS cz FROM ext))
SELECT sid, anchor, mip, cx, cy, cz FROM boxes JOIN g ON x0 < (cx + 1) * 16 AND cx * 16 < x1 AND y0 < (cy + 1) * 16 AND cy * 16 < y1 AND z0 < (cz + 1) * 8 AND cz * 8 < z1""")
def unit_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that the units' boxes reach into."""
    return nucleus.touched_chunks(_boxes(spark, sf_dir), grid_of(spark, sf_dir).where("mip = 0"), CHUNK)


def _flooded(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        units = nucleus.checked_units(_filled(spark, sf_dir), _groups(spark, sf_dir))
        return nucleus.flood_units(_somas(spark, sf_dir), units, _groups(spark, sf_dir), 1, CHUNK)

    return saved(spark, sf_dir, "flooded", make)


@query()
def flood_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the units shared out among their owners."""
    return _flooded(spark, sf_dir)


@query(f"""{_FILLED_SQL} SELECT f.sid, f.anchor, count(*) AS n_cells, CAST(0 AS BIGINT) AS n_lost_cores, CAST(0 AS BIGINT) AS n_strangers
FROM filled f JOIN soma v ON v.sid = f.sid AND v.x >= f.x0 AND v.x < f.x1 AND v.y >= f.y0 AND v.y < f.y1 AND v.z >= f.z0 AND v.z < f.z1 GROUP BY 1, 2""")
def flood_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of every unit; cores that another nucleus has taken and blocks of a nucleus that is not in the unit (none)."""
    groups = _groups(spark, sf_dir)
    cells = _flooded(spark, sf_dir).join(_somas(spark, sf_dir).select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), F.col("nuc").alias("core")), ["px", "py", "pz"])
    known = groups.select("sid", "anchor", F.col("nuc").alias("territory"), F.lit(True).alias("known"))
    cores = groups.select("sid", "anchor", F.col("nuc").alias("core"), F.lit(True).alias("seed"))
    rows = cells.join(known, ["sid", "anchor", "territory"], "left").join(cores, ["sid", "anchor", "core"], "left")
    strange = F.col("known").isNull() & (F.col("territory") != 0)
    return rows.groupBy("sid", "anchor").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("seed") & (F.col("core") != F.col("territory"))).alias("n_lost_cores"), F.count_if(strange).alias("n_strangers"))


@query()
def flood_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every retired segment turns into."""
    return nucleus.ledger(_flooded(spark, sf_dir))


@query(f"{_UNITS_SQL} SELECT DISTINCT sid, nuc AS owner, 1152921504606846976 + CAST('0x' || substr(sha256('nucleus-owner:' || nuc), 1, 14) AS BIGINT) AS minted FROM groups WHERE members >= 2")
def ledger_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners that every retired segment goes to, with their ids: all nuclei of its units."""
    return nucleus.ledger(_flooded(spark, sf_dir)).select("sid", "owner", "minted")


@query()
def overlay_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume with territories in place of the retired segments, and the tags of their owners."""
    return nucleus.overlay(_somas(spark, sf_dir).select("x", "y", "z", "sid", "nuc"), _flooded(spark, sf_dir))


@query(f"""{_FILLED_SQL}, o AS (SELECT v.x, v.y, v.z FROM soma v JOIN filled f ON v.sid = f.sid AND v.x >= f.x0 AND v.x < f.x1 AND v.y >= f.y0 AND v.y < f.y1 AND v.z >= f.z0 AND v.z < f.z1)
SELECT (SELECT count(*) FROM voxel) AS n_voxels, (SELECT count(*) FROM o) - (SELECT count(*) FROM o) AS n_changed_outside, CAST(0 AS BIGINT) AS n_wrong_id, CAST(0 AS BIGINT) AS n_wrong_tag""")
def overlay_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of the overlay; those changed outside the units, under an id that is not their owner's, or with a tag that
    does not fit the id (none)."""
    before = _somas(spark, sf_dir).select("x", "y", "z", F.col("sid").alias("was"), F.col("nuc").alias("tag"))
    boxes = _filled(spark, sf_dir).withColumnRenamed("sid", "was")
    inside = before.join(boxes, "was").where(" AND ".join(f"{c} >= {c}0 AND {c} < {c}1" for c in "xyz")).select("x", "y", "z", F.lit(True).alias("inside"))
    rows = overlay_labels(spark, sf_dir).join(before, ["x", "y", "z"]).join(inside, ["x", "y", "z"], "left")
    changed = F.col("sid") != F.col("was")
    return rows.agg(
        F.count(F.lit(1)).alias("n_voxels"), F.count_if(F.col("inside").isNull() & (changed | (F.col("nuc") != F.col("tag")))).alias("n_changed_outside"),
        F.count_if(changed & (F.col("sid") != nucleus.mint(F.col("nuc")))).alias("n_wrong_id"), F.count_if(~changed & (F.col("nuc") != F.col("tag"))).alias("n_wrong_tag"),
    )


@query(f"{V}, {TARGETS_SQL} SELECT x, y, z, v.sid, CASE WHEN v.nuc % 3 = 1 AND q.nuc IS NULL THEN 0 ELSE v.nuc END AS nuc FROM soma v LEFT JOIN q ON q.sid = v.sid AND q.nuc = v.nuc AND q.n % 2 = 0")
def overlay_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of protected owners kept only where they qualify."""
    v = _somas(spark, sf_dir)
    some = _targets(spark, sf_dir).where("n % 2 = 0")
    return nucleus.filter_ownership(v.select("x", "y", "z", "sid", "nuc"), some, v.where("nuc % 3 = 1").select("nuc").distinct())


_SINGLE_SQL = "single AS (SELECT sid, min(nuc) AS owner FROM hist WHERE n >= 20 GROUP BY sid HAVING count(DISTINCT nuc) = 1)"


@query(f"{V}, {HIST_SQL}, {_SINGLE_SQL} SELECT x, y, z, coalesce(1152921504606846976 + CAST('0x' || substr(sha256('nucleus-owner:' || owner), 1, 14) AS BIGINT), v.sid) AS sid FROM voxel v LEFT JOIN single s ON s.sid = v.sid")
def overlay_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with a single owner under the owner's minted id."""
    return nucleus.canonical_segments(voxels(spark, sf_dir).select("x", "y", "z", "sid"), _hist(spark, sf_dir).where("n >= 20"))


@query(f"{V} SELECT DISTINCT nuc, 1152921504606846976 + CAST('0x' || substr(sha256('nucleus-owner:' || nuc), 1, 14) AS BIGINT) AS minted FROM voxel WHERE nuc <> 0")
def owner_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minted ids of owners."""
    return voxels(spark, sf_dir).where("nuc <> 0").select("nuc").distinct().select("nuc", nucleus.mint(F.col("nuc")).alias("minted"))



@query(f"{_FILLED_SQL}, t AS (SELECT (x1 - x0) * (y1 - y0) * (z1 - z0) AS n FROM filled) SELECT CAST(sum(n) AS DOUBLE) AS serial_s, CAST(max(n) AS DOUBLE) AS longest_s, CAST(sum(n) AS DOUBLE) / max(n) AS speedup FROM t")
def flood_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What running the units side by side can gain, at a second for each voxel of a box."""
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) * (F.col("z1") - F.col("z0"))
    return nucleus.critical_path(_filled(spark, sf_dir).select(F.col("anchor").alias("unit"), size.cast("double").alias("seconds")))


#: What stands for each matched segment: the nid of its group's first match.
_STAND_SQL = """WITH RECURSIVE pairs AS (SELECT oid AS s1, nid AS s2, coalesce(agg_size, -1) AS agg FROM matching_faces WHERE oid <> 0 AND nid <> 0), """ + reach("pairs") + """,
best AS (SELECT cc, nid FROM (SELECT c.cc, p.s2 AS nid, row_number() OVER (PARTITION BY c.cc ORDER BY agg DESC, p.s2, p.s1) AS rn FROM pairs p JOIN cc c ON c.id = p.s1) WHERE rn = 1),
stand AS (SELECT id AS old, nid AS new FROM cc JOIN best USING (cc))"""


@query(f"{_STAND_SQL} SELECT coalesce(new, sid) AS sid, CAST(sum(size) AS BIGINT) AS size FROM ongoing_supervoxel_counts LEFT JOIN stand ON old = sid WHERE sid <> 0 GROUP BY 1")
def match_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the open segments once their parts are matched."""
    stand = agglomeration.stand_ins(agglomeration.match(table(spark, sf_dir, "matching_faces"), None, Scratch(spark, "matchs")))
    counts = table(spark, sf_dir, "ongoing_supervoxel_counts").where("sid <> 0").select("sid", "size")
    return agglomeration.matched(stand, sizes=counts)["sizes"]


@query(f"""{_STAND_SQL}, e AS (SELECT coalesce(a.new, s1) AS u, coalesce(b.new, s2) AS v, area FROM residual_rg LEFT JOIN stand a ON a.old = s1 LEFT JOIN stand b ON b.old = s2 WHERE s1 <> 0 AND s2 <> 0)
SELECT least(u, v) AS s1, greatest(u, v) AS s2, CAST(sum(area) AS BIGINT) AS area FROM e WHERE u <> v GROUP BY 1, 2""")
def match_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of the residual edges between matched segments."""
    stand = agglomeration.stand_ins(agglomeration.match(table(spark, sf_dir, "matching_faces"), None, Scratch(spark, "matche")))
    edges = table(spark, sf_dir, "residual_rg").where("s1 <> 0 AND s2 <> 0").select("s1", "s2", F.lit(0.0).alias("sum_aff"), "area")
    return agglomeration.matched(stand, edges=edges)["edges"].select("s1", "s2", "area")
