"""Queries of the training-data problems tagged llm, and the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volseg.llm import components, mixing, packing, percentiles, sentences, tokens
from volseg.storage import Scratch, table


def _wanted(spark: SparkSession, sf_dir: str) -> list[float]:
    """The percentiles of the score table, which lists the scores in use and does not grow with the data."""
    rows = table(spark, sf_dir, "edge_score_config").where("percentile BETWEEN 0 AND 100").select("percentile").distinct().collect()
    return sorted(r.percentile for r in rows)


def _day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "residual_rg").select("chunk_tag", F.to_date("written_at").alias("day"), "aff")
    return percentiles.counted(edges, ["chunk_tag", "day"], "aff")


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of the finite aff of every chunk (null day) and of every day of a chunk.

    Rows are counted as stored. ``rank_error`` is 0: the values are interpolated from exact order statistics.
    """
    scratch = Scratch(spark, "p1")
    days = _day_counts(spark, sf_dir).withColumn("level", F.lit("day"))
    days = scratch.save(days)
    chunks = days.groupBy("chunk_tag", "v").agg(F.sum("n").alias("n")).select("chunk_tag", F.lit(None).cast("date").alias("day"), "v", "n", F.lit("chunk").alias("level"))
    group = ["level", "chunk_tag", "day"]
    ranks = percentiles.ranked(days.unionByName(chunks).select(*group, "v", "n"), group, scratch)
    out = percentiles.percentiles(ranks, group, _wanted(spark, sf_dir))
    return out.withColumn("rank_error", F.lit(0).cast("bigint"))


P1_PERCENTILES_SQL = """
WITH x AS (SELECT chunk_tag, CAST(written_at AS DATE) AS day, aff + 0.0 AS v FROM residual_rg WHERE isfinite(aff)),
     g AS (SELECT 'day' AS level, chunk_tag, day, v FROM x UNION ALL SELECT 'chunk', chunk_tag, NULL, v FROM x),
     r AS (SELECT *, row_number() OVER (PARTITION BY level, chunk_tag, day ORDER BY v) - 1 AS pos, count(*) OVER (PARTITION BY level, chunk_tag, day) AS n FROM g),
     p AS (SELECT DISTINCT percentile FROM edge_score_config WHERE percentile BETWEEN 0 AND 100),
     t AS (SELECT level, chunk_tag, day, n, percentile, percentile / 100.0 * (n - 1) AS h, v, pos FROM r JOIN p ON pos BETWEEN floor(percentile / 100.0 * (n - 1)) AND floor(percentile / 100.0 * (n - 1)) + 1)
SELECT level, chunk_tag, day, percentile, n AS n_values,
       min(v) FILTER (WHERE pos = floor(h)) + (max(v) FILTER (WHERE pos = least(floor(h) + 1, n - 1)) - min(v) FILTER (WHERE pos = floor(h))) * (h - floor(h)) AS value,
       CAST(0 AS BIGINT) AS rank_error
FROM t GROUP BY level, chunk_tag, day, percentile, n, h"""


def _summary(spark: SparkSession, sf_dir: str, scratch: Scratch) -> DataFrame:
    group = ["chunk_tag", "day"]
    ranks = percentiles.ranked(_day_counts(spark, sf_dir), group, scratch)
    return percentiles.summaries(ranks, group)


def p1_day_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mergeable summary of every day of a chunk."""
    return _summary(spark, sf_dir, Scratch(spark, "p1s"))


def p1_span_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of every week of a chunk, combined from the summaries of its days, with the bound on the rank."""
    scratch = Scratch(spark, "p1w")
    summary = scratch.save(_summary(spark, sf_dir, scratch).withColumn("week", F.to_date(F.date_trunc("week", "day"))))
    return percentiles.span_percentiles(summary, ["chunk_tag", "day"], ["chunk_tag", "week"], _wanted(spark, sf_dir))


_SUMMARY_SQL = """
x AS (SELECT chunk_tag, CAST(written_at AS DATE) AS day, aff + 0.0 AS v FROM residual_rg WHERE isfinite(aff)),
r AS (SELECT chunk_tag, day, v, row_number() OVER (PARTITION BY chunk_tag, day ORDER BY v) - 1 AS pos, count(*) OVER (PARTITION BY chunk_tag, day) AS n FROM x),
k AS (SELECT *, CAST(greatest(1, floor(n * 0.01::DOUBLE)) AS BIGINT) AS k FROM r),
s AS (SELECT chunk_tag, day, v, CAST(greatest(0, least(count(*) FILTER (WHERE pos % k = 0) * k, n - coalesce(min(pos) FILTER (WHERE pos % k = 0), n))) AS BIGINT) AS weight, k - 1 AS slack
      FROM k GROUP BY chunk_tag, day, v, n, k HAVING count(*) FILTER (WHERE pos % k = 0) > 0 OR max(pos) = n - 1)"""
P1_DAY_SUMMARIES_SQL = f"WITH {_SUMMARY_SQL} SELECT * FROM s WHERE weight > 0 OR slack > 0"
P1_SPAN_PERCENTILES_SQL = f"""WITH {_SUMMARY_SQL},
w AS (SELECT *, CAST(date_trunc('week', day) AS DATE) AS week FROM s WHERE weight > 0 OR slack > 0),
e AS (SELECT chunk_tag, week, CAST(sum(slack) AS BIGINT) AS rank_error FROM (SELECT DISTINCT chunk_tag, week, day, slack FROM w) GROUP BY 1, 2),
m AS (SELECT chunk_tag, week, v, sum(weight) AS n FROM w GROUP BY 1, 2, 3),
u AS (SELECT *, sum(n) OVER (PARTITION BY chunk_tag, week ORDER BY v) AS upto, sum(n) OVER (PARTITION BY chunk_tag, week) AS total FROM m),
p AS (SELECT DISTINCT percentile FROM edge_score_config WHERE percentile BETWEEN 0 AND 100)
SELECT u.chunk_tag, u.week, percentile, CAST(total AS BIGINT) AS n_values, v AS value, rank_error
FROM u JOIN p ON floor(percentile / 100.0 * (total - 1)) >= upto - n AND floor(percentile / 100.0 * (total - 1)) < upto
JOIN e ON e.chunk_tag IS NOT DISTINCT FROM u.chunk_tag AND e.week IS NOT DISTINCT FROM u.week"""


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every segment linked in matching_faces or extra_remaps."""
    sides = (table(spark, sf_dir, "matching_faces"), "oid", "nid"), (table(spark, sf_dir, "extra_remaps"), "os", "ns")
    out = components.components(components.link_edges(*sides), components.link_ids(*sides), Scratch(spark, "p4"))
    return out.select(F.col("id").alias("seg_id"), "group_id")


P4_FOUND_SQL = """
WITH RECURSIVE raw AS (SELECT oid AS a, nid AS b FROM matching_faces UNION ALL SELECT os, ns FROM extra_remaps),
     ids AS (SELECT a AS id FROM raw WHERE a <> 0 UNION SELECT b FROM raw WHERE b <> 0),
     e AS (SELECT a, b FROM raw WHERE a <> 0 AND b <> 0 AND a <> b UNION SELECT b, a FROM raw WHERE a <> 0 AND b <> 0 AND a <> b),
     starts AS (SELECT id FROM ids WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.a = ids.id AND e.b < ids.id)),
     reach AS (SELECT id AS src, id FROM starts UNION SELECT r.src, e.b FROM reach r JOIN e ON e.a = r.id)
SELECT id AS seg_id, min(src) AS group_id FROM reach GROUP BY id"""


def _bins(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    """The kinds of containers, a list that does not grow with the data."""
    return [(r.bin_code, r.capacity_tokens) for r in table(spark, sf_dir, "pack_bins").orderBy("capacity_tokens").collect()]


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in containers of every capacity, measured in tokens."""
    scratch = Scratch(spark, "p6")
    counts = scratch.save(tokens.token_counts(table(spark, sf_dir, "documents"), ["doc_id"]))
    return packing.pack_documents(counts, _bins(spark, sf_dir), scratch)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.fill_report(p6_packing(spark, sf_dir), _bins(spark, sf_dir))


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the containers hold every text, piece by piece, and no more than their capacity: counts of what does not."""
    scratch, bins = Scratch(spark, "p6k"), _bins(spark, sf_dir)
    counts = scratch.save(tokens.token_counts(table(spark, sf_dir, "documents"), ["doc_id"]))
    return packing.kept_report(scratch.save(packing.pack_documents(counts, bins, scratch)), counts, bins)


P6_KEPT_SQL = """
SELECT bin_code, CAST(capacity_tokens AS BIGINT) AS capacity_tokens, (SELECT count(DISTINCT doc_id) FROM documents) AS n_docs, CAST(0 AS BIGINT) AS n_overfull,
       CAST(0 AS BIGINT) AS n_incomplete, CAST(0 AS BIGINT) AS n_split_without_need, CAST(0 AS BIGINT) AS n_overlapping
FROM pack_bins WHERE bin_code IS NOT NULL AND capacity_tokens > 0"""


def _targets(spark: SparkSession, sf_dir: str) -> list[mixing.Target]:
    """The wanted shares, a list that does not grow with the data."""
    rows = table(spark, sf_dir, "mix_targets").select(mixing.canonical(F.col("source")).alias("source"), "target_share", "max_repeats").orderBy("source").collect()
    return [mixing.Target(r.source, r.target_share, r.max_repeats) for r in rows]


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mixture in which every source keeps its share of the tokens."""
    scratch = Scratch(spark, "p7")
    counts = scratch.save(tokens.token_counts(table(spark, sf_dir, "documents"), ["doc_id", "source"]))
    return mixing.mix(counts, _targets(spark, sf_dir), scratch)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached by the mixture."""
    return mixing.shares_report(Scratch(spark, "p7s").save(p7_mixture(spark, sf_dir)), _targets(spark, sf_dir))


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the mixture keeps its rules for every source: counts of what does not, and whether the share is reached."""
    scratch, targets = Scratch(spark, "p7k"), _targets(spark, sf_dir)
    counts = scratch.save(tokens.token_counts(table(spark, sf_dir, "documents"), ["doc_id", "source"]))
    return mixing.kept_report(scratch.save(mixing.mix(counts, targets, scratch)), counts, targets)


P7_KEPT_SQL = """
WITH d AS (SELECT DISTINCT regexp_replace(lower(trim(source)), '[\\s_-]+', '_', 'g') AS source FROM documents WHERE trim(text) <> '')
SELECT m.source, d.source IS NOT NULL AS present, CAST(0 AS BIGINT) AS n_too_often, CAST(0 AS BIGINT) AS n_out_of_turn, true AS on_target
FROM (SELECT regexp_replace(lower(trim(source)), '[\\s_-]+', '_', 'g') AS source FROM mix_targets) m LEFT JOIN d ON d.source = m.source"""


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence units of every text."""
    return sentences.sentence_units(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_day_summaries, p1_span_percentiles, p4_found, p6_packing, p6_fill, p6_kept, p7_mixture, p7_shares, p7_kept, p8_found)}
SQL = {
    "p1_percentiles": P1_PERCENTILES_SQL, "p1_day_summaries": P1_DAY_SUMMARIES_SQL, "p1_span_percentiles": P1_SPAN_PERCENTILES_SQL,
    "p4_found": P4_FOUND_SQL, "p6_kept": P6_KEPT_SQL, "p7_kept": P7_KEPT_SQL,
}
