"""Edges that arrive in batches, merged into totals; an optional way to keep the region graph current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SEEN = "file_id bigint, slot bigint, epoch bigint"


def totals(edges: DataFrame) -> DataFrame:
    """``day, s1, s2, sum_aff, area``: affinity sums and areas by pair and day of writing.

    ``edges``: ``s1, s2, aff, area, written_at``, each record once.
    """
    day = F.window("written_at", "1 day")
    pair = F.least("s1", "s2").alias("s1"), F.greatest("s1", "s2").alias("s2")
    sums = edges.where("s1 <> 0 AND s2 <> 0").groupBy(day, *pair).agg(F.sum("aff").alias("sum_aff"), F.sum("area").alias("area"))
    return sums.select(F.col("window.start").alias("day"), "s1", "s2", "sum_aff", "area")


def merged(spark: SparkSession, out: str) -> DataFrame:
    """The totals kept below ``out``, one row for each day and pair, whatever batches its records came in."""
    return spark.read.parquet(out).groupBy("day", "s1", "s2").agg(F.sum("sum_aff").alias("sum_aff"), F.sum("area").alias("area"))


def start(spark: SparkSession, source: str, schema, out: str, checkpoint: str) -> StreamingQuery:
    """Keep totals of the Parquet files below ``source`` in Parquet below ``out``, to be read by :func:`merged`.

    The files are as :func:`totals` takes them, with ``file_id, slot``. Each batch adds the sums of its records, so a day gets
    a further row for a pair when records come late; however late they are, none is dropped. A record (``file_id,
    slot``) counts once over all batches: those counted are kept in ``out/_seen``, which grows with the records. A
    batch that is run again overwrites its own rows only. An ``out`` belongs to one checkpoint.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        fresh = batch.dropDuplicates(["file_id", "slot"])
        if epoch:
            seen = session.read.schema(SEEN).parquet(f"{out}/_seen").where(F.col("epoch") < epoch)
            known = F.col("f.file_id").eqNullSafe(F.col("k.file_id")) & F.col("f.slot").eqNullSafe(F.col("k.slot"))
            fresh = fresh.alias("f").join(seen.alias("k"), known, "left_anti")
        fresh = fresh.persist()
        try:
            fresh.select(F.col("file_id").cast("bigint"), F.col("slot").cast("bigint")).write.mode("overwrite").parquet(f"{out}/_seen/epoch={epoch}")
            totals(fresh).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        finally:
            fresh.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
