import tempfile
from datetime import datetime

from pyspark.sql import functions as F

from volseg.streaming import edges as E


def test_rows_loaded_twice_count_once(spark):
    schema = "s1 bigint, s2 bigint, aff double, area bigint, file_id bigint, slot int, written_at timestamp"
    day = lambda d: datetime(2025, 3, d, 12)
    rows = [(2, 1, 0.5, 1, 1, 0, day(1)), (1, 2, 0.25, 2, 1, 1, day(1)), (2, 1, 0.5, 1, 1, 0, day(1)), (0, 2, 1.0, 1, 1, 2, day(1)), (1, 2, 9.0, 9, 2, 0, day(20))]
    source, out, state = (tempfile.mkdtemp() for _ in range(3))
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(source)
    for _ in range(2):
        E.start(spark, source, schema, out, state).awaitTermination()
        spark.createDataFrame([(3, 4, 1.0, 1, 9, 0, day(28))], schema).write.mode("append").parquet(source)
    got = spark.read.parquet(out).where(F.col("day") == datetime(2025, 3, 1)).select("s1", "s2", "sum_aff", "area").collect()
    assert [tuple(r) for r in got] == [(1, 2, 0.75, 3)]


def test_late_rows_and_repeats_in_later_batches(spark):
    schema = "s1 bigint, s2 bigint, aff double, area bigint, file_id bigint, slot int, written_at timestamp"
    day = lambda d: datetime(2025, 3, d, 12)
    batches = [
        [(1, 2, 0.5, 1, 1, 0, day(1)), (1, 2, 1.0, 4, 2, 0, day(20))],
        [(2, 1, 0.25, 2, 3, 0, day(1)), (5, 6, 1.0, 1, 3, 1, day(2)), (1, 2, 0.5, 1, 1, 0, day(1))],  # weeks late, and one repeat
        [(1, 2, 1.0, 4, 2, 0, day(20)), (2, 1, 0.25, 2, 3, 0, day(1))],  # repeats only
    ]
    source, out, state = (tempfile.mkdtemp() for _ in range(3))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        E.start(spark, source, schema, out, state).awaitTermination()
    got = E.merged(spark, out).select(F.dayofmonth("day"), "s1", "s2", "sum_aff", "area").collect()
    assert sorted(tuple(r) for r in got) == [(1, 1, 2, 0.75, 3), (2, 5, 6, 1.0, 1), (20, 1, 2, 1.0, 4)]
