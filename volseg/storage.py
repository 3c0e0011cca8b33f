"""Tables that outlive a stage, kept in the folder all executors share.

Iterative operators cut their lineage by writing a table and reading it back. The folder is the one the session
names in ``spark.checkpoint.dir``; only a local master, where driver and executors are one process, may fall back
to a temporary folder.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of narrow rows may be broadcast once it has been counted.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder, without a trailing slash."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="volseg-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder through Hadoop's file system; a missing one is fine."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Numbered tables below one folder, removed one by one or at the end of the process."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._close)

    def path(self) -> str:
        self.count += 1
        return f"{self.root}/t{self.count}"

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the reader of what was written; ``.saved_at`` holds its path."""
        path = self.path()
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.saved_at = path
        return back

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            if table is not None and getattr(table, "saved_at", None):
                delete(self.spark, table.saved_at)

    def tidy(self) -> None:
        """Let go of the shuffles of finished steps: their files stay until the driver's JVM has collected them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _close(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:
            pass


def broadcast_if_small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the counted ``rows`` allow it; otherwise leave the join to shuffle."""
    return F.broadcast(df) if rows <= most else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if its scan has fewer; a larger table is left where it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
