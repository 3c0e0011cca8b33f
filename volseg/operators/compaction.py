"""Many tiny files into few well-sized ones, every record kept and none twice.

A file whose distinct records all lie in one other file of the same table and chunk is left out and listed with the
file that holds them. The others are dealt by a hash into shards, each with a fixed number of output groups. The task
of a shard first meets the sizes of its files, assigns them longest first to the least loaded group, then streams the
records through pyarrow into one file for each group. A manifest of files and groups is published once the counts and
checksums of what was read, written and read back agree. The records are shuffled once and joined with nothing that
grows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volseg.storage import Scratch, broadcast_if_small, delete

#: Bytes of an output group; groups of a table at least, so that a small one has several writers; groups of a shard;
#: rows that a group gathers before it writes them.
TARGET_BYTES, LEAST_GROUPS, SHARD_GROUPS, HELD_ROWS = 128 << 20, 32, 4, 1 << 17
#: Rows of two numbers up to which a counted table may be broadcast.
NARROW_ROWS = 1_000_000
GROUPS = "group_id bigint, path string, n_files bigint, n_records bigint, n_repeats bigint, n_bytes bigint, checksum bigint, stored_checksum bigint"
GROUPS_ARROW = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in GROUPS.split(", ")])
FILES = "file_id bigint, n_rows bigint, n_parts bigint, kept_in bigint"


def record_hash(scope: list[str], record: list[str]) -> Column:
    """64-bit hash of a record within its scope; null equals null, NaN equals NaN, and nulls keep their place."""
    flags = reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate([*scope, *record])])
    return F.xxhash64(flags, *scope, *record)


def contained_files(tables: list[tuple[DataFrame, list[str]]], scratch: Scratch) -> DataFrame:
    """``file_id, kept_in``: files whose distinct records all lie in ``kept_in``, a file of the same table and chunk
    that has more distinct records, or equally many and a smaller id.

    ``tables``: frames with ``chunk_tag, file_id`` and the named record columns; file ids are unique across them.
    Rows without a file id are in no file. One witness is given for each file.

    A file with a record that no other file has cannot be contained, and most files drop out that way. Of the
    rest, equal files are told by a fingerprint, and each other one asks only the files that hold its rarest
    record. All pairs so named are then compared record by record, by value.
    """
    tagged = [
        df.where(F.col("file_id").isNotNull()).select("file_id", record_hash(["_t", "chunk_tag"], record).alias("rec"))
        for df, record in ((df.withColumn("_t", F.lit(i)), record) for i, (df, record) in enumerate(tables))
    ]
    rows = reduce(DataFrame.unionByName, tagged)
    per = rows.groupBy("rec").agg(F.min("file_id").alias("a"), F.max("file_id").alias("b"), F.count(F.lit(1)).alias("n"))
    # of a record that no other file has only the file is kept, of others the record and how often it occurs
    apart = F.col("a") == F.col("b")
    held = scratch.save(per.select(F.when(apart, F.col("a")).alias("own"), F.when(~apart, F.col("rec")).alias("rec"), F.when(~apart, F.col("n")).alias("n")))
    scratch.tidy()
    own = held.where("own IS NOT NULL").groupBy(F.col("own").alias("file_id")).agg(F.count(F.lit(1)).alias("n_own"))
    often = held.where("rec IS NOT NULL").select("rec", "n")
    shared = scratch.save(rows.join(often, "rec").distinct())
    files = shared.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_shared"), F.min_by("rec", F.struct("n", "rec")).alias("rarest"),
        F.bit_xor("rec").alias("x1"), F.bit_xor(F.xxhash64("rec")).alias("x2"),
    )
    files = files.join(own, "file_id", "left")
    files = scratch.save(files.withColumn("n_all", F.col("n_shared") + F.coalesce("n_own", F.lit(0))))
    scratch.drop(held)
    scratch.tidy()

    covered = files.where("n_own is null")
    classes = scratch.save(covered.groupBy("n_all", "x1", "x2").agg(F.min("file_id").alias("first"), F.min("rarest").alias("rarest")))
    copies = covered.join(classes.drop("rarest"), ["n_all", "x1", "x2"]).where("file_id <> first").select("file_id", F.col("first").alias("kept_in"))
    heads = classes.select(F.col("first").alias("file_id"), F.col("rarest").alias("rec"), F.col("n_all").alias("size"))
    hosts = shared.select("rec", F.col("file_id").alias("kept_in")).join(files.select(F.col("file_id").alias("kept_in"), F.col("n_all").alias("host_size")), "kept_in")
    within = heads.join(hosts, "rec").where("host_size > size").select("file_id", "kept_in")
    pairs = scratch.save(copies.unionByName(within).distinct())

    # whether every shared record of the file is in the host, by hash ...
    a = shared.select("file_id", "rec")
    b = shared.select(F.col("file_id").alias("kept_in"), "rec")
    met = pairs.join(a, "file_id").join(b, ["kept_in", "rec"]).groupBy("file_id", "kept_in").agg(F.count(F.lit(1)).alias("met"))
    likely = scratch.save(met.join(covered.select("file_id", "n_all"), "file_id").where("met = n_all").select("file_id", "kept_in"))
    scratch.drop(shared, files, classes, pairs)
    scratch.tidy()
    # ... and by value; a copy of a contained file is contained in its host as well, but the file is witness enough
    sure = reduce(DataFrame.unionByName, [_by_value(df, record, likely, scratch) for df, record in tables])
    direct = scratch.save(sure.groupBy("file_id").agg(F.min("kept_in").alias("kept_in")))
    scratch.drop(likely)
    scratch.tidy()
    return direct


def _by_value(df: DataFrame, record: list[str], pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs in which every distinct record of ``file_id`` is found in ``kept_in``."""
    n = pairs.count()
    part = pairs.select(F.explode(F.array("file_id", "kept_in")).alias("fid")).distinct()
    own = df.select("chunk_tag", "file_id", *record)
    own = own.join(broadcast_if_small(part, 2 * n), own["file_id"] == part["fid"], "left_semi").distinct()
    own = scratch.save(own.withColumn("rec", record_hash(["chunk_tag"], record)))
    a = own.join(pairs, "file_id")
    b = own.select(*[F.col(c).alias(f"_{c}") for c in own.columns])
    same = (F.col("kept_in") == F.col("_file_id")) & (F.col("rec") == F.col("_rec"))
    for c in ["chunk_tag", *record]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = a.join(b, same, "left")
    return met.groupBy("file_id", "kept_in").agg(F.count(F.lit(1)).alias("n"), F.count("_file_id").alias("m")).where("n = m").select("file_id", "kept_in")


def longest_first(sizes: np.ndarray, groups: int) -> np.ndarray:
    """Group of each file: files by falling size, each to the group with the least bytes so far."""
    loads = [(0, g) for g in range(groups)]
    out = np.empty(len(sizes), dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        load, g = loads[0]
        out[i] = g
        heapq.heapreplace(loads, (load + int(sizes[i]), g))
    return out


def _bits(column: pa.Array) -> np.ndarray:
    """Values as integers of which two are equal if the values are, nulls aside."""
    if pa.types.is_floating(column.type):
        return pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False).astype(np.float64).view(np.int64)
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64)


class _Group:
    """One output file: rows are gathered, then written as a row group."""

    def __init__(self, number: int, path: str, where):
        self.number, self.path, self.where = number, path, where
        self.writer, self.held, self.n_held = None, [], 0
        self.files = self.stored = self.repeats = self.check = self.kept = 0

    def add(self, rows: pa.RecordBatch) -> None:
        if rows.num_rows:
            self.held.append(rows)
            self.n_held += rows.num_rows
            if self.n_held >= HELD_ROWS:
                self.flush()

    def flush(self) -> None:
        import pyarrow.parquet as pq

        if self.held:
            rows = pa.Table.from_batches(self.held)
            if self.writer is None:
                self.writer = pq.ParquetWriter(self.path, rows.schema, filesystem=self.where, compression="zstd")
            self.writer.write_table(rows)
            self.held, self.n_held = [], 0

    def close(self) -> dict | None:
        self.flush()
        if self.writer is None:
            return None
        self.writer.close()
        return {
            "group_id": self.number, "path": self.path, "n_files": self.files, "n_records": self.stored, "n_repeats": self.repeats,
            "n_bytes": self.where.get_file_info(self.path).size, "checksum": self.check, "stored_checksum": self.kept,
        }


def _wrapped(total: int, more: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(np.int64(total) + more.sum(dtype=np.int64))


def _writer(folder: str, columns: list[str], identity: list[str]):
    """Write the files of a shard's groups from one sorted stream, in which the sizes of its files come first.

    Rows that repeat the one before, in hash and in every column of ``identity``, are left out, and so are those of
    files marked as left out (a negative size).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        sizes: dict[tuple[int, int], int] = {}
        groups: list[_Group] | None = None
        place: dict[tuple[int, int], int] = {}
        last = None

        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("_size")
            heads = size.is_valid().to_numpy(zero_copy_only=False)
            f, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_f", "_part"))
            if heads.any():
                sizes.update(zip(zip(f[heads].tolist(), part[heads].tolist()), size.drop_null().to_pylist()))
                batch = batch.filter(pa.array(~heads))
                if not batch.num_rows:
                    continue
                f, part = f[~heads], part[~heads]
            if groups is None:
                shard = batch.column("_shard")[0].as_py()
                units = sorted(u for u, n in sizes.items() if n >= 0)
                at = longest_first(np.array([sizes[u] for u in units], dtype=np.int64), SHARD_GROUPS)
                place = dict(zip(units, at.tolist()))
                groups = [_Group(shard * SHARD_GROUPS + i, f"{base}/group-{shard * SHARD_GROUPS + i:08d}-{attempt}.parquet", where) for i in range(SHARD_GROUPS)]
            checks = batch.column("_check").to_numpy(zero_copy_only=False)
            marks = [batch.column(c) for c in identity]
            table = np.stack([f, part, checks, *[g(c) for c in marks for g in (_bits, lambda c: c.is_null().to_numpy(zero_copy_only=False).astype(np.int64))]])
            fresh, new_unit = np.ones(len(f), dtype=bool), np.ones(len(f), dtype=bool)
            differ = table[:, 1:] != table[:, :-1]
            fresh[1:], new_unit[1:] = differ.any(axis=0), differ[:2].any(axis=0)
            if last is not None:
                fresh[0], new_unit[0] = (last != table[:, 0]).any(), (last[:2] != table[:2, 0]).any()
            last = table[:, -1].copy()
            starts = np.unique(np.concatenate([[0], np.flatnonzero(new_unit)]))
            to = np.repeat([place.get(u, -1) for u in zip(f[starts].tolist(), part[starts].tolist())], np.diff([*starts, len(f)]))
            rows = batch.select(columns)
            for i, group in enumerate(groups):
                mine = to == i
                stored = mine & fresh
                group.add(rows.filter(pa.array(stored)))
                group.files += int((mine & new_unit).sum())
                group.stored += int(stored.sum())
                group.repeats += int((mine & ~fresh).sum())
                group.check, group.kept = _wrapped(group.check, checks[mine]), _wrapped(group.kept, checks[stored])
        rows = [r for r in (g.close() for g in groups or []) if r]
        yield pa.RecordBatch.from_pylist(rows, schema=GROUPS_ARROW)

    return run


@dataclass(frozen=True)
class Manifest:
    """What a compaction has published: ``groups`` (the files written) and ``files`` (where each input file went).

    ``files``: ``file_id, n_rows, n_parts, kept_in``; a redundant file has a null ``n_rows`` and the file that holds
    its records in ``kept_in``; rows without a file id are listed under null.
    """

    groups: DataFrame
    files: DataFrame
    path: str

    def records(self) -> DataFrame:
        """The records in the files that the manifest names."""
        spark = self.groups.sparkSession
        rows = spark.read.parquet(f"{self.path}/data").withColumn("_name", F.col("_metadata.file_name"))
        names = self.groups.select(F.element_at(F.split("path", "/"), -1).alias("_name"))
        return rows.join(broadcast_if_small(names, self.groups.count()), "_name", "left_semi").drop("_name")


def compact(df: DataFrame, record: list[str], record_bytes: int, redundant: DataFrame, out_dir: str, scratch: Scratch, target_bytes: int = TARGET_BYTES, least: int = LEAST_GROUPS) -> Manifest:
    """Write the records of ``df`` to few files below ``out_dir`` and publish a manifest.

    Left out are the files in ``redundant`` (``file_id, kept_in``) and repeats of a row with the same file, slot and
    record, of which the one that arrived first is kept. Rows without a file id are kept as if they lay in one file;
    a file beyond the size of a group is cut into parts by the hash of its rows. There are as many groups as the
    target asks for, rounded up to whole shards, and at least ``least``. The manifest is renamed to
    ``out_dir/manifest`` only after counts and checksums of the rows agree with the input and those of the files,
    read back, with what was written; a failed or repeated task leaves files that no manifest names.
    """
    spark = df.sparkSession
    times = [c for c in ("arrived_at", "written_at") if c in df.columns]
    columns = ["chunk_tag", "file_id", "slot", *record, *times]
    check = record_hash(["file_id", "slot"], record)
    wide = F.sum(F.col("_check").cast("decimal(20,0)"))
    rows = df.select(*columns, F.coalesce("file_id", F.lit(-1)).alias("_f"))
    found = rows.select("_f", check.alias("_check")).groupBy("_f").agg(F.count(F.lit(1)).alias("n"), wide.alias("check"))
    gone = redundant.select(F.col("file_id").alias("_f"), "kept_in")
    files = scratch.save(found.join(gone, "_f", "left"))
    kept = files.where("kept_in IS NULL")
    n_files, total = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = -(-max(1, least, -(-total * record_bytes // target_bytes)) // SHARD_GROUPS)
    room = max(1, -(-total * record_bytes // (shards * SHARD_GROUPS)))
    # at most as many as there are groups: each of these files fills one and more
    parts = F.ceil(F.col("n") * record_bytes / room).cast("int")
    large = scratch.save(kept.where(F.col("n") * record_bytes > room).select("_f", parts.alias("_parts")))
    n_large = large.count()

    def shard(part: Column) -> Column:
        return F.pmod(F.xxhash64("_f") + part, F.lit(shards)).cast("int")

    no_part = F.lit(0)
    sized = files.join(F.broadcast(large), "_f", "left").select("_f", "n", "kept_in", F.coalesce("_parts", F.lit(1)).alias("_parts"))
    heads = sized.select("_f", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"), F.when(F.col("kept_in").isNull(), F.col("n") * record_bytes / F.col("_parts")).otherwise(-1).cast("bigint").alias("_size"))
    if n_large:
        rows = rows.join(F.broadcast(large), "_f", "left").withColumn("_part", F.when(F.col("_parts").isNotNull(), F.pmod(check, F.col("_parts"))).otherwise(no_part).cast("int")).drop("_parts")
    else:
        rows = rows.withColumn("_part", no_part)
    both = rows.unionByName(heads, allowMissingColumns=True).drop("file_id").withColumn("_shard", shard(F.col("_part")))
    moved = both.repartitionById(shards, "_shard").withColumn("file_id", F.when(F.col("_f") >= 0, F.col("_f"))).withColumn("_check", check)
    moved = moved.sortWithinPartitions(F.col("_size").asc_nulls_last(), "_f", "_part", "slot", "_check", *record, *times)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{out_dir}/data")
    files_system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    published = jvm.org.apache.hadoop.fs.Path(f"{out_dir}/manifest")
    if files_system.exists(published):
        raise RuntimeError(f"{out_dir}/manifest is there already")
    files_system.mkdirs(where)
    draft = f"{out_dir}/manifest-draft"
    moved.mapInArrow(_writer(f"{out_dir}/data", columns, ["file_id", "slot", *record]), GROUPS).write.mode("overwrite").parquet(f"{draft}/groups")
    groups = spark.read.schema(GROUPS).parquet(f"{draft}/groups")
    listed = sized.select(F.when(F.col("_f") >= 0, F.col("_f")).alias("file_id"), F.when(F.col("kept_in").isNull(), F.col("n")).alias("n_rows"), F.when(F.col("kept_in").isNull(), F.col("_parts")).cast("bigint").alias("n_parts"), "kept_in")
    listed.write.mode("overwrite").parquet(f"{draft}/files")
    scratch.tidy()

    def summed(name: str) -> Column:
        return F.coalesce(F.sum(F.col(name).cast("decimal(20,0)")), F.lit(0)).cast("string")

    have = groups.agg(F.coalesce(F.sum(F.col("n_records") + F.col("n_repeats")), F.lit(0)), summed("checksum")).first()
    want = kept.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("check"), F.lit(0)).cast("string")).first()
    draft_manifest = Manifest(groups, spark.read.schema(FILES).parquet(f"{draft}/files"), out_dir)
    wrong = 0
    if n_files:
        back = spark.read.schema(moved.select(*columns).schema).parquet(f"{out_dir}/data").select(F.col("_metadata.file_name").alias("_name"), check.alias("_check"))
        back = back.groupBy("_name").agg(F.count(F.lit(1)).alias("n"), wide.alias("sum"))
        named = groups.select(F.element_at(F.split("path", "/"), -1).alias("_name"), "n_records", "stored_checksum").join(back, "_name", "left")
        off = F.pmod(F.col("sum") - F.col("stored_checksum"), F.lit(Decimal(1 << 64)))
        wrong = named.where(F.col("n").isNull() | (F.col("n") != F.col("n_records")) | (off != 0)).count()
    if have[0] != want[0] or (int(have[1]) - int(want[1])) % (1 << 64) or wrong:
        delete(spark, draft)
        raise RuntimeError(f"compaction of {out_dir} is not published: {have} written, {want} expected, {wrong} files differ when read back")
    if not files_system.rename(jvm.org.apache.hadoop.fs.Path(draft), published):
        raise RuntimeError(f"{out_dir}/manifest could not be published")
    scratch.drop(files, large)
    return Manifest(spark.read.schema(GROUPS).parquet(f"{out_dir}/manifest/groups"), spark.read.schema(FILES).parquet(f"{out_dir}/manifest/files"), draft_manifest.path)


def compact_tables(tables: list[tuple[DataFrame, list[str], int]], scratch: Scratch, target_bytes: int = TARGET_BYTES, least: int = LEAST_GROUPS) -> list[Manifest]:
    """Compact tables (frame, record columns, bytes of a record) that share one numbering of files, redundant files
    left out: one manifest for each, in folders of ``scratch``."""
    redundant = contained_files([(df, record) for df, record, _ in tables], scratch)
    return [compact(df, record, width, redundant, scratch.path(), scratch, target_bytes, least) for df, record, width in tables]
