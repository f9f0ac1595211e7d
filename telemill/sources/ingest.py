"""Ingest that can be repeated: replace, backfill of days, guarded append by content hash, manifests."""

from __future__ import annotations

import uuid
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.functions import on_days
from telemill.operators.windows import ordered_running_sum
from telemill.sources.scratch import scratch
from telemill.sources.sinks import write_days


def replace(df: DataFrame, path: str) -> int:
    """Write a layer over what was there; the count it holds."""
    write_days(df, path)
    return df.sparkSession.read.parquet(path).count()


def backfill(df: DataFrame, path: str, first: str, last: str) -> None:
    """Replace the days of a range; files of other days stay as they are."""
    part = on_days(df, first, last).repartition("day")
    part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("day").parquet(path)


def untouched(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files of two inventories (path, modified): how many stayed, went and came."""
    j = before.withColumnRenamed("modified", "was").join(after.withColumnRenamed("modified", "now"), "path", "full")
    same = F.col("was") == F.col("now")
    return j.agg(F.count_if(same).alias("stayed"), F.count_if(F.col("now").isNull()).alias("went"), F.count_if(F.col("was").isNull()).alias("came"))


def file_times(df: DataFrame) -> DataFrame:
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified")).distinct()


def file_hashes(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """SHA-256 and size of each file (up to 2 GB each)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def append(df: DataFrame, path: str) -> None:
    """Naive append: n runs leave n times the rows."""
    df.write.mode("append").parquet(path)


#: Files of one commit of a guarded append.
FILES_PER_COMMIT = 10_000


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def _commit(spark: SparkSession, staged: str, final: str) -> None:
    """One rename makes a batch's manifest, and with it its data, visible."""
    at, fs = _files(spark, staged)
    if not fs.rename(at, _files(spark, final)[0]):
        raise OSError(f"{final} could not be committed")


def committed(spark: SparkSession, manifest: str) -> DataFrame | None:
    """Path, length, sha256, appended and batch of every file that was taken in; None before the first."""
    at, fs = _files(spark, f"{manifest}/batch-*")
    return spark.read.parquet(f"{manifest}/batch-*") if fs.globStatus(at) else None


def read_committed(spark: SparkSession, target: str, manifest: str) -> DataFrame:
    """The rows of committed batches; what a run that died has left is in none."""
    known = committed(spark, manifest)
    batches = [] if known is None else [r.batch for r in known.select("batch").distinct().collect()]  # one a commit
    if not batches:
        raise ValueError(f"nothing was appended to {target}")
    return spark.read.option("basePath", target).parquet(*[f"{target}/batch={b}" for b in sorted(batches)]).drop("batch")


def guarded_append(spark: SparkSession, source: str, target: str, manifest: str, reader, files_per_commit: int = FILES_PER_COMMIT) -> int:
    """Append only the source files whose content no commit has; how many there were.

    The file list stays a table; at most ``files_per_commit`` paths at a time go to ``reader(paths)``.  A batch's data is
    written under its own name first, then one rename of its manifest commits data and manifest together: a run that dies
    in between leaves nothing that ``read_committed`` reads, and the next run appends the batch anew.  Of several new
    files with the same content the first by path is appended; the manifest names them all.
    """
    found = file_hashes(spark, source)
    known = committed(spark, manifest)
    if known is not None:
        found = found.join(known.select("sha256").distinct(), "sha256", "left_anti")
    first = found.groupBy("sha256").agg(F.min("path").alias("_first"))
    listed = scratch(spark, "new-files")
    found.join(first, "sha256").withColumn("appended", F.col("path") == F.col("_first")).write.parquet(listed)
    new = spark.read.parquet(listed)
    n = 0
    paths = (r.path for r in new.where("appended").select("path").orderBy("path").toLocalIterator())
    while part := list(islice(paths, files_per_commit)):
        batch = f"batch-{uuid.uuid4().hex}"
        reader(part).write.parquet(f"{target}/batch={batch}")
        taken = new.join(spark.createDataFrame([(p,) for p in part], "_first string"), "_first", "left_semi").drop("_first")
        staged = f"{manifest}/_{batch}"
        taken.withColumn("batch", F.lit(batch)).coalesce(1).write.parquet(staged)
        _commit(spark, staged, f"{manifest}/{batch}")
        n += len(part)
    return n


def sweep_uncommitted(spark: SparkSession, target: str, manifest: str) -> int:
    """Delete what runs that died have left, while no run is under way; how many batches there were."""
    known = committed(spark, manifest)
    held = set() if known is None else {f"batch={r.batch}" for r in known.select("batch").distinct().collect()}
    at, fs = _files(spark, f"{target}/batch=*")
    gone = [s.getPath() for s in fs.globStatus(at) or [] if s.getPath().getName() not in held]
    staged = [s.getPath() for s in fs.globStatus(_files(spark, f"{manifest}/_batch-*")[0]) or []]
    for path in gone + staged:
        fs.delete(path, True)
    return len(gone)


# ---- hashes of files of any size

#: Bytes of a block of a file.
BLOCK_BYTES = 1 << 24


def block_hashes(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES, names: str = "*") -> DataFrame:
    """(path, length, block, from_byte, to_byte, sha256): files read by ranges in many tasks, whatever their size.

    Files are read as lines, of any bytes; a line belongs to the block in which it starts, so a block is its size give or
    take a line, and the same wherever the reader splits the file.  Where a line starts is the sum of the lines before
    it, within the reader's range and over the ranges before.  A leading byte order mark does not count.
    """
    text = spark.read.option("lineSep", "\n").option("pathGlobFilter", names).option("recursiveFileLookup", True).format("text").load(path)
    meta = lambda c: F.col(f"_metadata.{c}")
    lines = text.select(meta("file_path").alias("path"), meta("file_size").alias("length"), meta("file_block_start").alias("_range"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("_line"))
    lines = lines.withColumn("_bytes", F.octet_length("_line") + F.lit(1).cast("long"))
    placed = ordered_running_sum(lines, "_bytes", "_end", ["_id"], chunk="_range", keys=["path"])
    placed = placed.withColumn("_from", F.col("_end") - F.col("_bytes"))
    block = F.floor(F.col("_from") / block_bytes).cast("long")
    told = F.transform(F.array_sort(F.collect_list(F.struct("_from", "_line"))), lambda x: x["_line"])
    out = placed.groupBy("path", "length", block.alias("block")).agg(F.min("_from").alias("from_byte"), F.max("_end").alias("to_byte"), F.sha2(F.array_join(told, "\n"), 256).alias("sha256"))
    return out.withColumn("to_byte", F.least("to_byte", "length"))


def tree_hashes(blocks: DataFrame) -> DataFrame:
    """(path, length, blocks, sha256): the hash of a file's length and the hashes of its blocks in order."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("block", "sha256"))), lambda x: x["sha256"])
    return blocks.groupBy("path", "length").agg(F.count("*").alias("blocks"), F.sha2(F.concat_ws(",", F.col("length").cast("string"), in_order), 256).alias("sha256"))


def changed_blocks(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, block, from_byte, to_byte) of the blocks that differ or are on one side only."""
    values = ["from_byte", "to_byte", "sha256"]
    b, a = (x.select("path", "block", *[F.col(c).alias(f"_{side}_{c}") for c in values]) for x, side in ((before, "b"), (after, "a")))
    j = b.join(a, ["path", "block"], "full").where(~F.col("_b_sha256").eqNullSafe(F.col("_a_sha256")))
    return j.select("path", "block", F.least("_b_from_byte", "_a_from_byte").alias("from_byte"), F.greatest("_b_to_byte", "_a_to_byte").alias("to_byte"))


def manifest_row(df: DataFrame, source: DataFrame) -> DataFrame:
    """Files, bytes and a joint hash of the source beside rows and partitions of the layer."""
    joint = F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("sha256"))), 256)
    s = source.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), joint.alias("sha256"))
    return s.crossJoin(df.agg(F.count("*").alias("rows"), F.count_distinct("day").alias("partitions")))


def with_empty_days(days: DataFrame, first: str, last: str) -> DataFrame:
    """Every calendar day, with zero readings where there was no input."""
    spark = days.sparkSession
    span = spark.sql(f"SELECT explode(sequence(DATE '{first}', DATE '{last}')) AS day")
    return span.join(days, "day", "left").fillna(0)
