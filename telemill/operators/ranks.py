"""Ranks and trailing frames of a whole table without a window that holds it in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from telemill.sources.scratch import scratch

#: Days of a block of the calendar, and rows of a block of ranks.
BLOCK_DAYS, BLOCK_ROWS = 4096, 4096


def _offsets(counts: DataFrame, part: str, keys: list[str]) -> DataFrame:
    """(keys, part, _offset): the rows of the parts before, for one count per part.  Parts are few; those of a key meet in one row."""
    sums = F.aggregate(
        F.array_sort(F.collect_list(F.struct(F.col(part).alias("p"), F.col("_count").alias("n")))),
        F.struct(F.lit(0).cast("long").alias("so_far"), F.array().cast(f"array<struct<p:{counts.schema[part].dataType.simpleString()},o:bigint>>").alias("out")),
        lambda acc, x: F.struct((acc["so_far"] + x["n"]).alias("so_far"), F.concat(acc["out"], F.array(F.struct(x["p"].alias("p"), acc["so_far"].alias("o")))).alias("out")),
        lambda acc: acc["out"],
    )
    told = counts.groupBy(*keys).agg(sums.alias("_s")).select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.inline("_s"))
    return told.select(*[f"_o_{k}" for k in keys], F.col("p").alias("_o_part"), F.col("o").alias("_offset"))


def offset_of_parts(counts: DataFrame, part: str) -> DataFrame:
    """Adds _offset, the sum of ``_count`` over the parts before."""
    return _with_offset(counts, counts, part, [])


def _with_offset(rows: DataFrame, counts: DataFrame, part: str, keys: list[str]) -> DataFrame:
    same = [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys] + [F.col(part).eqNullSafe(F.col("_o_part"))]
    return rows.join(_offsets(counts, part, keys), reduce(lambda a, b: a & b, same), "left").drop("_o_part", *[f"_o_{k}" for k in keys])


def global_rank(df: DataFrame, order: list[str | Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """Adds the row's number, from 1 on, in an order of the whole table; ``order`` should end with something unique.

    Rows are dealt out by ranges of the order and written, numbered within their range, and the sizes of the ranges
    before are added.  The written table fixes the ranges, so a lost executor can't move a row to another one.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ordered = df.select("*", *[c.alias(f"_by{i}") for i, c in enumerate(cols)])
    by = [F.col(f"_by{i}") for i in range(len(cols))]
    path = scratch(spark, "ranges")
    ordered.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    held = spark.read.parquet(path)
    numbered = held.withColumn("_row", F.row_number().over(W.partitionBy("_part").orderBy(*by)).cast("long"))
    out = _with_offset(numbered, held.groupBy("_part").agg(F.count("*").alias("_count")), "_part", [])
    return out.withColumn(name, F.col("_row") + F.col("_offset")).drop("_row", "_offset", "_part", *[f"_by{i}" for i in range(len(cols))])


def same_order(df: DataFrame, a: str, b: str, tie: str) -> DataFrame:
    """One row: how many rows there are, and how many stand elsewhere when ordered by b than by a (ties by ``tie``)."""
    first = global_rank(df.select(a, b, tie), [a, tie], "_ra")
    both = global_rank(first, [b, tie], "_rb")
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("_ra") != F.col("_rb")).alias("moved"))


def trailing(df: DataFrame, day: str, frame: int, aggs: dict[str, Column], keys: list[str] | None = None, block_rows: int = BLOCK_ROWS, block_days: int = BLOCK_DAYS) -> DataFrame:
    """Adds aggregates over the ``frame`` rows of a key before each row, in order of a day that is unique within the key.

    Rows are numbered within blocks of the calendar, the sizes of the blocks before are added, and equal blocks of these
    numbers are windowed, each with a copy of the ``frame`` rows before it (its halo): a long series is many tasks.
    """
    keys = keys or []
    block_rows = max(block_rows, frame)
    x = df.withColumn("_block", F.floor(F.datediff(F.col(day), F.lit("1970-01-01").cast("date")) / block_days).cast("long"))
    numbered = x.withColumn("_row", F.row_number().over(W.partitionBy(*keys, "_block").orderBy(day)) - 1)
    counts = x.groupBy(*keys, "_block").agg(F.count("*").alias("_count"))
    ranked = _with_offset(numbered, counts, "_block", keys).withColumn("_rank", F.col("_row") + F.col("_offset")).drop("_row", "_offset", "_block")
    own = F.floor(F.col("_rank") / block_rows).cast("long")
    late = F.pmod(F.col("_rank"), F.lit(block_rows)) >= block_rows - frame
    places = F.when(late, F.array(F.struct(own.alias("_b"), F.lit(False).alias("_halo")), F.struct((own + 1).alias("_b"), F.lit(True).alias("_halo")))).otherwise(F.array(F.struct(own.alias("_b"), F.lit(False).alias("_halo"))))
    dealt = ranked.select("*", F.inline(places))
    w = W.partitionBy(*keys, "_b").orderBy("_rank").rowsBetween(-frame, -1)
    return dealt.select("*", *[c.over(w).alias(n) for n, c in aggs.items()]).where("not _halo").drop("_rank", "_b", "_halo")
