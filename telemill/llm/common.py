"""What the text operators share: scratch tables, row keys and joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.sources.scratch import scratch

#: A group is heavy when it holds more than one row in so many; there are at most so many of them.
HEAVY_SHARE = 1000


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(saved: DataFrame) -> None:
    """Delete a table that save returned, once all that is made of it is written itself."""
    spark = saved.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(saved.saved_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """Left join of rows to one row per key, safe against keys that hold a large share of the rows.

    Groups with more than total/HEAVY_SHARE rows number fewer than HEAVY_SHARE, so they are broadcast, and
    their rows are dealt out by ``spread`` in the shuffled join that serves all the others.
    """
    values = [c for c in groups.columns if c != key]
    is_heavy = F.col(size) * HEAVY_SHARE > total
    heavy = groups.where(is_heavy).select(F.col(key).alias("_hk"), F.struct(*values).alias("_heavy"))
    light = groups.where(~is_heavy).select(F.col(key).alias("_lk"), F.struct(*values).alias("_light"))
    out = rows.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left")
    out = out.withColumn("_jk", F.when(F.col("_hk").isNull(), F.col(key)).otherwise(spread))
    out = out.join(light, F.col("_jk") == F.col("_lk"), "left")
    found = F.coalesce("_heavy", "_light")
    return out.select(*[F.col(c) for c in rows.columns], *[found[c].alias(c) for c in values])
