"""Fingerprints and comparisons of tables and results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.functions.canonical import MODULUS, row_hash
from telemill.sources.scratch import scratch


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and sum of row hashes: the same for the same rows in any order, files or partitions."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("hash_sum"))


def portable_fingerprint(df: DataFrame) -> DataFrame:
    """As fingerprint, by row hashes that another engine can check: their sum modulo 2^61 - 1."""
    total = F.pmod(F.sum(row_hash(df).cast("decimal(38,0)")), F.lit(MODULUS).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("rows"), F.coalesce(total, F.lit(0)).cast("bigint").alias("hash_sum"))


def semantic_fingerprint(df: DataFrame, sums: list[str], condition: Column, day: str = "day") -> DataFrame:
    """Count, filtered count, rounded sums and distinct days."""
    return df.agg(F.count("*").alias("rows"), F.count_if(condition).alias("filtered"), *[F.round(F.sum(c), 2).alias(f"sum_{c}") for c in sums], F.count_distinct(day).alias("days"))


def compare_fingerprints(before: DataFrame, after: DataFrame, key: str = "table") -> DataFrame:
    """By table: whether all values are the same, null-safe; tables on one side only are not."""
    values = [c for c in before.columns if c != key]
    j = before.alias("b").join(after.alias("a"), key, "full")
    same = reduce(lambda x, y: x & y, [F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) for c in values])
    return j.select(key, same.alias("same"))


#: Buckets of keys of a first look, and how often those that differ are cut into as many again.
BUCKETS, LOOKS = 1024, 2


def _told(c: str, kind: T.DataType) -> Column:
    """A value to hash: zeros of both signs are one."""
    return F.col(c) + F.lit(0.0) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(c)


def _hashes(df: DataFrame) -> list[Column]:
    """Two hashes of a row with its nulls marked: engines skip nulls in hashes, so a value could move to its neighbour."""
    nulls = F.concat(*[F.col(c).isNull().cast("string") for c in df.columns])
    values = [_told(c, df.schema[c].dataType) for c in df.columns]
    return [F.xxhash64(F.lit(seed), nulls, *values) for seed in (1, 2)]


def _in_buckets(df: DataFrame, keys: list[str], look: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(100 + look), *[_told(k, df.schema[k].dataType) for k in keys]), F.lit(buckets))


def bucket_prints(df: DataFrame, bucket: list[str]) -> DataFrame:
    """Rows and order-free sums of both row hashes by bucket; repeated rows count as often as they stand there."""
    one, two = _hashes(df.drop(*bucket))
    total = lambda h: F.sum(h.cast("decimal(38,0)"))
    return df.groupBy(*bucket).agg(F.count("*").alias("_n"), total(one).alias("_h1"), total(two).alias("_h2"))


def suspects(a: DataFrame, b: DataFrame, keys: list[str] | None = None, buckets: int = BUCKETS, looks: int = LOOKS) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides in buckets of keys whose fingerprints differ, all others left where they are.

    Each look reads both sides and shuffles one row per bucket and task; the next one cuts only the buckets that differ,
    of which there are at most ``buckets`` times those before, so what is broadcast has that bound.
    """
    b = b.select(*a.columns)
    keys = keys or a.columns
    sides, marks = [a, b], []
    for look in range(looks):
        marks.append(f"_bucket{look}")
        sides = [x.withColumn(marks[-1], _in_buckets(a, keys, look, buckets)) for x in sides]
        left, right = (bucket_prints(x, marks) for x in sides)
        other = right.select(*[F.col(c).alias(f"_r{c}") for c in right.columns])
        same = [F.col(m) == F.col(f"_r{m}") for m in marks]
        values = ["_n", "_h1", "_h2"]
        off = left.join(other, same, "full").where(~reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in values]))
        off = off.select(*[F.coalesce(F.col(m), F.col(f"_r{m}")).alias(m) for m in marks])
        path = scratch(a.sparkSession, "buckets")
        off.write.parquet(path)
        off = a.sparkSession.read.schema(off.schema).parquet(path)
        few = off.count() <= buckets * MOST_BROADCAST
        sides = [x.join(F.broadcast(off) if few else off, marks, "left_semi") for x in sides]
    return tuple(x.drop(*marks) for x in sides)


#: Buckets that differ are broadcast up to so many for each bucket of a look.
MOST_BROADCAST = 64


def differing_rows(a: DataFrame, b: DataFrame, keys: list[str] | None = None, buckets: int = BUCKETS, looks: int = LOOKS) -> DataFrame:
    """The rows that one side has more often: their columns, only_left and only_right, as often as exceptAll gives them."""
    left, right = suspects(a, b, keys, buckets, looks)
    signed = left.withColumn("_sign", F.lit(1)).unionByName(right.withColumn("_sign", F.lit(-1)))
    out = signed.groupBy(*a.columns).agg(F.sum("_sign").alias("_more")).where("_more <> 0")
    return out.select(*a.columns, F.greatest("_more", F.lit(0)).alias("only_left"), F.greatest(-F.col("_more"), F.lit(0)).alias("only_right"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows that only one side has, with their multiplicity, whatever the order."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return differing_rows(a, b).agg(total("only_left"), total("only_right"))


def compare_aggregates(a: DataFrame, b: DataFrame, columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """By column: sums and distinct counts of both sides, equal within a relative tolerance; one pass over each."""

    def told(df: DataFrame, side: str) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_v")) for c in columns])
        values = df.select(F.inline(rows)).groupBy("column", "_v").agg(F.sum("_v").alias("_s"))
        return values.groupBy("column").agg(F.sum("_s").alias(f"sum_{side}"), F.count("_v").alias(f"distinct_{side}"))

    j = told(a, "a").join(told(b, "b"), "column")
    near = F.abs(F.col("sum_a") - F.col("sum_b")) <= tolerance * F.greatest(F.abs("sum_b"), F.lit(1.0))
    return j.withColumn("same", near & (F.col("distinct_a") == F.col("distinct_b")))


def missing_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select("path").join(after.select("path"), "path", "left_anti")


def version_diff(old: DataFrame, new: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """Keys whose value changed most between two versions; buckets of keys without a change are not joined.

    Where fewer than k keys changed, keys that did not follow in their order.
    """

    def moved(was: DataFrame, now: DataFrame) -> DataFrame:
        j = was.select(key, F.col(value).alias("old")).join(now.select(key, F.col(value).alias("new")), key)
        return j.withColumn("change", F.col("new") - F.col("old"))

    changed = moved(*suspects(old.select(key, value), new.select(key, value), [key])).where("change <> 0")
    enough = changed.limit(k).count() == k
    return (changed if enough else moved(old, new)).orderBy(F.abs("change").desc(), key).limit(k)


def disagreements(a: DataFrame, b: DataFrame, keys: list[str], counts: list[str], near: dict[str, float] | None = None) -> DataFrame:
    """Rows of two result tables that differ in a count, or in a value by more than its tolerance; empty when they agree."""
    j = a.alias("a").join(b.alias("b"), keys, "full")
    off = [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in counts]
    off += [F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) > t, F.lit(True)) for c, t in (near or {}).items()]
    return j.where(reduce(lambda x, y: x | y, off)).select(*keys)
