"""Regular grid from irregular readings: nothing is lost, holes and contradictions stay visible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions import bucket, epoch_seconds, round_half


def slot_grid(df: DataFrame, ts: str, step: int, keys: list[str] | None = None) -> DataFrame:
    """Every slot from the first reading's to the last one's (per key), generated in parallel."""
    keys = keys or []
    lo, hi = epoch_seconds(bucket(F.min(ts), step)), epoch_seconds(bucket(F.max(ts), step))
    span = df.groupBy(*keys).agg(lo.alias("_lo"), hi.alias("_hi"))
    # a day's slots at a time, so that no single row explodes into the whole grid
    days = span.withColumn("_d", F.explode(F.sequence(F.floor(F.col("_lo") / 86400), F.floor(F.col("_hi") / 86400))))
    a, b = F.greatest("_lo", F.col("_d") * 86400), F.least("_hi", F.col("_d") * 86400 + 86399)
    a = a + F.pmod(F.col("_lo") - a, F.lit(step))
    days = days.withColumn("_a", a).withColumn("_b", b).where("_a <= _b")
    slots = days.withColumn("_s", F.explode(F.sequence("_a", "_b", F.lit(step).cast("bigint"))))
    return slots.select(*keys, F.timestamp_seconds("_s").cast("timestamp_ntz").alias("slot"))


def resample(df: DataFrame, ts: str = "timestamp", step: int = 10, avg_cols: list[str] | None = None, max_cols: list[str] | None = None, doubtful: Column | None = None, keys: list[str] | None = None, digits: int = 3) -> DataFrame:
    """One row per slot: count of merged readings, measured and doubtful flags, means of analogue and maxima of digital signals.

    Slots without a reading have null signals and measured = false; a slot is doubtful when any of its readings is.
    """
    keys, avg_cols, max_cols = keys or [], avg_cols or [], max_cols or []
    doubt = F.max(doubtful) if doubtful is not None else F.lit(False)
    merged = df.groupBy(*keys, bucket(ts, step).alias("slot")).agg(
        F.count("*").alias("readings"),
        doubt.alias("doubtful"),
        *[round_half(F.avg(c), digits).alias(c) for c in avg_cols],
        *[F.max(c).alias(c) for c in max_cols],
    )
    out = slot_grid(df, ts, step, keys).join(merged, [*keys, "slot"], "left")
    return out.select(
        *keys,
        F.col("slot").alias(ts),
        F.to_date("slot").alias("day"),
        F.coalesce("readings", F.lit(0).cast("long")).alias("readings"),
        F.col("readings").isNotNull().alias("measured"),
        F.coalesce("doubtful", F.lit(False)).alias("doubtful"),
        *avg_cols,
        *max_cols,
    )


def conservation(grid: DataFrame, raw: DataFrame, ts: str, step: int) -> DataFrame:
    """One row: readings on the grid and in the record, slots and expected slots, and whether both agree."""
    g = grid.agg(F.sum("readings").alias("kept"), F.count("*").alias("slots"))
    w = raw.agg(F.count("*").alias("readings"), ((epoch_seconds(bucket(F.max(ts), step)) - epoch_seconds(bucket(F.min(ts), step))) / step + 1).cast("long").alias("expected"))
    return g.crossJoin(w).withColumn("conserved", (F.col("kept") == F.col("readings")) & (F.col("slots") == F.col("expected")))
