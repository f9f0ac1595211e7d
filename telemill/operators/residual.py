"""Hourly duty as an anomaly residual, its noise floor and baseline, and minute curves of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from telemill.functions import frame_median, round_half, trunc_ts
from telemill.operators.quantiles import quantiles
from telemill.operators.ranks import trailing


def hourly_residual(df: DataFrame, state: str, delivery: float, consumption: float, least: int, ts: str = "timestamp", keys: list[str] | None = None) -> DataFrame:
    """residual = mean state * delivery - consumption, for hours with enough readings; other hours are unknown, not zero."""
    out = df.groupBy(*(keys or []), trunc_ts("hour", ts).alias("hour")).agg(F.avg(state).alias("_m"), F.count("*").alias("readings")).where(F.col("readings") >= least)
    return out.select(*(keys or []), "hour", F.to_date("hour").alias("day"), "readings", round_half("_m", 6).alias("duty"), round_half(F.col("_m") * F.lit(delivery) - F.lit(consumption), 6).alias("residual"))


def daily_peaks(hours: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Peak of the day and the first hour that reaches it."""
    p = hours.groupBy(*(keys or []), "day").agg(F.max(F.struct(F.col("residual"), (-F.unix_timestamp(F.col("hour").cast("timestamp"))).alias("h"))).alias("p"), F.count("*").alias("hours"))
    return p.select(*(keys or []), "day", F.col("p.residual").alias("peak"), F.timestamp_seconds(-F.col("p.h")).cast("timestamp_ntz").alias("peak_hour"), "hours")


def with_baseline(days: DataFrame, frame: int = 14, keys: list[str] | None = None) -> DataFrame:
    """Median of the peaks of the days before, and the deviation from it; a long series is cut into blocks."""
    out = trailing(days, "day", frame, {"baseline": frame_median("peak")}, keys).withColumn("baseline", round_half("baseline", 6))
    return out.withColumn("deviation", round_half(F.col("peak") - F.col("baseline"), 6))


def noise_floor(hours: DataFrame, first: str, last: str, keys: list[str] | None = None) -> DataFrame:
    h = hours.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    shares = {"median": 0.5, "p95": 0.95, "p99": 0.99}
    q = quantiles(h, {n: (F.col("residual"), p) for n, p in shares.items()}, [F.count("*").alias("hours"), F.max("residual").alias("high")], keys)
    return q.select(*(keys or []), "hours", *[round_half(n, 6).alias(n) for n in shares], "high")


def minute_curve(df: DataFrame, state: str, every: int = 1, ts: str = "timestamp", keys: list[str] | None = None) -> DataFrame:
    """Loaded and recorded minutes of each day by minutes of the day, zero where nothing is recorded; ``every`` divides 1440."""
    days = [*(keys or []), "day"]
    minute = F.hour(ts) * 60 + F.minute(ts)
    per_minute = df.groupBy(*days, minute.alias("minute")).agg(F.max(state).cast("long").alias("loaded"), F.lit(1).cast("long").alias("recorded"))
    slots = F.explode(F.sequence(F.lit(0), F.lit(1439))).alias("minute")
    full = df.select(*days).distinct().select(*days, slots).join(per_minute, [*days, "minute"], "left").fillna(0, ["loaded", "recorded"])
    return full.groupBy(*days, F.floor(F.col("minute") / every).alias("slot")).agg(F.sum("loaded").alias("loaded"), F.sum("recorded").alias("recorded"))


def cumulative(curve: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    w = W.partitionBy(*(keys or []), "day").orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    for c in columns:
        curve = curve.withColumn(f"{c}_so_far", F.sum(c).over(w))
    return curve


def carry_free(curve: DataFrame, value: str, scale: float, keys: list[str] | None = None) -> DataFrame:
    """Scaled whole numbers whose running sum is the rounded running sum: the rounding never adds up."""
    w = W.partitionBy(*(keys or []), "day").orderBy("slot")
    run = F.bround(F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)) * F.lit(scale), 0)
    out = curve.withColumn("_run", run)
    return out.withColumn("whole", (F.col("_run") - F.coalesce(F.lag("_run").over(w), F.lit(0.0))).cast("long")).drop("_run")


def record_gaps(curve: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Runs of slots of a day without a recorded minute: from, to (exclusive)."""
    days = [*(keys or []), "day"]
    empty = curve.where("recorded = 0")
    run = empty.withColumn("_g", F.col("slot") - F.row_number().over(W.partitionBy(*days).orderBy("slot")))
    return run.groupBy(*days, "_g").agg(F.min("slot").alias("from_slot"), (F.max("slot") + 1).alias("to_slot")).drop("_g")


def healthy_band(curve: DataFrame, delivery: float, consumption: float, floor: float, keys: list[str] | None = None) -> DataFrame:
    """By slot of a day the most loaded minutes so far that a healthy machine needs for the recorded ones."""
    most = F.col("recorded_so_far") * F.lit(consumption + floor) / F.lit(delivery)
    return cumulative(curve, ["recorded"], keys).select(*(keys or []), "day", "slot", round_half(most, 3).alias("most"))
