"""Gold tables: by day, by hour, by failure report, by month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from telemill.functions import round_half, trunc_ts
from telemill.operators.grading import event_days


def daily_cycle(silver: DataFrame, slots_of_day: int, ts: str = "timestamp", keys: list[str] | None = None) -> DataFrame:
    """From a resampled record: readings, percent of the day's slots, complete, loaded hours, starts within the day, mean oil, doubtful slots."""
    keys = keys or []
    m = silver.where("measured").withColumn("_was", F.lag("dv").over(W.partitionBy(*keys, "day").orderBy(ts)))
    out = m.groupBy(*keys, "day").agg(
        F.sum("readings").alias("readings"), F.count("*").alias("_slots"), F.count_if(F.col("dv") == 1).alias("_loaded"),
        F.count_if((F.col("_was") == 0) & (F.col("dv") == 1)).alias("starts"), F.avg("oil").alias("_oil"), F.count_if("doubtful").alias("doubtful"),
    )
    full = F.lit(float(slots_of_day))
    return out.select(
        *keys, "day", "readings", round_half(F.col("_slots") * F.lit(100.0) / full, 2).alias("percent"), (F.col("_slots") > 0.9 * slots_of_day).alias("complete"),
        round_half(F.col("_loaded") * F.lit(24.0) / full, 3).alias("loaded_hours"), "starts", round_half("_oil", 3).alias("mean_oil"), "doubtful",
    )


def hours(silver: DataFrame, slow: DataFrame, ts: str = "timestamp", keys: list[str] | None = None) -> DataFrame:
    """Hourly oil and duty beside a slow source (hour, street) that all machines share, and the difference."""
    h = silver.where("measured").groupBy(*(keys or []), trunc_ts("hour", ts).alias("hour")).agg(round_half(F.avg("oil"), 3).alias("oil"), round_half(F.avg("dv"), 6).alias("duty"), F.sum("readings").alias("readings"))
    return h.join(slow, "hour").withColumn("oil_over_street", round_half(F.col("oil") - F.col("street"), 3))


def failures(reports: DataFrame, days: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Reports beside what the machine did on their days; a report without data keeps its row."""
    keys = keys or []
    j = event_days(reports).join(days, [*keys, "day"], "left")
    out = j.groupBy(*keys, "nr", "began", "ended", "failure").agg(F.count("readings").alias("days_with_data"), F.sum("loaded_hours").alias("_l"), F.sum("starts").alias("starts"), F.avg("mean_oil").alias("_o"))
    hours_of = (F.unix_timestamp(F.col("ended").cast("timestamp")) - F.unix_timestamp(F.col("began").cast("timestamp"))) / F.lit(3600.0)
    return out.select(*keys, "nr", "began", "ended", round_half(hours_of, 2).alias("report_hours"), "failure", "days_with_data", round_half("_l", 3).alias("loaded_hours"), "starts", round_half("_o", 3).alias("mean_oil"))


def monthly(hours: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return hours.groupBy(*(keys or []), F.date_format("hour", "yyyy-MM").alias("month")).agg(F.count("*").alias("hours"), round_half(F.avg("oil"), 3).alias("oil"), round_half(F.avg("street"), 3).alias("street"))


def day_dimension(silver: DataFrame, minutes_per_slot: float, keys: list[str] | None = None) -> DataFrame:
    """Every calendar day of the record, with zero for days without readings."""
    return silver.groupBy(*(keys or []), "day").agg(F.sum("readings").alias("readings"), round_half(F.coalesce(F.sum("dv"), F.lit(0.0)) * F.lit(minutes_per_slot / 60), 3).alias("loaded_hours"))
