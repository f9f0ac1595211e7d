"""Telemetry views of event tables: the adapter all operators and their SQL start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: slot in seconds, slots of a full day, seconds of a broken gap, least readings of an hour
SLOT, FULL_DAY, BROKEN_GAP, MIN_READINGS = 600, 144, 900, 8
DELIVERY, CONSUMPTION = 1.2507, 0.0711
HEALTHY = ("2024-01-01", "2024-01-10")
REPORTS = [
    ("#1", "1/5/2024 0:00", "1/5/2024 23:59", "Air leak"),
    ("#1", "1/12/2024 23:30", "1/13/2024 6:00", "Air Leak"),
    ("#3", "1/18/2024 10:00", "1/20/2024 14:30", "Air Leak"),
    ("#4", "1/26/2024 14:30", "1/26/2024 19:00", "Air Leak"),
]
#: the same views for SQL
TEL_SQL = """tel AS (SELECT event_id, user_id, event_type, ts AS timestamp, CAST(ts AS DATE) AS day, value AS pressure, value / 10 AS oil, value AS current,
  CASE WHEN event_type IN ('error', 'purchase') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS dv, CASE WHEN event_type IN ('view', 'click') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS comp,
  CASE WHEN event_type = 'error' AND value > 250 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lps FROM events)"""
REP_SQL = """rep AS (SELECT nr, strptime(a, '%-m/%-d/%Y %-H:%M') AS began, strptime(b, '%-m/%-d/%Y %-H:%M') AS ended, failure FROM (VALUES
  ('#1','1/5/2024 0:00','1/5/2024 23:59','Air leak'), ('#1','1/12/2024 23:30','1/13/2024 6:00','Air Leak'),
  ('#3','1/18/2024 10:00','1/20/2024 14:30','Air Leak'), ('#4','1/26/2024 14:30','1/26/2024 19:00','Air Leak')) v(nr, a, b, failure))"""


def flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of the event table, with the columns of a compressor's record."""
    kind, value = F.col("event_type"), F.col("value")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "user_id", "event_type", F.col("ts").alias("timestamp"), F.to_date("ts").alias("day"),
        value.alias("pressure"), (value / 10).alias("oil"), value.alias("current"),
        flag(kind.isin("error", "purchase")).alias("dv"), flag(kind.isin("view", "click")).alias("comp"), flag((kind == "error") & (value > 250)).alias("lps"),
    )


def reports(spark: SparkSession) -> DataFrame:
    """Failure reports; text dates become timestamps, the errata stay."""
    text = spark.createDataFrame(REPORTS, "nr string, start_time string, end_time string, failure string")
    at = lambda c: F.to_timestamp_ntz(F.col(c), F.lit("M/d/yyyy H:mm"))
    return text.select("nr", at("start_time").alias("began"), at("end_time").alias("ended"), "failure")
