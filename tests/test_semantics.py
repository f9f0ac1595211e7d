"""Scalar helpers and ordered windows on small literal frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from telemill.functions import bit_distance, boundary_diff, bucket, epoch_seconds, frame_median, round_half, trunc_ts, upper_median
from telemill.operators.windows import islands, ordered_lag, ordered_running_sum, segments

T = dt.datetime


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def at(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(("value", "digits", "want"), [(2.675, 2, 2.68), (0.125, 2, 0.13), (-0.125, 2, -0.13), (-0.001, 2, 0.0), (1.0, 0, 1.0), (4.2044999999999995, 3, 4.205)])
def test_round_half(spark, value, digits, want):
    got = one(spark, round_half(F.lit(value), digits))
    assert got == want and str(got) != "-0.0"


def test_boundary_diff_counts_boundaries(spark):
    assert one(spark, boundary_diff("second", at("2024-01-01 00:00:00.9"), at("2024-01-01 00:00:01.1"))) == 1
    assert one(spark, boundary_diff("minute", at("2024-01-01 00:00:59"), at("2024-01-01 00:01:00"))) == 1
    assert one(spark, boundary_diff("hour", at("2024-01-01 00:01:00"), at("2024-01-01 00:59:00"))) == 0


def test_bucket_origin(spark):
    assert one(spark, bucket(at("2024-01-01 00:00:09.5"), 10)) == T(2024, 1, 1)
    seven = one(spark, bucket(at("2024-01-01 00:00:09"), 7, "2000-01-03 00:00:00"))
    assert (seven - T(2000, 1, 3)).total_seconds() % 7 == 0 and seven <= T(2024, 1, 1, 0, 0, 9)
    assert one(spark, bucket(at("1969-12-31 23:59:55"), 10)) == T(1969, 12, 31, 23, 59, 50)


def test_trunc_keeps_zone_free(spark):
    df = spark.range(1).select(trunc_ts("hour", at("2024-01-01 10:59:59.9")).alias("x"))
    assert dict(df.dtypes)["x"] == "timestamp_ntz" and df.first().x == T(2024, 1, 1, 10)
    assert one(spark, epoch_seconds(at("1970-01-01 00:00:01.9"))) == 1


def test_upper_median_is_no_mean(spark):
    df = spark.createDataFrame([(x,) for x in (4, 1, 3, 2)], "x int")
    assert df.agg(upper_median("x").alias("m")).first().m == 3
    assert df.agg(F.median("x").alias("m")).first().m == 2.5
    assert df.where("x > 9").agg(upper_median("x").alias("m")).first().m is None


def test_frame_median(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate((5, 1, 9, 3))], "i int, x double")
    w = W.orderBy("i").rowsBetween(-2, -1)
    assert [r.m for r in df.withColumn("m", frame_median("x").over(w)).orderBy("i").collect()] == [None, 5.0, 3.0, 5.0]


def test_bit_distance(spark):
    assert one(spark, bit_distance(F.lit("0" * 64), F.lit("f" * 64))) == 256
    assert one(spark, bit_distance(F.lit("0" * 63 + "1"), F.lit("0" * 63 + "3"))) == 1


@pytest.fixture
def record(spark):
    """Days 1, 2 and 4 (day 3 is absent); two readings at the same time; one machine with a null id."""
    rows = [(1, T(2024, 1, 1, 0, 0), 0.0, 8.0, 1), (2, T(2024, 1, 1, 23, 59), 1.0, 9.0, 1), (3, T(2024, 1, 2, 0, 1), 1.0, 10.0, None), (4, T(2024, 1, 2, 0, 1), 0.0, 7.0, 1), (5, T(2024, 1, 4, 5, 0), 0.0, 6.0, None), (6, T(2024, 1, 4, 5, 1), 1.0, 6.5, 1)]
    return spark.createDataFrame(rows, "id int, ts timestamp_ntz, state double, value double, machine int").withColumn("day", F.to_date("ts"))


@pytest.mark.parametrize("keys", [[], ["machine"]])
def test_ordered_lag_equals_one_window(record, keys):
    w = W.partitionBy(*keys).orderBy("ts", "id") if keys else W.orderBy("ts", "id")
    want = {r.id: (r.a, r.b) for r in record.select("id", F.lag("state").over(w).alias("a"), F.lag("ts").over(w).alias("b")).collect()}
    got = {r.id: (r.a, r.b) for r in ordered_lag(record, {"state": "a", "ts": "b"}, ["ts", "id"], keys=keys).collect()}
    assert got == want


@pytest.mark.parametrize("keys", [[], ["machine"]])
def test_running_sum_equals_one_window(record, keys):
    w = (W.partitionBy(*keys) if keys else W.partitionBy()).orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0)
    want = {r.id: r.s for r in record.select("id", F.sum("state").over(w).alias("s")).collect()}
    assert {r.id: r.s for r in ordered_running_sum(record, "state", "s", ["ts", "id"], keys=keys).collect()} == want


def test_segments_by_hand(record):
    got = segments(record, "state", "value", 900, ["ts", "id"], minutes_per_reading=10).orderBy("segment").collect()
    assert [(r.state, r.readings, r.broken, r.first_value, r.last_value, r.counted_minutes) for r in got] == [
        (0.0, 1, False, 8.0, 8.0, 0.0), (1.0, 2, False, 9.0, 10.0, 10.0), (0.0, 2, True, 7.0, 6.0, 10.0), (1.0, 1, False, 6.5, 6.5, 0.0),
    ]


def test_empty_record(record):
    none = record.where("id = 0")
    assert ordered_lag(none, {"state": "a"}, ["ts", "id"]).count() == 0
    assert segments(none, "state", "value", 900, ["ts", "id"]).count() == 0


def test_islands(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 2, 4, 7, 8, 9)], "day date")
    got = sorted((r.first_day.day, r.last_day.day, r.days) for r in islands(days).collect())
    assert got == [(1, 2, 2), (4, 4, 1), (7, 9, 3)]
