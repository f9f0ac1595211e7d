"""Profiles of a record: columns, completeness, sampling, gaps, states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions import boundary_diff, round_half, upper_median
from telemill.operators.windows import ordered_lag


def profile_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """signal, n_distinct, low, high: values become rows and are combined where they are read, whatever the number of columns."""
    rows = F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).alias("_v")) for c in columns])
    values = df.select(F.inline(rows)).groupBy("signal", "_v").agg(F.lit(1).alias("_one"))
    return values.groupBy("signal").agg(F.count("_v").alias("n_distinct"), F.min("_v").alias("low"), F.max("_v").alias("high"))


def datasheet(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Signals whose distinct values say digital (two or fewer) or analogue, against what is declared."""
    kinds = F.create_map(*[F.lit(x) for kv in declared.items() for x in kv])
    found = profile_columns(df, list(declared))
    found = found.withColumn("found", F.when(F.col("n_distinct") <= 2, "digital").otherwise("analogue")).withColumn("declared", kinds[F.col("signal")])
    return found.withColumn("agrees", F.col("found") == F.col("declared"))


def noise_census(df: DataFrame, columns: list[str], digits: int = 3) -> DataFrame:
    """Values that are not multiples of the last digit, by column, in one pass."""
    noisy = [F.count_if(F.col(c) != round_half(c, digits)).alias(c) for c in columns]
    rows = F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).alias("noisy")) for c in columns])
    return df.agg(*noisy).select(F.inline(rows))


def completeness(df: DataFrame, full: int, day: str = "day", keys: list[str] | None = None) -> DataFrame:
    """Readings per day, percent of a full day, complete (over 90 %), brimming (over 100 %), nearly empty (under 10 %)."""
    out = df.groupBy(*(keys or []), day).agg(F.count("*").alias("readings"))
    percent = F.col("readings") * F.lit(100.0) / F.lit(float(full))
    return out.withColumn("percent", round_half(percent, 2)).withColumn("complete", percent > 90).withColumn("brimming", percent > 100).withColumn("nearly_empty", percent < 10)


def completeness_summary(days: DataFrame) -> DataFrame:
    return days.agg(F.count("*").alias("days"), F.count_if("complete").alias("complete"), F.count_if("brimming").alias("brimming"), F.count_if("nearly_empty").alias("nearly_empty"), upper_median("readings").alias("typical"))


def gaps(df: DataFrame, order: list[str], unit: str = "second", chunk: str = "day", keys: list[str] | None = None) -> DataFrame:
    """The record with the gap before each reading (null at its start)."""
    out = ordered_lag(df, {order[0]: "previous_ts"}, order, chunk, keys)
    return out.withColumn("gap", boundary_diff(unit, "previous_ts", order[0]))


def sampling(df: DataFrame, order: list[str], unit: str = "second", chunk: str = "day", keys: list[str] | None = None) -> DataFrame:
    """The most frequent gap (the shortest of equals), the number and the share of other gaps."""
    n = gaps(df, order, unit, chunk, keys).where("gap is not null").groupBy(*(keys or []), "gap").agg(F.count("*").alias("n"))
    best = F.max(F.struct(F.col("n"), (-F.col("gap")).alias("g")))
    out = n.groupBy(*(keys or [])).agg(best.alias("b"), F.sum("n").alias("total"))
    irregular = F.col("total") - F.col("b.n")
    return out.select(*(keys or []), (-F.col("b.g")).alias("period"), irregular.alias("irregular"), F.col("total").alias("gaps"), round_half(F.try_divide(irregular * F.lit(1.0), F.col("total")), 6).alias("share"))


def duty_cycle(df: DataFrame, state: str, minutes_per_reading: float, day: str = "day", keys: list[str] | None = None) -> DataFrame:
    """Readings, loaded readings, loaded hours and percent by day."""
    out = df.groupBy(*(keys or []), day).agg(F.count("*").alias("readings"), F.count_if(F.col(state) == 1).alias("loaded"))
    return out.withColumn("loaded_hours", round_half(F.col("loaded") * F.lit(minutes_per_reading / 60), 3)).withColumn("percent", round_half(F.col("loaded") * F.lit(100.0) / F.col("readings"), 3))


def starts(df: DataFrame, state: str, order: list[str], by: list[Column | str], chunk: str = "day", keys: list[str] | None = None) -> DataFrame:
    """Starts and stops over the whole record, counted by the given columns."""
    out = ordered_lag(df, {state: "_was"}, order, chunk, keys)
    up, down = (F.col("_was") == 0) & (F.col(state) == 1), (F.col("_was") == 1) & (F.col(state) == 0)
    return out.groupBy(*by).agg(F.count_if(up).alias("starts"), F.count_if(down).alias("stops"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
