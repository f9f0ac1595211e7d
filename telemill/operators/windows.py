"""Ordered windows over a whole record without moving it into one task.

A record is windowed chunk by chunk (a chunk is a day), and what crosses a chunk's edge, one row per chunk, is
joined on.  Chunks may be missing: the previous chunk is the previous existing one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from telemill.functions import boundary_diff


def _same(a: DataFrame, keys: list[str], prefix: str) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys]


def _edges(df: DataFrame, keys: list[str], chunk: str, aggs: list[Column]) -> DataFrame:
    """One row per chunk, key columns renamed so that a join back is unambiguous."""
    out = df.groupBy(*keys, chunk).agg(*aggs)
    return out.select(*[F.col(k).alias("_e_" + k) for k in [*keys, chunk]], *[c for c in out.columns if c not in [*keys, chunk]])


def ordered_lag(df: DataFrame, cols: dict[str, str], order: list[str], chunk: str = "day", keys: list[str] | None = None) -> DataFrame:
    """Adds for each source column its value in the row before: ``cols`` maps source to result."""
    keys = keys or []
    inside = W.partitionBy(*keys, chunk).orderBy(*order)
    last = F.max_by(F.struct(*cols), F.struct(*order)).alias("_last")
    before = W.partitionBy(*["_e_" + k for k in keys]).orderBy("_e_" + chunk) if keys else W.orderBy("_e_" + chunk)
    edges = _edges(df, keys, chunk, [last]).withColumn("_prev", F.lag("_last").over(before)).drop("_last")
    first = F.row_number().over(inside) == 1
    out = df.withColumn("_first", first)
    for source, name in cols.items():
        out = out.withColumn(name, F.lag(source).over(inside))
    out = out.join(edges, [c for c in _same(df, [*keys, chunk], "_e_")], "left")
    for source, name in cols.items():
        out = out.withColumn(name, F.when(F.col("_first"), F.col(f"_prev.{source}")).otherwise(F.col(name)))
    return out.drop("_first", "_prev", *["_e_" + k for k in [*keys, chunk]])


def ordered_running_sum(df: DataFrame, value: str, name: str, order: list[str], chunk: str = "day", keys: list[str] | None = None) -> DataFrame:
    """Adds the sum of a column up to and including each row."""
    keys = keys or []
    inside = W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = (W.partitionBy(*["_e_" + k for k in keys]) if keys else W.partitionBy()).orderBy("_e_" + chunk).rowsBetween(W.unboundedPreceding, -1)
    edges = _edges(df, keys, chunk, [F.sum(value).alias("_total")]).withColumn("_so_far", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    out = df.withColumn(name, F.sum(value).over(inside)).join(edges, _same(df, [*keys, chunk], "_e_"), "left")
    return out.withColumn(name, F.col(name) + F.col("_so_far")).drop("_so_far", *["_e_" + k for k in [*keys, chunk]])


def segment_rows(df: DataFrame, state: str, order: list[str], chunk: str = "day", keys: list[str] | None = None) -> DataFrame:
    """Adds segment (a number that grows by one where the state changes), previous state and previous time."""
    out = ordered_lag(df, {state: "_was", order[0]: "previous_ts"}, order, chunk, keys)
    out = out.withColumn("_changed", F.when(F.col("_was").eqNullSafe(F.col(state)), 0).otherwise(1))
    return ordered_running_sum(out, "_changed", "segment", order, chunk, keys).drop("_changed").withColumnRenamed("_was", "previous_state")


def segment_steps(rows: DataFrame, cols: dict[str, str], order: list[str], chunk: str = "day", keys: list[str] | None = None) -> DataFrame:
    """Adds step, the row's number within its segment from 1 on, and for each source column its value at the step before.

    Rows are numbered within each chunk's part of a segment; what earlier chunks hold of it is added, so a state that
    never changes is no single task.
    """
    keys = keys or []
    part = [*keys, "segment", chunk]
    inside = W.partitionBy(*part).orderBy(*order)
    before = W.partitionBy(*["_e_" + k for k in [*keys, "segment"]]).orderBy("_e_" + chunk)
    last = F.max_by(F.struct(*cols), F.struct(*order)).alias("_last")
    edges = _edges(rows, [*keys, "segment"], chunk, [F.count("*").alias("_rows"), last])
    edges = edges.withColumn("_offset", F.coalesce(F.sum("_rows").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_prev", F.lag("_last").over(before)).drop("_rows", "_last")
    out = rows.withColumn("_n", F.row_number().over(inside))
    for source, name in cols.items():
        out = out.withColumn(name, F.lag(source).over(inside))
    out = out.join(edges, _same(rows, part, "_e_"), "left").withColumn("step", F.col("_n") + F.col("_offset"))
    for source, name in cols.items():
        out = out.withColumn(name, F.when(F.col("_n") == 1, F.col(f"_prev.{source}")).otherwise(F.col(name)))
    return out.drop("_n", "_offset", "_prev", *["_e_" + k for k in part])


def segments(df: DataFrame, state: str, value: str, max_gap: int, order: list[str], chunk: str = "day", keys: list[str] | None = None, minutes_per_reading: float = 1 / 6) -> DataFrame:
    """Maximal runs of equal state: readings, counted minutes (n - 1 steps), wall minutes, broken, first and last value.

    The record is sorted and shuffled once, by chunk, and summed up to the runs within a chunk; of these only the first
    and the last of each chunk, one row a chunk, tell which runs go on over its edge.
    """
    keys = keys or []
    ts = order[0]
    inside = W.partitionBy(*keys, chunk).orderBy(*order)
    was, first = F.lag(state).over(inside), F.row_number().over(inside) == 1
    rows = df.select(*dict.fromkeys([*keys, chunk, state, value, *order]), (~first & was.eqNullSafe(F.col(state))).alias("_goes_on"), F.lag(ts).over(inside).alias("_before"))
    rows = rows.withColumn("_part", F.sum(F.when(F.col("_goes_on"), 0).otherwise(1)).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    far = lambda start, end: F.coalesce(boundary_diff("second", start, end) > max_gap, F.lit(False))
    at = F.struct(*order)
    parts = rows.groupBy(*keys, chunk, "_part").agg(
        F.max(state).alias("_state"), F.count("*").alias("_n"), F.min(ts).alias("_from"), F.max(ts).alias("_to"), F.max(F.col("_goes_on") & far("_before", ts)).alias("_broken"),
        F.min_by(value, at).alias("_first"), F.max_by(value, at).alias("_last"), F.min(at).alias("_begins"), F.max(at).alias("_ends"),
    )
    by_chunk = _edges(parts, keys, chunk, [
        F.max("_part").alias("_e_parts"), F.min_by("_state", "_part").alias("_e_first"), F.max_by("_state", "_part").alias("_e_last"), F.min("_from").alias("_e_from"), F.max("_to").alias("_e_to"),
    ])
    before = W.partitionBy(*["_e_" + k for k in keys]).orderBy("_e_" + chunk)  # one row a chunk
    some = F.lag(F.lit(True)).over(before)
    joined = F.coalesce(some, F.lit(False)) & F.lag("_e_last").over(before).eqNullSafe(F.col("_e_first"))
    by_chunk = by_chunk.withColumn("_joined", joined).withColumn("_torn", F.col("_joined") & far(F.lag("_e_to").over(before), F.col("_e_from")))
    new = F.sum(F.col("_e_parts") - F.col("_joined").cast("int")).over(before.rowsBetween(W.unboundedPreceding, -1))
    by_chunk = by_chunk.withColumn("_shift", F.coalesce(new, F.lit(0)) - F.col("_joined").cast("int")).drop("_e_parts", "_e_first", "_e_last", "_e_from", "_e_to", "_joined")
    whole = parts.join(by_chunk, _same(parts, [*keys, chunk], "_e_"), "left").withColumn("segment", F.col("_shift") + F.col("_part"))
    out = whole.groupBy(*keys, "segment").agg(
        F.max("_state").alias("state"),
        F.sum("_n").alias("readings"),
        F.min("_from").alias("from_ts"),
        F.max("_to").alias("to_ts"),
        F.max(F.col("_broken") | (F.col("_torn") & (F.col("_part") == 1))).alias("broken"),
        F.min_by("_first", "_begins").alias("first_value"),
        F.max_by("_last", "_ends").alias("last_value"),
    )
    wall = boundary_diff("second", "from_ts", "to_ts") / F.lit(60.0)
    return out.withColumn("counted_minutes", (F.col("readings") - 1) * F.lit(float(minutes_per_reading))).withColumn("wall_minutes", wall)


def islands(days: DataFrame, day: str = "day", keys: list[str] | None = None, gap: int = 1) -> DataFrame:
    """Episodes of days at most ``gap`` apart: first, last, days.  Day tables are small: one row per key and day."""
    keys = keys or []
    w = W.partitionBy(*keys).orderBy(day)
    out = days.withColumn("_new", F.when(F.datediff(F.col(day), F.lag(day).over(w)) <= gap, 0).otherwise(1))
    out = out.withColumn("episode", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return out.groupBy(*keys, "episode").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("days"))
