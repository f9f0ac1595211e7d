"""Joins of points to intervals as equi-joins, by a dyadic cover of the intervals.

An interval of n units is the disjoint union of at most two aligned blocks of each size 1, 2, 4, ..., 2 log n blocks in
all, instead of n rows.  A point lies in one block of each size, so it meets an interval in exactly one of its blocks.
Points are looked up once per distinct unit and only in the sizes that some interval uses.

Blocks and units of the intervals are counted before the joins: up to MAX_BROADCAST of them are broadcast, beyond that
they are shuffled.  Points, and what they are looked up by, are never broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions import epoch_seconds

#: Sizes up to 2^39 seconds, beyond any time stamp.
LEVELS = 40
#: rows of the intervals' side that a join broadcasts
MAX_BROADCAST = 100_000


def unit_of(c: Column, seconds: int) -> Column:
    """The number of a time's unit since 1970."""
    return F.floor(epoch_seconds(c) / seconds).cast("long")


def cover(intervals: DataFrame, first: Column, last: Column) -> DataFrame:
    """The intervals by the blocks (_level, _block) that make up units first to last, both included; none where last < first."""

    def blocks(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        lo = -F.floor(-F.col("_first") / size)  # first and end of the aligned blocks of this size within the interval
        hi = F.floor((F.col("_last") + 1) / size)
        left = (lo < hi) & (F.pmod(lo, F.lit(2)) == 1)
        right = (lo + left.cast("long") < hi) & (F.pmod(hi, F.lit(2)) == 1)
        block = lambda at: F.struct(level.alias("_level"), at.cast("long").alias("_block"))
        return F.filter(F.array(F.when(left, block(lo)), F.when(right, block(hi - 1))), lambda x: x.isNotNull())

    levels = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), blocks)
    out = intervals.withColumns({"_first": first, "_last": last}).where("_first <= _last")
    return out.select(*intervals.columns, F.inline(F.flatten(levels)))


def interval_join(points: DataFrame, intervals: DataFrame, at: str, began: str, ended: str, seconds: int = 86400, keys: list[str] | None = None, how: str = "inner", exact: bool = True) -> DataFrame:
    """Points beside the intervals that hold them (began <= at <= ended), by ``keys`` if given; ``how`` inner or left.

    ``seconds`` is the unit of the blocks: a day for reports by day, less for short intervals.  With ``exact`` the times
    themselves are compared too; without, whole units are: a report of an hour holds its day.  Points with a null time
    are in no interval.  Columns of the intervals must not be columns of the points, but for the keys.
    """
    keys = keys or []
    covered = cover(intervals, unit_of(F.col(began), seconds), unit_of(F.col(ended), seconds))
    units = F.sum(F.call_function("power", F.lit(2.0), F.col("_level")))
    sizes, n_blocks, n_units = covered.agg(F.sort_array(F.collect_set("_level")), F.count("*"), units).first()
    if not sizes:
        sizes = [0]
    side = lambda df, n: F.broadcast(df) if n <= MAX_BROADCAST else df.hint("merge")
    slots = points.select(*keys, unit_of(F.col(at), seconds).alias("_unit")).where("_unit IS NOT NULL").distinct()
    looked = F.array(*[F.struct(F.lit(s).alias("_level"), F.call_function("shiftright", F.col("_unit"), F.lit(s)).alias("_block")) for s in sizes])
    held = slots.select(*keys, "_unit", F.inline(looked)).join(side(covered, n_blocks), [*keys, "_level", "_block"]).drop("_level", "_block")
    other = held.select(*[F.col(k).alias(f"_i_{k}") for k in keys], F.col("_unit").alias("_i_unit"), *[c for c in intervals.columns if c not in keys])
    on = [F.col(k) == F.col(f"_i_{k}") for k in keys] + [unit_of(F.col(at), seconds) == F.col("_i_unit")]
    if exact:
        on.append((F.col(at) >= F.col(began)) & (F.col(at) <= F.col(ended)))
    # an interval has one row there for each of its units at most
    return points.join(side(other, n_units or 0), reduce(lambda a, b: a & b, on), how).drop("_i_unit", *[f"_i_{k}" for k in keys])
