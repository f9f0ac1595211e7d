"""Exact continuous quantiles of groups of any size, by rank selection.

The engine's own exact percentile keeps every distinct value of a group in one task.  Groups of up to ``limit`` values
still use it; where a larger one exists, the ranks next to each quantile are found among all groups at once:

1. an approximate percentile on either side of each quantile brackets its ranks (a sketch, merged from partial ones);
2. one pass counts the values below each bracket exactly and keeps the few values inside it;
3. the kept values are counted by distinct value.  Where a bracket still holds more than ``limit`` of them, it is cut at
   a grid of approximate percentiles of its own, exact counts tell the cell of each rank, and the others are dropped;
4. what is left is numbered, and the two values next to the quantile are interpolated as percentile does.

Counts decide, so an unlucky sketch costs a wider bracket and never a wrong value.  Null and NaN values do not count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from telemill.sources.scratch import scratch

#: Values of a group that one task may hold; error of the first sketch is one in so many; cells of a cut.
LIMIT, ACCURACY, CELLS = 1 << 20, 10_000, 32
#: A quantile by its name: the value, and the share of values below it.
Wanted = dict[str, tuple[Column, float]]


def _saved(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _by(keys: list[str], rows: DataFrame, one: DataFrame, how: str = "inner") -> DataFrame:
    """Join of rows to one row per group, null-safe; without keys to the one row there is."""
    if not keys:
        return rows.crossJoin(F.broadcast(one)) if how == "inner" else rows.join(F.broadcast(one), F.lit(True), how)
    other = one.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[c for c in one.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
    return rows.join(other, on, how).drop(*[f"_g_{k}" for k in keys])


def quantiles(df: DataFrame, wanted: Wanted, others: list[Column] | None = None, keys: list[str] | None = None, limit: int = LIMIT, accuracy: int = ACCURACY) -> DataFrame:
    """One row per group: keys, ``others`` (aggregates), and each wanted quantile under its name, null for no values."""
    keys, others = keys or [], others or []
    sizes = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if sizes <= limit:
        exact = [F.percentile(_number(c), F.lit(p)).alias(name) for name, (c, p) in wanted.items()]
        return df.groupBy(*keys).agg(*others, *exact)
    found = select_ranks(df, wanted, keys, limit, accuracy)
    base = df.groupBy(*keys).agg(*(others or [F.count("*").alias("_rows")])) if keys else df.agg(*(others or [F.count("*").alias("_rows")]))
    return _by(keys, base, found, "left").drop("_rows")


def _number(c: Column) -> Column:
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def select_ranks(df: DataFrame, wanted: Wanted, keys: list[str], limit: int, accuracy: int) -> DataFrame:
    """One row per group with any value: keys and the wanted quantiles."""
    names = list(wanted)
    rows = df.select(*keys, *[_number(c).alias(f"_v{i}") for i, (c, _) in enumerate(wanted.values())])
    margin = 2.0 / accuracy
    low_high = [F.percentile_approx(f"_v{i}", [max(0.0, p - margin), min(1.0, p + margin)], accuracy).alias(f"_b{i}") for i, (_, p) in enumerate(wanted.values())]
    at = range(len(names))
    brackets = _saved(rows.groupBy(*keys).agg(*low_high, *[F.count(f"_v{i}").alias(f"_n{i}") for i in at]), "brackets")
    beside = _by(keys, rows, brackets.select(*keys, *[f"_b{i}" for i in at]))
    below = beside.groupBy(*keys).agg(*[F.count_if(F.col(f"_v{i}") < F.col(f"_b{i}")[0]).alias(f"_u{i}") for i in at], *[F.count_if(F.col(f"_v{i}") <= F.col(f"_b{i}")[1]).alias(f"_t{i}") for i in at])
    found = _by(keys, brackets, below)
    # one row per group and quantile: ranks first and first + 1 (0-based) are asked for, of which the bracket must hold both
    target = lambda i, p: F.struct(F.lit(i).alias("_i"), F.col(f"_n{i}").alias("_n"), (F.lit(p) * (F.col(f"_n{i}") - 1)).alias("_at"), F.col(f"_b{i}")[0].alias("_lo"), F.col(f"_b{i}")[1].alias("_hi"), F.col(f"_u{i}").alias("_below"), F.col(f"_t{i}").alias("_upto"))
    targets = found.select(*keys, F.inline(F.array(*[target(i, p) for i, (_, p) in enumerate(wanted.values())]))).where("_n > 0")
    first = F.floor("_at")
    missed = (first < F.col("_below")) | (F.least(first + 1, F.col("_n") - 1) >= F.col("_upto"))
    lowest, highest = F.lit(float("-inf")), F.lit(float("inf"))
    targets = targets.withColumns({"_lo": F.when(missed, lowest).otherwise(F.col("_lo")), "_hi": F.when(missed, highest).otherwise(F.col("_hi")), "_below": F.when(missed, 0).otherwise(F.col("_below"))})
    targets = _saved(targets.select(*keys, "_i", "_n", "_at", "_lo", "_hi", "_below"), "targets")
    longer = rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"_v{i}").alias("_v")) for i in at]))).where("_v IS NOT NULL")
    group = [*keys, "_i"]
    inside = _by(group, longer, targets.select(*group, "_lo", "_hi")).where("_v >= _lo AND _v <= _hi")
    inside = _saved(inside.groupBy(*group, "_v").agg(F.count("*").alias("_c")), "inside")
    while (inside.groupBy(*group).count().agg(F.max("count")).first()[0] or 0) > max(limit, 2 * CELLS):
        inside, targets = _cut(inside, targets, group)
    numbered = W.partitionBy(*group).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = inside.withColumn("_last", F.sum("_c").over(numbered) - 1)  # last rank inside the bracket that has the value
    ranked = _by(group, ranked, targets.select(*group, "_n", "_at", "_below")).withColumn("_last", F.col("_last") + F.col("_below"))
    next_ = F.least(first + 1, F.col("_n") - 1)
    ends = ranked.groupBy(*group).agg(F.min(F.when(F.col("_last") >= first, F.col("_v"))).alias("_a"), F.min(F.when(F.col("_last") >= next_, F.col("_v"))).alias("_z"), F.first("_at").alias("_at"))
    part = F.col("_at") - first
    value = F.when(F.col("_a") == F.col("_z"), F.col("_a")).otherwise((1 - part) * F.col("_a") + part * F.col("_z"))
    value = ends.withColumn("_q", F.when(part == 0, F.col("_a")).otherwise(value))
    return value.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)])


def _cut(inside: DataFrame, targets: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """Keep of each bracket the cells of its two ranks; cells end at approximate percentiles of the distinct values, whose
    error is far below a cell, so every cut drops most of them."""
    edges = inside.groupBy(*group).agg(F.array_distinct(F.percentile_approx("_v", [k / CELLS for k in range(1, CELLS)], ACCURACY)).alias("_edges"))
    cell = F.size(F.filter("_edges", lambda e: e <= F.col("_v")))
    celled = _saved(_by(group, inside, edges).withColumn("_cell", cell).drop("_edges"), "cells")
    counts = celled.groupBy(*group, "_cell").agg(F.sum("_c").alias("_m"))
    before = F.sum("_m").over(W.partitionBy(*group).orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)) - F.col("_m")
    spans = _by(group, counts.withColumn("_before", before), targets.select(*group, "_n", "_at", "_below"))
    first = F.floor("_at") - F.col("_below")
    last = F.least(F.floor("_at") + 1, F.col("_n") - 1) - F.col("_below")
    kept = spans.where((F.col("_before") <= last) & (F.col("_before") + F.col("_m") > first))
    kept = _saved(kept.groupBy(*group).agg(F.min("_cell").alias("_from"), F.max("_cell").alias("_to"), F.min("_before").alias("_more")), "kept-cells")
    inside = _by(group, celled, kept.select(*group, "_from", "_to")).where("_cell BETWEEN _from AND _to").drop("_cell", "_from", "_to")
    targets = _by(group, targets, kept.select(*group, "_more")).withColumn("_below", F.col("_below") + F.col("_more")).drop("_more")
    return _saved(inside, "inside"), _saved(targets, "targets")
