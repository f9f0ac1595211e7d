"""Alarms against documented failures: episodes, lead times, false alarms, threshold sweeps, day classes.

``keys`` name a machine: reports, days and scores of a machine are only ever held against each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from telemill.functions import month_of, round_half
from telemill.operators.windows import islands


def event_days(reports: DataFrame) -> DataFrame:
    """Reports by the days they cover; an event is named by its number and start."""
    return reports.withColumn("day", F.explode(F.sequence(F.to_date("began"), F.to_date("ended"))))


def _beside(out: DataFrame, one: DataFrame, keys: list[str]) -> DataFrame:
    """Join on one row per machine, or on the one row of the only machine."""
    return out.join(one, keys, "left") if keys else out.crossJoin(F.broadcast(one))


def _per_month(false_days: Column, months: Column) -> Column:
    return round_half(F.try_divide(false_days, months), 3)


#: Thresholds between two of the coarse ones that a day is held against first.
_STRIDE = 128


def _below(sorted_: Column, value: Column) -> Column:
    """How many of sorted numbers are below a value: among every 128th first, then among the 128 between two of them."""
    coarse = F.size(F.filter(F.filter(sorted_, lambda x, i: i % _STRIDE == 0), lambda x: x < value))
    at = (coarse - 1) * _STRIDE
    return F.when(coarse > 0, at + F.size(F.filter(F.slice(sorted_, at + 1, _STRIDE), lambda x: x < value))).otherwise(0)


def sweep(scores: DataFrame, reports: DataFrame, thresholds: DataFrame, score: str = "peak", keys: list[str] | None = None, extra: DataFrame | None = None) -> DataFrame:
    """By threshold: alarm days, detected reports, false alarm days and false alarms a month, in one pass.

    A day alarms when its score exceeds the threshold; a report is detected when it holds an alarm day; an alarm
    day outside every report is false.  Months are those with a score.  With ``extra`` reports the same pass also
    gives detected_with, false_days_with and false_per_month_with, in which these count as reports.

    A day falls between two thresholds and alarms for all up to there, a report for all up to its highest day.  Days and
    reports are counted by that place, and the sums from each place on are the answers: rows are days and thresholds,
    not their product.
    """
    keys = keys or []
    events = event_days(reports).select(*keys, "day", F.struct("nr", "began").alias("event"), F.lit(False).alias("_x"))
    if extra is not None:
        events = events.union(event_days(extra).select(*keys, "day", F.struct("nr", "began").alias("event"), F.lit(True).alias("_x")))
    months = scores.groupBy(*keys).agg(F.count_distinct(month_of("day")).alias("months"), F.count("*").alias("_scored")).where("_scored > 0").drop("_scored")
    steps = thresholds.select("threshold").distinct().agg(F.array_sort(F.collect_list("threshold")).alias("_steps"))
    days = scores.crossJoin(F.broadcast(steps)).select(*keys, "day", F.coalesce(_below(F.col("_steps"), F.col(score)), F.lit(0)).alias("_place"))
    own = events.groupBy(*keys, "day").agg(F.max(~F.col("_x")).alias("_own"), F.lit(True).alias("_any"))
    flagged = days.join(own, [*keys, "day"], "left")
    false = lambda c: F.count_if(~F.coalesce(F.col(c), F.lit(False)))
    zero = F.lit(0).cast("long")
    by_day = flagged.groupBy(*keys, "_place").agg(F.count("*").alias("alarm_days"), false("_own").alias("false_days"), false("_any").alias("false_days_with"))
    by_day = by_day.select(*keys, "_place", "alarm_days", "false_days", "false_days_with", zero.alias("detected"), zero.alias("detected_with"), F.lit(None).cast("double").alias("threshold"))
    reached = events.join(days, [*keys, "day"]).groupBy(*keys, "event").agg(F.max(F.when(~F.col("_x"), F.col("_place"))).alias("_p"), F.max("_place").alias("_with"))
    once = lambda c, n: F.struct(F.coalesce(F.col(c), zero).alias("_place"), *[F.lit(int(n == x)).cast("long").alias(x) for x in ("detected", "detected_with")])
    by_event = reached.select(*keys, F.inline(F.array(once("_p", "detected"), once("_with", "detected_with"))))
    by_event = by_event.select(*keys, "_place", zero, zero, zero, "detected", "detected_with", F.lit(None).cast("double"))
    asked = steps.select(F.posexplode("_steps").alias("_at", "threshold"))
    asked = months.drop("months").crossJoin(F.broadcast(asked)) if keys else asked.join(months.select(F.lit(True).alias("_some")), F.lit(True), "left_semi")
    asked = asked.select(*keys, (F.col("_at") + 1).alias("_place"), zero, zero, zero, zero, zero, F.col("threshold").cast("double"))
    names = ["alarm_days", "false_days", "false_days_with", "detected", "detected_with"]
    # a threshold's alarms are those of its place and all beyond; there are as many rows as places and thresholds
    onward = W.partitionBy(*(keys or [F.lit(0)])).orderBy(F.col("_place").desc()).rangeBetween(W.unboundedPreceding, 0)
    summed = by_day.union(by_event).union(asked).select(*keys, "threshold", *[F.sum(n).over(onward).alias(n) for n in names]).where("threshold IS NOT NULL")
    out = _beside(summed, months, keys).select(
        *keys, "threshold", "alarm_days", "detected", "false_days", "detected_with", "false_days_with",
        _per_month(F.col("false_days"), F.col("months")).alias("false_per_month"), _per_month(F.col("false_days_with"), F.col("months")).alias("false_per_month_with"),
    )
    return out if extra is not None else out.drop("detected_with", "false_days_with", "false_per_month_with")


def episodes(alarm_days: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return islands(alarm_days, keys=keys)


def lead_times(alarm_days: DataFrame, reports: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """By report: the first day of the earliest episode that reaches it from before, the lead in days, the episode's length.

    An episode belongs to a report when it starts before the report's first day and ends at most a day before it.
    """
    keys = keys or []
    e = islands(alarm_days, keys=keys).select(*[F.col(k).alias("_e_" + k) for k in keys], "first_day", "last_day", "days")
    r = reports.select(*keys, "nr", "began", F.to_date("began").alias("start_day"))
    near = (F.col("first_day") < F.col("start_day")) & (F.col("start_day") <= F.date_add("last_day", 1))
    for k in keys:
        near = near & (F.col(k) == F.col("_e_" + k))
    out = r.join(e, near, "left").groupBy(*keys, "nr", "began", "start_day").agg(F.min(F.struct("first_day", "days")).alias("e"))
    return out.select(*keys, "nr", "began", F.col("e.first_day").alias("episode_from"), F.datediff("start_day", F.col("e.first_day")).cast("long").alias("lead_days"), F.col("e.days").alias("episode_days"))


def false_alarms(scores: DataFrame, reports: DataFrame, level: float, score: str = "peak", keys: list[str] | None = None) -> DataFrame:
    """Alarm days outside every report, and how many a month with a score."""
    keys = keys or []
    reported = event_days(reports).select(*keys, "day", F.lit(True).alias("_r")).distinct()
    out = scores.join(reported, [*keys, "day"], "left").groupBy(*keys).agg(
        F.count_if((F.col(score) > level) & F.col("_r").isNull()).alias("false_days"), F.count_distinct(F.month("day")).alias("_m")
    )
    return out.select(*keys, "false_days", _per_month(F.col("false_days"), F.col("_m")).alias("per_month"))


def highest_full_threshold(swept: DataFrame, events: int) -> DataFrame:
    return swept.where(F.col("detected") == events).agg(F.max("threshold").alias("threshold"))


def classify_days(days: DataFrame, reports: DataFrame, threshold: float, floor: float, score: str = "peak", keys: list[str] | None = None) -> DataFrame:
    """Class of each day: hit, missed, false, above noise, normal, or not judged where the score is unknown."""
    keys = keys or []
    reported = event_days(reports).select(*keys, "day", F.lit(True).alias("_r")).distinct()
    out = days.join(reported, [*keys, "day"], "left")
    r, s = F.coalesce("_r", F.lit(False)), F.col(score)
    kind = F.when(s.isNull(), "not judged").when(r & (s > threshold), "hit").when(r, "missed").when(s > threshold, "false").when(s > floor, "above noise").otherwise("normal")
    return out.withColumn("class", kind).drop("_r")


def cumulative_alarms(scores: DataFrame, reports: DataFrame, thresholds: DataFrame, score: str = "peak", keys: list[str] | None = None) -> DataFrame:
    """By threshold and day: alarm days so far and those within reports."""
    keys = keys or []
    reported = event_days(reports).select(*keys, "day", F.lit(1).cast("long").alias("_r")).distinct()
    x = scores.select(*keys, "day", F.col(score).alias("_s")).join(reported, [*keys, "day"], "left").crossJoin(F.broadcast(thresholds))
    alarm = F.when(F.col("_s") > F.col("threshold"), 1).otherwise(0).cast("long")
    w = W.partitionBy(*keys, "threshold").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return x.select(*keys, "threshold", "day", F.sum(alarm).over(w).alias("alarms_so_far"), F.sum(alarm * F.coalesce("_r", F.lit(0))).over(w).alias("true_so_far"))
