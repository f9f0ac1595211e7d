"""Operating parameters of a compressor from its record: thresholds, balance, slopes, ramp, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from telemill.functions import round_half
from telemill.operators.quantiles import quantiles
from telemill.operators.windows import ordered_lag, segment_rows, segment_steps, segments


def thresholds(df: DataFrame, state: str, value: str, order: list[str], chunk: str = "day", keys: list[str] | None = None) -> DataFrame:
    """Median value at each direction of a transition."""
    t = ordered_lag(df, {state: "_was"}, order, chunk, keys).where(F.col("_was") != F.col(state))
    t = t.withColumn("direction", F.when(F.col(state) == 1, "start").otherwise("stop"))
    out = quantiles(t, {"threshold": (F.col(value), 0.5)}, [F.count("*").alias("n")], [*(keys or []), "direction"])
    return out.select(*(keys or []), "direction", "n", round_half("threshold", 3).alias("threshold"))


def clean_segments(df: DataFrame, state: str, value: str, max_gap: int, order: list[str], minutes_per_reading: float, keys: list[str] | None = None) -> DataFrame:
    """Unbroken segments of more than one reading, with what the value gained or lost."""
    s = segments(df, state, value, max_gap, order, keys=keys, minutes_per_reading=minutes_per_reading).where("not broken and readings > 1")
    return s.withColumn("change", F.col("last_value") - F.col("first_value"))


def durations(segs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """By state: segments, their usual and longest counted minutes."""
    out = quantiles(segs, {"typical": (F.col("counted_minutes"), 0.5)}, [F.count("*").alias("n"), F.max("counted_minutes").alias("most")], [*(keys or []), "state"])
    return out.select(*(keys or []), "state", "n", round_half("typical", 3).alias("typical_minutes"), round_half("most", 3).alias("longest"))


def balance(segs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """What came in under load and went out without: totals, minutes, mean rates, imbalance, duty by segments."""
    loaded, idle = F.col("state") == 1, F.col("state") == 0
    minutes = F.col("counted_minutes")
    out = segs.groupBy(*(keys or [])).agg(
        F.sum(F.when(loaded, F.col("change"))).alias("gained"), F.sum(F.when(loaded, minutes)).alias("loaded_minutes"),
        F.sum(F.when(idle, -F.col("change"))).alias("lost"), F.sum(F.when(idle, minutes)).alias("idle_minutes"),
    )
    fill, drain = F.col("gained") / F.col("loaded_minutes"), F.col("lost") / F.col("idle_minutes")
    return out.select(
        *(keys or []), *[round_half(c, 3).alias(c) for c in ("gained", "lost", "loaded_minutes", "idle_minutes")],
        round_half(fill, 6).alias("fill_rate"), round_half(drain, 6).alias("drain_rate"),
        round_half(F.col("loaded_minutes") / (F.col("loaded_minutes") + F.col("idle_minutes")), 6).alias("duty"),
        round_half((F.col("gained") - F.col("lost")) / F.greatest(F.abs("gained"), F.abs("lost")), 6).alias("imbalance"),
    )


def slopes(df: DataFrame, state: str, value: str, order: list[str], chunk: str = "day", keys: list[str] | None = None) -> DataFrame:
    """Median step of the value in each state, and the smallest positive step the sensor makes."""
    w = W.partitionBy(*(keys or []), chunk).orderBy(*order)
    d = df.withColumn("_d", F.lead(value).over(w) - F.col(value)).withColumn("_next", F.lead(state).over(w))
    same = F.col("_next") == F.col(state)
    steps = {name: (F.when(same & (F.col(state) == s), F.col("_d")), 0.5) for name, s in (("loaded_step", 1), ("idle_step", 0))}
    out = quantiles(d, steps, [F.min(F.when(F.abs("_d") > 1e-9, F.abs("_d"))).alias("smallest_step")], keys)
    return out.select(*(keys or []), *[round_half(c, 3).alias(c) for c in ("loaded_step", "idle_step", "smallest_step")])


def ramp(df: DataFrame, state: str, value: str, order: list[str], steps: int = 10, chunk: str = "day", keys: list[str] | None = None) -> DataFrame:
    """Median change at each of the first steps of a loaded segment."""
    rows = segment_steps(segment_rows(df, state, order, chunk, keys), {value: "_before"}, order, chunk, keys).where((F.col(state) == 1) & F.col("step").between(2, steps + 1))
    rows = rows.withColumns({"_d": F.col(value) - F.col("_before"), "step": (F.col("step") - 1).cast("long")})
    out = quantiles(rows, {"change": (F.col("_d"), 0.5)}, [F.count("*").alias("n")], [*(keys or []), "step"])
    return out.select(*(keys or []), "step", "n", round_half("change", 3).alias("change"))


def predictions(params: DataFrame) -> DataFrame:
    """From start, stop, fill and consumption: band, delivery, duty, minutes of a cycle and starts per hour, in closed form."""
    band, delivery = F.col("stop") - F.col("start"), F.col("fill") + F.col("consumption")
    cycle = band / F.col("fill") + band / F.col("consumption")
    return params.select(
        "*", round_half(band, 6).alias("band"), round_half(delivery, 6).alias("delivery"), round_half(F.col("consumption") / delivery, 6).alias("duty"),
        round_half(cycle, 6).alias("cycle_minutes"), round_half(F.lit(60.0) / cycle, 6).alias("starts_per_hour"),
    )


def prediction_errors(predicted: DataFrame, observed: DataFrame) -> DataFrame:
    """Predicted beside observed duty and starts per hour (one row each), and by how much of the observed each is off."""
    off = lambda c: round_half(F.abs(F.try_divide(F.col(c), F.col("observed_" + c)) - 1), 6).alias(f"{c}_error")
    seen = observed.select(F.col("duty").alias("observed_duty"), F.col("starts_per_hour").alias("observed_starts_per_hour"))
    return predicted.select("duty", "starts_per_hour").crossJoin(F.broadcast(seen)).select("duty", "observed_duty", off("duty"), "starts_per_hour", "observed_starts_per_hour", off("starts_per_hour"))


def grid_search(spark, fills: tuple[int, float, float], uses: tuple[int, float, float], band: float, duty: float, starts: float, tie: float = 0.002) -> DataFrame:
    """Fill and consumption over a grid (count, first, step), judged by the relative error of the duty, of the starts and
    by their mean: for each the best point, the ties around it, and whether the best lies on the grid's edge, so that a
    better one may lie outside."""
    axis = lambda spec, name: spark.range(spec[0]).select((F.lit(spec[1]) + F.col("id") * F.lit(spec[2])).alias(name), F.col("id").isin(0, spec[0] - 1).alias("_e_" + name))
    g = axis(fills, "fill").crossJoin(axis(uses, "consumption"))
    d = F.abs(F.col("consumption") / (F.col("fill") + F.col("consumption")) / F.lit(duty) - 1)
    s = F.abs(F.lit(60.0) / (F.lit(band) / F.col("fill") + F.lit(band) / F.col("consumption")) / F.lit(starts) - 1)
    ways = F.array(*[F.struct(F.lit(n).alias("judged_by"), round_half(e, 9).alias("error")) for n, e in (("duty", d), ("starts", s), ("both", (d + s) / 2))])
    g = g.select("fill", "consumption", (F.col("_e_fill") | F.col("_e_consumption")).alias("_edge"), F.inline(ways))
    best = g.groupBy("judged_by").agg(F.min(F.struct("error", "fill", "consumption", "_edge")).alias("b"))
    tied = g.join(F.broadcast(best), "judged_by").where(F.col("error") <= F.col("b.error") + tie)
    return tied.groupBy("judged_by", "b").agg(F.count("*").alias("ties"), *[round_half(f(c), 6).alias(f"{n}_{c}") for c in ("fill", "consumption") for n, f in (("low", F.min), ("high", F.max))]).select(
        "judged_by", round_half("b.error", 6).alias("error"), round_half("b.fill", 6).alias("fill"), round_half("b.consumption", 6).alias("consumption"), F.col("b._edge").alias("on_edge"), "ties", "low_fill", "high_fill", "low_consumption", "high_consumption"
    )


def leak_sweep(spark, count: int, step: float, delivery: float, consumption: float) -> DataFrame:
    """Leak sizes: duty = (c + leak) / e and residual = duty * e - c, the leak itself."""
    leak = F.col("id") * F.lit(step)
    duty = F.least(F.lit(1.0), (F.lit(consumption) + leak) / F.lit(delivery))
    return spark.range(count).select(round_half(leak, 6).alias("leak"), round_half(duty, 6).alias("duty"), round_half(duty * F.lit(delivery) - F.lit(consumption), 6).alias("residual"))
