"""Resampling, profiles, operating parameters, residual, grading and gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from telemill.functions import month_of, on_days, round_half, share, trunc_ts, upper_median
from telemill.operators import gold, grading, plant, profile, residual
from telemill.operators.quantiles import quantiles
from telemill.operators.ranks import same_order
from telemill.operators.resample import conservation, resample
from telemill.operators.windows import ordered_lag, segments
from telemill.plans.registry import ORDER, Lake, query, r, tel_sql
from telemill.plans.relational import GRID_SQL, REP_DAYS_SQL, SEG_SQL, SLOW_SQL, current_state, joi_14, slow_source
from telemill.sources.telemetry import BROKEN_GAP, CONSUMPTION, DELIVERY, FULL_DAY, HEALTHY, MIN_READINGS, REPORTS, SLOT

col, lit = F.col, F.lit
MINUTES = SLOT / 60

# ---- resampling

SILVER_SQL = f"""{GRID_SQL},
merged AS (SELECT time_bucket(INTERVAL {SLOT} SECOND, timestamp) AS slot, count(*) AS readings, max(dv = comp) AS doubtful, {r('avg(pressure)')} AS pressure, {r('avg(oil)')} AS oil, max(dv) AS dv, max(lps) AS lps FROM tel GROUP BY 1),
silver AS (SELECT grid.slot AS timestamp, CAST(grid.slot AS DATE) AS day, coalesce(readings, 0) AS readings, readings IS NOT NULL AS measured, coalesce(doubtful, FALSE) AS doubtful, pressure, oil, dv, lps FROM grid LEFT JOIN merged ON grid.slot = merged.slot)"""


def silver(k: Lake) -> DataFrame:
    return resample(k.tel, "timestamp", SLOT, ["pressure", "oil"], ["dv", "lps"], col("dv") == col("comp"))


@query("ts_01_resample", tel_sql(f"{SILVER_SQL} SELECT * FROM silver"))
def ts_01(k: Lake) -> DataFrame:
    return silver(k)


@query("ts_01_resample_per_machine", tel_sql(f"b AS (SELECT user_id, min(time_bucket(INTERVAL 21600 SECOND, timestamp)) AS lo, max(time_bucket(INTERVAL 21600 SECOND, timestamp)) AS hi FROM tel GROUP BY user_id), g AS (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 6 HOUR)) AS slot FROM b), m AS (SELECT user_id, time_bucket(INTERVAL 21600 SECOND, timestamp) AS slot, count(*) AS n, {r('avg(oil)')} AS oil FROM tel GROUP BY 1, 2) SELECT g.user_id, g.slot AS timestamp, CAST(g.slot AS DATE) AS day, coalesce(n, 0) AS readings, n IS NOT NULL AS measured, FALSE AS doubtful, oil FROM g LEFT JOIN m ON g.user_id = m.user_id AND g.slot = m.slot"))
def ts_01_keys(k: Lake) -> DataFrame:
    return resample(k.tel, "timestamp", 21600, ["oil"], keys=["user_id"])


@query("ts_02_conservation", tel_sql(f"{SILVER_SQL} SELECT CAST(sum(readings) AS BIGINT) AS kept, count(*) AS slots, (SELECT count(*) FROM tel) AS readings, count(*) AS expected, TRUE AS conserved FROM silver"))
def ts_02(k: Lake) -> DataFrame:
    return conservation(silver(k), k.tel, "timestamp", SLOT)


@query("ts_03_collisions", tel_sql(f"SELECT count(*) - count(DISTINCT time_bucket(INTERVAL {SLOT} SECOND, timestamp)) AS collisions FROM tel"))
def ts_03(k: Lake) -> DataFrame:
    return silver(k).where("measured").agg((F.sum("readings") - F.count("*")).alias("collisions"))


@query("ts_04_noise_census", tel_sql(" UNION ALL ".join(f"SELECT '{c}' AS signal, count(*) FILTER (WHERE {c} <> {r(c, 1)}) AS noisy FROM tel" for c in ("pressure", "oil", "current"))))
def ts_04(k: Lake) -> DataFrame:
    return profile.noise_census(k.tel, ["pressure", "oil", "current"], 1)


@query("ts_05_contradictions", tel_sql("SELECT day, count(*) FILTER (WHERE dv = comp) AS contradictory, max(dv = comp) AS doubtful FROM tel GROUP BY day"))
def ts_05(k: Lake) -> DataFrame:
    same = col("dv") == col("comp")
    return k.tel.groupBy("day").agg(F.count_if(same).alias("contradictory"), F.max(same).alias("doubtful"))


@query("ts_06_layer_summary", tel_sql(f"{SILVER_SQL} SELECT count(*) AS slots, count(*) FILTER (WHERE measured) AS occupied, count(*) FILTER (WHERE NOT measured) AS holes, count(*) FILTER (WHERE doubtful) AS doubtful, CAST(sum(readings) AS BIGINT) AS kept, {r('100.0 * count(*) FILTER (WHERE NOT measured) / count(*)')} AS hole_percent FROM silver"))
def ts_06(k: Lake) -> DataFrame:
    hole = F.count_if(~col("measured"))
    return silver(k).agg(F.count("*").alias("slots"), F.count_if("measured").alias("occupied"), hole.alias("holes"), F.count_if("doubtful").alias("doubtful"), F.sum("readings").alias("kept"), round_half(lit(100.0) * hole / F.count("*"), 3).alias("hole_percent"))


@query("ts_07_holes_per_month", tel_sql(f"{SILVER_SQL} SELECT strftime(day, '%Y-%m') AS month, count(*) FILTER (WHERE NOT measured) AS holes FROM silver GROUP BY 1"))
def ts_07(k: Lake) -> DataFrame:
    return silver(k).groupBy(month_of("day").alias("month")).agg(F.count_if(~col("measured")).alias("holes"))


@query("ts_08_exact_match_cycle", tel_sql(f"{GRID_SQL}, bad AS (SELECT CAST(grid.slot AS DATE) AS day, count(*) AS kept, CAST(sum(dv) AS BIGINT) AS loaded FROM grid JOIN tel ON grid.slot = date_trunc('minute', timestamp) GROUP BY 1), good AS (SELECT day, count(*) AS readings, CAST(sum(dv) AS BIGINT) AS loaded FROM tel GROUP BY day) SELECT good.day, good.readings, coalesce(bad.kept, 0) AS kept, good.loaded, coalesce(bad.loaded, 0) AS loaded_kept FROM good LEFT JOIN bad ON good.day = bad.day"))
def ts_08(k: Lake) -> DataFrame:
    """The documented mistake beside the good cycle: an exact match with the grid keeps about one reading in ten."""
    from telemill.operators.resample import slot_grid

    hit = slot_grid(k.tel, "timestamp", SLOT).join(k.tel.withColumn("slot", trunc_ts("minute", "timestamp")), "slot")
    bad = hit.groupBy(F.to_date("slot").alias("day")).agg(F.count("*").alias("kept"), F.sum("dv").cast("bigint").alias("loaded_kept"))
    good = k.tel.groupBy("day").agg(F.count("*").alias("readings"), F.sum("dv").cast("bigint").alias("loaded"))
    return good.join(bad, "day", "left").fillna(0, ["kept", "loaded_kept"])


# ---- profiles


@query("ts_09_completeness", tel_sql(f"n AS (SELECT day, count(*) AS readings FROM tel GROUP BY day) SELECT day, readings, {r('readings * 100.0 / 320', 2)} AS percent, readings * 100.0 / 320 > 90 AS complete, readings * 100.0 / 320 > 100 AS brimming, readings * 100.0 / 320 < 10 AS nearly_empty FROM n"))
def ts_09(k: Lake) -> DataFrame:
    return profile.completeness(k.tel, 320)


@query("ts_09_completeness_summary", tel_sql("n AS (SELECT day, count(*) AS c FROM tel GROUP BY day) SELECT count(*) AS days, count(*) FILTER (WHERE c > 0.9 * 320) AS complete, count(*) FILTER (WHERE c > 320) AS brimming, count(*) FILTER (WHERE c < 32) AS nearly_empty, (list_sort(list(c)))[len(list(c)) // 2 + 1] AS typical FROM n"))
def ts_09_summary(k: Lake) -> DataFrame:
    return profile.completeness_summary(profile.completeness(k.tel, 320))


@query("ts_10_sampling", tel_sql("g AS (SELECT date_diff('minute', lag(timestamp) OVER (ORDER BY timestamp, event_id), timestamp) AS gap FROM tel), n AS (SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY gap) SELECT arg_max(gap, n * 100000 - gap) AS period, CAST(sum(n) - max(n) AS BIGINT) AS irregular, CAST(sum(n) AS BIGINT) AS gaps, round((sum(n) - max(n)) / sum(n), 6) AS share FROM n"))
def ts_10(k: Lake) -> DataFrame:
    return profile.sampling(k.tel, ORDER, "minute")


DECLARED = {"pressure": "analogue", "oil": "analogue", "current": "analogue", "dv": "digital", "comp": "digital", "lps": "analogue"}


@query("ts_11_datasheet", tel_sql(" UNION ALL ".join(f"SELECT '{c}' AS signal, count(DISTINCT {c}) AS n_distinct, min({c}) AS low, max({c}) AS high, CASE WHEN count(DISTINCT {c}) <= 2 THEN 'digital' ELSE 'analogue' END AS found, '{d}' AS declared, CASE WHEN count(DISTINCT {c}) <= 2 THEN 'digital' ELSE 'analogue' END = '{d}' AS agrees FROM tel" for c, d in DECLARED.items())))
def ts_11(k: Lake) -> DataFrame:
    return profile.datasheet(k.tel, DECLARED)


@query("ts_12_duty_cycle", tel_sql(f"SELECT day, count(*) AS readings, count(*) FILTER (WHERE dv = 1) AS loaded, {r(f'count(*) FILTER (WHERE dv = 1) * {MINUTES / 60}::DOUBLE')} AS loaded_hours, {r('count(*) FILTER (WHERE dv = 1) * 100.0 / count(*)')} AS percent FROM tel GROUP BY day"))
def ts_12(k: Lake) -> DataFrame:
    return profile.duty_cycle(k.tel, "dv", MINUTES)


@query("ts_13_signal_agreement", tel_sql(f"SELECT dv, comp, count(*) AS n, min(current) AS low, {r('avg(current)')} AS mean, max(current) AS high FROM tel GROUP BY dv, comp"))
def ts_13(k: Lake) -> DataFrame:
    return k.tel.groupBy("dv", "comp").agg(F.count("*").alias("n"), F.min("current").alias("low"), round_half(F.avg("current"), 3).alias("mean"), F.max("current").alias("high"))


@query("ts_14_three_states", tel_sql(f"SELECT CASE WHEN current < 10 THEN 'off' WHEN current < 100 THEN 'idle' ELSE 'loaded' END AS state, count(*) AS n, {r('100.0 * count(*) / (SELECT count(*) FROM tel)')} AS percent, {r(f'count(*) * {MINUTES / 60}::DOUBLE')} AS hours, {r('avg(current)')} AS mean, {r('avg(dv)', 6)} AS agreement FROM tel GROUP BY 1"))
def ts_14(k: Lake) -> DataFrame:
    n = k.tel.groupBy(current_state().alias("state")).agg(F.count("*").alias("n"), round_half(F.avg("current"), 3).alias("mean"), round_half(F.avg("dv"), 6).alias("agreement"))
    total = F.broadcast(k.tel.agg(F.count("*").alias("total")))
    return n.crossJoin(total).select("state", "n", round_half(lit(100.0) * col("n") / col("total"), 3).alias("percent"), round_half(col("n") * lit(MINUTES / 60), 3).alias("hours"), "mean", "agreement")


@query("ts_15_starts_stops", tel_sql("s AS (SELECT day, dv, lag(dv) OVER (ORDER BY timestamp, event_id) AS was FROM tel) SELECT day, count(*) FILTER (WHERE was = 0 AND dv = 1) AS starts, count(*) FILTER (WHERE was = 1 AND dv = 0) AS stops FROM s GROUP BY day"))
def ts_15(k: Lake) -> DataFrame:
    return profile.starts(k.tel, "dv", ORDER, ["day"])


GAP_SQL = "g AS (SELECT event_id, day, timestamp, lag(timestamp) OVER (ORDER BY timestamp, event_id) AS prev FROM tel), gaps AS (SELECT *, date_diff('second', prev, timestamp) AS gap FROM g)"


@query("ts_16_gap_distribution", tel_sql(f"{GAP_SQL} SELECT CAST(floor(gap / 60.0) AS BIGINT) AS minutes, count(*) AS n, max(gap) AS longest FROM gaps WHERE gap IS NOT NULL GROUP BY 1"))
def ts_16(k: Lake) -> DataFrame:
    return profile.gaps(k.tel, ORDER).where("gap is not null").groupBy(F.floor(col("gap") / 60).alias("minutes")).agg(F.count("*").alias("n"), F.max("gap").alias("longest"))


@query("ts_17_long_gaps", tel_sql(f"{GAP_SQL} SELECT count(*) FILTER (WHERE gap > 900) AS long_gaps, {r('sum(gap) FILTER (WHERE gap > 900) / 60.0', 2)} AS minutes_without FROM gaps"))
def ts_17(k: Lake) -> DataFrame:
    far = col("gap") > BROKEN_GAP
    return profile.gaps(k.tel, ORDER).agg(F.count_if(far).alias("long_gaps"), round_half(F.sum(F.when(far, col("gap"))) / lit(60.0), 2).alias("minutes_without"))


# ---- operating parameters

SEGMENTS_SQL = f"""{SEG_SQL},
segs AS (SELECT segment, max(dv) AS state, count(*) AS readings, min(timestamp) AS from_ts, max(timestamp) AS to_ts, max(coalesce(was = dv AND date_diff('second', prev, timestamp) > {BROKEN_GAP}, FALSE)) AS broken, arg_min(pressure, (timestamp, event_id)) AS first_value, arg_max(pressure, (timestamp, event_id)) AS last_value FROM seg GROUP BY segment),
clean AS (SELECT *, (readings - 1) * {MINUTES}::DOUBLE AS minutes, last_value - first_value AS change FROM segs WHERE NOT broken AND readings > 1)"""


def all_segments(k: Lake) -> DataFrame:
    return segments(k.tel, "dv", "pressure", BROKEN_GAP, ORDER, minutes_per_reading=MINUTES)


def clean(k: Lake) -> DataFrame:
    return plant.clean_segments(k.tel, "dv", "pressure", BROKEN_GAP, ORDER, MINUTES)


@query("ts_18_thresholds", tel_sql(f"s AS (SELECT dv, pressure, lag(dv) OVER (ORDER BY timestamp, event_id) AS was FROM tel) SELECT CASE WHEN dv = 1 THEN 'start' ELSE 'stop' END AS direction, count(*) AS n, {r('median(pressure)')} AS threshold FROM s WHERE was <> dv GROUP BY 1"))
def ts_18(k: Lake) -> DataFrame:
    return plant.thresholds(k.tel, "dv", "pressure", ORDER)


@query("ts_19_segments", tel_sql(f"{SEGMENTS_SQL} SELECT CAST(segment AS BIGINT) AS segment, state, readings, from_ts, to_ts, broken, first_value, last_value, (readings - 1) * {MINUTES}::DOUBLE AS counted_minutes, date_diff('second', from_ts, to_ts) / 60.0::DOUBLE AS wall_minutes FROM segs"))
def ts_19(k: Lake) -> DataFrame:
    return all_segments(k).withColumn("segment", col("segment").cast("bigint"))


@query("ts_20_durations", tel_sql(f"{SEGMENTS_SQL} SELECT state, count(*) AS n, {r('median(minutes)')} AS typical_minutes, {r('max(minutes)')} AS longest FROM clean GROUP BY state"))
def ts_20(k: Lake) -> DataFrame:
    return plant.durations(clean(k))


BALANCE_SQL = "b AS (SELECT sum(change) FILTER (WHERE state = 1) AS gained, -sum(change) FILTER (WHERE state = 0) AS lost, sum(minutes) FILTER (WHERE state = 1) AS lm, sum(minutes) FILTER (WHERE state = 0) AS im FROM clean)"


@query("ts_21_balance", tel_sql(f"{SEGMENTS_SQL}, {BALANCE_SQL} SELECT {r('gained')} AS gained, {r('lost')} AS lost, {r('lm')} AS loaded_minutes, {r('im')} AS idle_minutes, {r('gained / lm', 6)} AS fill_rate, {r('lost / im', 6)} AS drain_rate, {r('lm / (lm + im)', 6)} AS duty, {r('(gained - lost) / greatest(abs(gained), abs(lost))', 6)} AS imbalance FROM b"))
def ts_21(k: Lake) -> DataFrame:
    return plant.balance(clean(k))


@query("ts_22_slopes", tel_sql(f"s AS (SELECT dv, lead(dv) OVER w AS nx, lead(pressure) OVER w - pressure AS d FROM tel WINDOW w AS (PARTITION BY day ORDER BY timestamp, event_id)) SELECT {r('median(d) FILTER (WHERE nx = dv AND dv = 1)')} AS loaded_step, {r('median(d) FILTER (WHERE nx = dv AND dv = 0)')} AS idle_step, {r('min(abs(d)) FILTER (WHERE abs(d) > 1e-9)')} AS smallest_step FROM s"))
def ts_22(k: Lake) -> DataFrame:
    return plant.slopes(k.tel, "dv", "pressure", ORDER)


@query("ts_23_ramp", tel_sql(f"{SEG_SQL}, x AS (SELECT row_number() OVER w - 1 AS step, pressure - lag(pressure) OVER w AS d FROM seg WHERE dv = 1 WINDOW w AS (PARTITION BY segment ORDER BY timestamp, event_id)) SELECT step, count(*) AS n, {r('median(d)')} AS change FROM x WHERE step BETWEEN 1 AND 10 GROUP BY step"))
def ts_23(k: Lake) -> DataFrame:
    return plant.ramp(k.tel, "dv", "pressure", ORDER)


@query("ts_24_observables", tel_sql(f"w AS (SELECT * FROM tel WHERE day BETWEEN DATE '{HEALTHY[0]}' AND DATE '{HEALTHY[1]}'), s AS (SELECT *, lag(dv) OVER (ORDER BY timestamp, event_id) AS was FROM w) SELECT {r('avg(CASE WHEN dv = 1 THEN 1.0 ELSE 0.0 END)', 6)} AS duty, {r(f'count(*) FILTER (WHERE was = 0 AND dv = 1) / (count(*) * {MINUTES / 60}::DOUBLE)', 6)} AS starts_per_hour FROM s"))
def ts_24(k: Lake) -> DataFrame:
    w = ordered_lag(on_days(k.tel, *HEALTHY), {"dv": "was"}, ORDER)
    return w.agg(round_half(share(col("dv") == 1), 6).alias("duty"), round_half(F.count_if((col("was") == 0) & (col("dv") == 1)) / (F.count("*") * lit(MINUTES / 60)), 6).alias("starts_per_hour"))


@query("ts_24_clean_duty", tel_sql(f"{SEGMENTS_SQL} SELECT {r('sum(minutes) FILTER (WHERE state = 1) / sum(minutes)', 6)} AS duty, count(*) FILTER (WHERE state = 1) AS loads FROM clean"))
def ts_24_clean(k: Lake) -> DataFrame:
    up = col("state") == 1
    return clean(k).agg(round_half(F.sum(F.when(up, col("counted_minutes"))) / F.sum("counted_minutes"), 6).alias("duty"), F.count_if(up).alias("loads"))


MODEL_SQL = f"""s AS (SELECT dv, pressure, oil, lps, lag(dv) OVER (ORDER BY timestamp, event_id) AS was FROM tel),
 p AS (SELECT {r('median(pressure) FILTER (WHERE dv = 1 AND was = 0)')} AS start, {r('median(pressure) FILTER (WHERE dv = 0 AND was = 1)')} + 10 AS stop, {r('avg(oil) / 10', 6)} AS fill, {r('avg(lps) + 0.1', 6)} AS consumption FROM s),
 q AS (SELECT *, stop - start AS b, fill + consumption AS e, (stop - start) / fill + (stop - start) / consumption AS cy FROM p)"""


@query("ts_25_predictions", tel_sql(f"""{MODEL_SQL}
 SELECT start, stop, fill, consumption, {r('b', 6)} AS band, {r('e', 6)} AS delivery, {r('consumption / e', 6)} AS duty, {r('cy', 6)} AS cycle_minutes, {r('60.0 / cy', 6)} AS starts_per_hour FROM q"""))
def ts_25(k: Lake) -> DataFrame:
    t = ordered_lag(k.tel, {"dv": "was"}, ORDER)
    up, down = (col("dv") == 1) & (col("was") == 0), (col("dv") == 0) & (col("was") == 1)
    p = t.agg(round_half(F.median(F.when(up, col("pressure"))), 3).alias("start"), (round_half(F.median(F.when(down, col("pressure"))), 3) + 10).alias("stop"), round_half(F.avg("oil") / 10, 6).alias("fill"), round_half(F.avg("lps") + 0.1, 6).alias("consumption"))
    return plant.predictions(p)


@query("ts_25_model_errors", tel_sql(f"""{MODEL_SQL}, o AS (SELECT {r('avg(CASE WHEN dv = 1 THEN 1.0 ELSE 0.0 END)', 6)} AS od, {r(f'count(*) FILTER (WHERE was = 0 AND dv = 1) / (count(*) * {MINUTES / 60}::DOUBLE)', 6)} AS os FROM s),
 m AS (SELECT {r('consumption / e', 6)} AS duty, {r('60.0 / cy', 6)} AS starts FROM q)
 SELECT duty, od AS observed_duty, {r('abs(duty / od - 1)', 6)} AS duty_error, starts AS starts_per_hour, os AS observed_starts_per_hour, {r('abs(starts / os - 1)', 6)} AS starts_per_hour_error FROM m, o"""))
def ts_25_errors(k: Lake) -> DataFrame:
    """How far the model made of medians is off the observed duty and starts."""
    t = ordered_lag(k.tel, {"dv": "was"}, ORDER)
    seen = t.agg(round_half(share(col("dv") == 1), 6).alias("duty"), round_half(F.count_if((col("was") == 0) & (col("dv") == 1)) / (F.count("*") * lit(MINUTES / 60)), 6).alias("starts_per_hour"))
    return plant.prediction_errors(ts_25(k), seen)


@query("ts_26_health_screen", tel_sql(f"""s AS (SELECT day, dv, oil, pressure, lag(dv) OVER (ORDER BY timestamp, event_id) AS was FROM tel),
 d AS (SELECT day, {r('avg(oil)')} AS oil, {r('avg(dv)', 6)} AS duty, count(*) FILTER (WHERE was = 0 AND dv = 1) AS starts FROM s GROUP BY day),
 ref AS (SELECT (list_sort(list(duty)))[len(list(duty)) // 2 + 1] AS usual FROM d WHERE day BETWEEN DATE '{HEALTHY[0]}' AND DATE '{HEALTHY[1]}')
 SELECT day, oil, duty, starts, duty > 1.1 * usual AS odd FROM d, ref"""))
def ts_26(k: Lake) -> DataFrame:
    t = ordered_lag(k.tel, {"dv": "was"}, ORDER)
    d = t.groupBy("day").agg(round_half(F.avg("oil"), 3).alias("oil"), round_half(F.avg("dv"), 6).alias("duty"), F.count_if((col("was") == 0) & (col("dv") == 1)).alias("starts"))
    ref = on_days(d, *HEALTHY).agg(upper_median("duty").alias("usual"))
    return d.crossJoin(F.broadcast(ref)).select("day", "oil", "duty", "starts", (col("duty") > 1.1 * col("usual")).alias("odd"))


# ---- residual

RES_SQL = f"hres AS (SELECT date_trunc('hour', timestamp) AS hour, CAST(timestamp AS DATE) AS day, count(*) AS readings, {r('avg(dv)', 6)} AS duty, {r(f'avg(dv) * {DELIVERY}::DOUBLE - {CONSUMPTION}::DOUBLE', 6)} AS residual FROM tel GROUP BY 1, 2 HAVING count(*) >= {MIN_READINGS})"
PEAK_SQL = f"{RES_SQL}, peaks AS (SELECT day, max(residual) AS peak, count(*) AS hours FROM hres GROUP BY day), based AS (SELECT *, {r('median(peak) OVER (ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)', 6)} AS baseline FROM peaks)"


def hours_of(k: Lake) -> DataFrame:
    return residual.hourly_residual(k.tel, "dv", DELIVERY, CONSUMPTION, MIN_READINGS)


def peaks_of(k: Lake) -> DataFrame:
    return residual.daily_peaks(hours_of(k))


@query("ts_27_residual", tel_sql(f"{RES_SQL} SELECT * FROM hres"))
def ts_27(k: Lake) -> DataFrame:
    return hours_of(k)


@query("ts_28_noise_floor", tel_sql(f"{RES_SQL} SELECT count(*) AS hours, {r('quantile_cont(residual, 0.5)', 6)} AS median, {r('quantile_cont(residual, 0.95)', 6)} AS p95, {r('quantile_cont(residual, 0.99)', 6)} AS p99, max(residual) AS high FROM hres WHERE day BETWEEN DATE '{HEALTHY[0]}' AND DATE '{HEALTHY[1]}'"))
def ts_28(k: Lake) -> DataFrame:
    return residual.noise_floor(hours_of(k), *HEALTHY)


@query("ts_29_grains", tel_sql(f"{PEAK_SQL}, {REP_DAYS_SQL}, f AS (SELECT quantile_cont(residual, 0.99) AS floor FROM hres WHERE day BETWEEN DATE '{HEALTHY[0]}' AND DATE '{HEALTHY[1]}'), d AS (SELECT day, avg(residual) AS daily, max(residual) AS hourly FROM hres GROUP BY day) SELECT rd.nr, d.day, {r('daily / floor', 4)} AS day_in_floors, {r('hourly / floor', 4)} AS hour_in_floors FROM rd JOIN d ON rd.day = d.day CROSS JOIN f", rep=True))
def ts_29(k: Lake) -> DataFrame:
    h = hours_of(k)
    f = quantiles(on_days(h, *HEALTHY), {"floor": (col("residual"), 0.99)}, [F.count("*").alias("hours")]).select("floor")
    d = h.groupBy("day").agg(F.avg("residual").alias("daily"), F.max("residual").alias("hourly")).crossJoin(F.broadcast(f))
    return grading.event_days(k.reports).join(d, "day").select("nr", "day", round_half(col("daily") / col("floor"), 4).alias("day_in_floors"), round_half(col("hourly") / col("floor"), 4).alias("hour_in_floors"))


@query("ts_30_censoring", tel_sql(f"{RES_SQL} SELECT count(*) FILTER (WHERE duty = 1) AS full_hours, count(*) FILTER (WHERE residual > {DELIVERY}::DOUBLE - {CONSUMPTION}::DOUBLE - 0.2) AS near_ceiling FROM hres"))
def ts_30(k: Lake) -> DataFrame:
    return hours_of(k).agg(F.count_if(col("duty") == 1).alias("full_hours"), F.count_if(col("residual") > DELIVERY - CONSUMPTION - 0.2).alias("near_ceiling"))


@query("ts_31_baseline", tel_sql(f"{PEAK_SQL} SELECT day, peak, hours, baseline, {r('peak - baseline', 6)} AS deviation FROM based"))
def ts_31(k: Lake) -> DataFrame:
    return residual.with_baseline(peaks_of(k)).drop("peak_hour")


@query("ts_32_drain_rate", tel_sql(f"{SEGMENTS_SQL} SELECT CAST(from_ts AS DATE) AS day, count(*) AS n, {r('sum(-change) / sum(minutes)', 6)} AS drain_rate FROM clean WHERE state = 0 GROUP BY 1"))
def ts_32(k: Lake) -> DataFrame:
    return clean(k).where("state = 0").groupBy(F.to_date("from_ts").alias("day")).agg(F.count("*").alias("n"), round_half(F.sum(-col("change")) / F.sum("counted_minutes"), 6).alias("drain_rate"))


@query("ts_33_two_routes", tel_sql(f"{PEAK_SQL}, {SEGMENTS_SQL}, {REP_DAYS_SQL}, dr AS (SELECT CAST(from_ts AS DATE) AS day, {r('sum(-change) / sum(minutes)', 6)} AS drain_rate FROM clean WHERE state = 0 AND minutes >= 30 GROUP BY 1) SELECT rd.nr, rd.day, peaks.peak, dr.drain_rate, dr.drain_rate IS NOT NULL AS answers FROM rd LEFT JOIN peaks USING (day) LEFT JOIN dr USING (day)", rep=True))
def ts_33(k: Lake) -> DataFrame:
    dr = clean(k).where("state = 0 and counted_minutes >= 30").groupBy(F.to_date("from_ts").alias("day")).agg(round_half(F.sum(-col("change")) / F.sum("counted_minutes"), 6).alias("drain_rate"))
    out = grading.event_days(k.reports).select("nr", "day").join(peaks_of(k).select("day", "peak"), "day", "left").join(dr, "day", "left")
    return out.select("nr", "day", "peak", "drain_rate", col("drain_rate").isNotNull().alias("answers"))


@query("ts_34_drift", tel_sql(f"{RES_SQL} SELECT strftime(day, '%Y-%m') AS month, count(DISTINCT CASE WHEN residual > 0.9 THEN day END) AS days_above, {r('median(residual)', 6)} AS typical FROM hres GROUP BY 1"))
def ts_34(k: Lake) -> DataFrame:
    above = F.count_distinct(F.when(col("residual") > 0.9, col("day"))).alias("days_above")
    out = quantiles(hours_of(k).withColumn("month", month_of("day")), {"typical": (col("residual"), 0.5)}, [above], ["month"])
    return out.select("month", "days_above", round_half("typical", 6).alias("typical"))


@query("ts_35_plateau", tel_sql(f"SELECT count(*) AS n, {r('avg(oil)')} AS mean, min(oil) AS low, max(oil) AS high, {r('stddev_samp(oil)')} AS spread FROM tel WHERE timestamp >= TIMESTAMP '2024-01-07 10:00:00' AND timestamp < TIMESTAMP '2024-01-07 16:00:00'"))
def ts_35(k: Lake) -> DataFrame:
    t = k.tel.where("timestamp >= timestamp_ntz '2024-01-07 10:00:00' and timestamp < timestamp_ntz '2024-01-07 16:00:00'")
    return t.agg(F.count("*").alias("n"), round_half(F.avg("oil"), 3).alias("mean"), F.min("oil").alias("low"), F.max("oil").alias("high"), round_half(F.stddev("oil"), 3).alias("spread"))


@query("ts_36_weather", tel_sql(f"{SLOW_SQL} SELECT count(*) AS hours, {r('corr(oil, street)', 6)} AS with_street, {r('corr(oil, duty)', 6)} AS with_duty, {r('avg(oil - street)')} AS offset_mean FROM fast JOIN slow USING (hour)"))
def ts_36(k: Lake) -> DataFrame:
    return joi_14(k).agg(F.count("*").alias("hours"), round_half(F.corr("oil", "street"), 6).alias("with_street"), round_half(F.corr("oil", "duty"), 6).alias("with_duty"), round_half(F.avg(col("oil") - col("street")), 3).alias("offset_mean"))


@query("ts_37_bands", tel_sql(f"{SLOW_SQL} SELECT CASE WHEN street < 10 THEN 'cold' WHEN street < 60 THEN 'mild' ELSE 'warm' END AS band, count(*) AS hours, {r('avg(oil)')} AS oil FROM fast JOIN slow USING (hour) GROUP BY 1"))
def ts_37(k: Lake) -> DataFrame:
    band = F.when(col("street") < 10, "cold").when(col("street") < 60, "mild").otherwise("warm")
    return joi_14(k).groupBy(band.alias("band")).agg(F.count("*").alias("hours"), round_half(F.avg("oil"), 3).alias("oil"))


@query("ts_38_whole_healthy_days", tel_sql(f"{SILVER_SQL} SELECT day, CAST(sum(readings) AS BIGINT) AS readings FROM silver WHERE day BETWEEN DATE '{HEALTHY[0]}' AND DATE '{HEALTHY[1]}' GROUP BY day HAVING count(*) FILTER (WHERE measured) > 0.9 * {FULL_DAY}"))
def ts_38(k: Lake) -> DataFrame:
    s = on_days(silver(k), *HEALTHY)
    return s.groupBy("day").agg(F.sum("readings").alias("readings"), F.count_if("measured").alias("_m")).where(col("_m") > 0.9 * FULL_DAY).drop("_m")


MIN_SQL = "mins AS (SELECT day, hour(timestamp) * 60 + minute(timestamp) AS minute, CAST(max(dv) AS BIGINT) AS loaded, 1 AS recorded FROM tel GROUP BY 1, 2), full_day AS (SELECT d.day, m.minute FROM (SELECT DISTINCT day FROM tel) d, (SELECT unnest(range(1440)) AS minute) m), curve AS (SELECT f.day, f.minute, coalesce(loaded, 0) AS loaded, coalesce(recorded, 0) AS recorded FROM full_day f LEFT JOIN mins USING (day, minute)), quarter AS (SELECT day, minute // 15 AS slot, CAST(sum(loaded) AS BIGINT) AS loaded, CAST(sum(recorded) AS BIGINT) AS recorded FROM curve GROUP BY 1, 2)"


def quarters(k: Lake) -> DataFrame:
    return residual.minute_curve(k.tel, "dv", 15)


@query("ts_39_minute_curve", tel_sql(f"{MIN_SQL} SELECT day, CAST(minute AS BIGINT) AS slot, loaded, CAST(recorded AS BIGINT) AS recorded FROM curve"))
def ts_39(k: Lake) -> DataFrame:
    return residual.minute_curve(k.tel, "dv")


@query("ts_40_regrain", tel_sql(f"{MIN_SQL} SELECT day, CAST(slot AS BIGINT) AS slot, loaded, recorded, CAST(sum(loaded) OVER w AS BIGINT) AS loaded_so_far, CAST(sum(recorded) OVER w AS BIGINT) AS recorded_so_far FROM quarter WINDOW w AS (PARTITION BY day ORDER BY slot)"))
def ts_40(k: Lake) -> DataFrame:
    return residual.cumulative(quarters(k), ["loaded", "recorded"])


@query("ts_41_carry_free", tel_sql(f"{MIN_SQL}, q AS (SELECT day, slot, round_even(sum(loaded) OVER (PARTITION BY day ORDER BY slot) * 0.3::DOUBLE, 0) AS run FROM quarter) SELECT day, CAST(slot AS BIGINT) AS slot, CAST(run - coalesce(lag(run) OVER (PARTITION BY day ORDER BY slot), 0) AS BIGINT) AS whole FROM q"))
def ts_41(k: Lake) -> DataFrame:
    return residual.carry_free(quarters(k), "loaded", 0.3).select("day", "slot", "whole")


@query("ts_42_record_gaps", tel_sql(f"{MIN_SQL}, e AS (SELECT day, slot, slot - row_number() OVER (PARTITION BY day ORDER BY slot) AS g FROM quarter WHERE recorded = 0) SELECT day, CAST(min(slot) AS BIGINT) AS from_slot, CAST(max(slot) + 1 AS BIGINT) AS to_slot FROM e GROUP BY day, g"))
def ts_42(k: Lake) -> DataFrame:
    return residual.record_gaps(quarters(k))


@query("ts_43_healthy_band", tel_sql(f"{MIN_SQL}, f AS (SELECT 0.1165::DOUBLE AS floor) SELECT day, CAST(slot AS BIGINT) AS slot, {r(f'sum(recorded) OVER (PARTITION BY day ORDER BY slot) * ({CONSUMPTION}::DOUBLE + floor) / {DELIVERY}::DOUBLE')} AS most FROM quarter, f"))
def ts_43(k: Lake) -> DataFrame:
    return residual.healthy_band(quarters(k), DELIVERY, CONSUMPTION, 0.1165)


@query("ts_44_day_marks", tel_sql(f"{RES_SQL}, p AS (SELECT day, max(residual) AS peak FROM hres GROUP BY day) SELECT p.day, p.peak, min(hour) FILTER (WHERE residual > 0.9) AS first_alarm, min(hour) FILTER (WHERE residual = peak) AS peak_hour, max(duty) AS most_duty FROM hres JOIN p ON hres.day = p.day GROUP BY p.day, p.peak"))
def ts_44(k: Lake) -> DataFrame:
    extra = hours_of(k).groupBy("day").agg(F.min(F.when(col("residual") > 0.9, col("hour"))).alias("first_alarm"), F.max("duty").alias("most_duty"))
    return peaks_of(k).join(extra, "day").select("day", "peak", "first_alarm", "peak_hour", "most_duty")


# ---- grading

THRESHOLDS = 23
THR_SQL = f"thr AS (SELECT round((0.3 + 0.05 * i) * 100, 0) / 100.0::DOUBLE AS threshold FROM range({THRESHOLDS}) t(i))"
SWEEP_SQL = "x AS (SELECT threshold, s.day, s.score > threshold AS alarm, rd.began FROM s CROSS JOIN thr LEFT JOIN rd ON rd.day = s.day), months AS (SELECT count(DISTINCT strftime(day, '%Y-%m')) AS m FROM s)"


def thresholds_of(k: Lake) -> DataFrame:
    return k.spark.range(THRESHOLDS).select(round_half(lit(0.3) + lit(0.05) * col("id"), 2).alias("threshold"))


def _sweep_sql(score: str, thr: str = THR_SQL) -> str:
    return tel_sql(f"{PEAK_SQL}, {REP_DAYS_SQL}, {thr}, s AS (SELECT day, {score} AS score FROM based WHERE {score} IS NOT NULL), {SWEEP_SQL} SELECT threshold, count(DISTINCT day) FILTER (WHERE alarm) AS alarm_days, count(DISTINCT began) FILTER (WHERE alarm) AS detected, count(DISTINCT day) FILTER (WHERE alarm AND began IS NULL) AS false_days, {r('count(DISTINCT day) FILTER (WHERE alarm AND began IS NULL) / (SELECT m FROM months)')} AS false_per_month FROM x GROUP BY threshold", rep=True)


@query("evt_01_report_days", tel_sql(f"{REP_DAYS_SQL}, n AS (SELECT day, count(*) AS c FROM tel GROUP BY day) SELECT nr, began, count(*) AS days, min(rd.day) AS first_day, max(rd.day) AS last_day, CAST(sum(c) AS BIGINT) AS readings FROM rd LEFT JOIN n ON rd.day = n.day GROUP BY nr, began", rep=True))
def evt_01(k: Lake) -> DataFrame:
    n = k.tel.groupBy("day").agg(F.count("*").alias("c"))
    return grading.event_days(k.reports).join(n, "day", "left").groupBy("nr", "began").agg(F.count("*").alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("c").alias("readings"))


ALARM_LEVEL = 0.8
EPI_SQL = f"{PEAK_SQL}, al AS (SELECT day FROM peaks WHERE peak > {ALARM_LEVEL}), e1 AS (SELECT day, CASE WHEN day - lag(day) OVER (ORDER BY day) <= 1 THEN 0 ELSE 1 END AS fresh FROM al), e2 AS (SELECT day, sum(fresh) OVER (ORDER BY day) AS e FROM e1), epi AS (SELECT min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM e2 GROUP BY e)"


def alarm_days_of(k: Lake) -> DataFrame:
    return peaks_of(k).where(col("peak") > ALARM_LEVEL).select("day")


@query("evt_02_episodes", tel_sql(f"{EPI_SQL} SELECT * FROM epi"))
def evt_02(k: Lake) -> DataFrame:
    return grading.episodes(alarm_days_of(k)).drop("episode")


@query("evt_03_sweep", _sweep_sql("peak"))
def evt_03(k: Lake) -> DataFrame:
    return grading.sweep(peaks_of(k), k.reports, thresholds_of(k))


@query("evt_03_sweep_deviation", _sweep_sql(r("peak - baseline", 6)))
def evt_03_deviation(k: Lake) -> DataFrame:
    s = residual.with_baseline(peaks_of(k)).where("deviation is not null")
    return grading.sweep(s, k.reports, thresholds_of(k), "deviation")


DENSE = 10_000


@query("evt_15_dense_sweep", _sweep_sql("peak", f"thr AS (SELECT CAST(i AS DOUBLE) / 8000 AS threshold FROM range({DENSE}) t(i))"))
def evt_15(k: Lake) -> DataFrame:
    """Ten thousand thresholds at once: rows are days and thresholds, never their product."""
    return grading.sweep(peaks_of(k), k.reports, k.spark.range(DENSE).select((col("id").cast("double") / 8000).alias("threshold")))


EXTRA = ("#9", "2024-01-15 00:00:00", "2024-01-16 23:00:00")
EXTRA_SQL = f"ex AS (SELECT '{EXTRA[0]}' AS nr, TIMESTAMP '{EXTRA[1]}' AS began, unnest([DATE '2024-01-15', DATE '2024-01-16']) AS day)"


def extra_report(k: Lake) -> DataFrame:
    at = lambda c: col(c).cast("timestamp_ntz")
    return k.spark.createDataFrame([EXTRA], "nr string, a string, b string").select("nr", at("a").alias("began"), at("b").alias("ended"))


@query("evt_03_sweep_extra", tel_sql(f"""{PEAK_SQL}, {REP_DAYS_SQL}, {THR_SQL}, {EXTRA_SQL}, ev AS (SELECT nr, began, day, FALSE AS x FROM rd UNION ALL SELECT nr, began, day, TRUE FROM ex),
 f AS (SELECT day, bool_or(NOT x) AS own FROM ev GROUP BY day), a AS (SELECT threshold, p.day, peak > threshold AS alarm, coalesce(own, FALSE) AS own, f.day IS NOT NULL AS any_ev FROM peaks p CROSS JOIN thr LEFT JOIN f ON f.day = p.day),
 e AS (SELECT threshold, count(DISTINCT ev.began) FILTER (WHERE NOT x) AS detected, count(DISTINCT ev.began) AS detected_with FROM a JOIN ev ON a.day = ev.day WHERE alarm GROUP BY threshold),
 c AS (SELECT threshold, count(*) FILTER (WHERE alarm) AS alarm_days, count(*) FILTER (WHERE alarm AND NOT own) AS false_days, count(*) FILTER (WHERE alarm AND NOT any_ev) AS false_days_with FROM a GROUP BY threshold), m AS (SELECT count(DISTINCT strftime(day, '%Y-%m')) AS m FROM peaks)
 SELECT threshold, alarm_days, coalesce(detected, 0) AS detected, false_days, coalesce(detected_with, 0) AS detected_with, false_days_with, {r('false_days / m')} AS false_per_month, {r('false_days_with / m')} AS false_per_month_with FROM c LEFT JOIN e USING (threshold), m""", rep=True))
def evt_03_extra(k: Lake) -> DataFrame:
    """Both arms in one pass: without and with an event that no report documents."""
    return grading.sweep(peaks_of(k), k.reports, thresholds_of(k), extra=extra_report(k))


@query("evt_04_lead_times", tel_sql(f"{EPI_SQL}, j AS (SELECT nr, began, CAST(began AS DATE) AS sd, first_day, days FROM rep LEFT JOIN epi ON first_day < CAST(began AS DATE) AND CAST(began AS DATE) <= last_day + 1) SELECT nr, began, min(first_day) AS episode_from, sd - min(first_day) AS lead_days, arg_min(days, first_day) AS episode_days FROM j GROUP BY nr, began, sd", rep=True))
def evt_04(k: Lake) -> DataFrame:
    return grading.lead_times(alarm_days_of(k), k.reports)


@query("evt_05_false_alarms", tel_sql(f"{PEAK_SQL}, {REP_DAYS_SQL} SELECT count(*) AS false_days, {r('count(*) / nullif((SELECT count(DISTINCT month(day)) FROM peaks), 0)')} AS per_month FROM peaks WHERE peak > {ALARM_LEVEL} AND day NOT IN (SELECT day FROM rd)", rep=True))
def evt_05(k: Lake) -> DataFrame:
    return grading.false_alarms(peaks_of(k), k.reports, ALARM_LEVEL)


@query("evt_06_highest_threshold", f"SELECT max(threshold) AS threshold FROM ({_sweep_sql('peak')}) WHERE detected = 4")
def evt_06(k: Lake) -> DataFrame:
    return grading.highest_full_threshold(evt_03(k), len(REPORTS))


@query("evt_07_installed_alarm", tel_sql(f"{RES_SQL}, {REP_DAYS_SQL}, j AS (SELECT DISTINCT day FROM hres), a AS (SELECT day, date_trunc('hour', timestamp) AS hour FROM tel WHERE lps = 1 AND day IN (SELECT day FROM j)) SELECT count(DISTINCT day) AS alarm_days, (SELECT count(DISTINCT began) FROM rd WHERE day IN (SELECT day FROM a)) AS detected, count(DISTINCT day) FILTER (WHERE day NOT IN (SELECT day FROM rd)) AS false_days, {r('count(*) FILTER (WHERE hour NOT IN (SELECT hour FROM hres)) / nullif(count(*), 0)', 6)} AS in_incomplete_hours FROM a", rep=True))
def evt_07(k: Lake) -> DataFrame:
    h, rd = hours_of(k), grading.event_days(k.reports)
    a = k.tel.where("lps = 1").join(h.select("day").distinct(), "day", "left_semi").select("day", trunc_ts("hour", "timestamp").alias("hour"))
    a = a.join(h.select("hour", lit(True).alias("_h")), "hour", "left").join(rd.select("day", lit(True).alias("_r")).distinct(), "day", "left")
    counts = a.agg(F.count_distinct("day").alias("alarm_days"), F.count_distinct(F.when(col("_r").isNull(), col("day"))).alias("false_days"), round_half(F.try_divide(F.count_if(col("_h").isNull()), F.count("*")), 6).alias("in_incomplete_hours"))
    return counts.crossJoin(rd.join(a.select("day").distinct(), "day", "left_semi").agg(F.count_distinct("began").alias("detected")))


@query("evt_08_order_rival", tel_sql(f"{PEAK_SQL}, n AS (SELECT d.day, row_number() OVER (ORDER BY peak, d.day) AS a, row_number() OVER (ORDER BY duty, d.day) AS b FROM peaks p JOIN (SELECT day, {r('avg(dv)', 6)} AS duty FROM tel GROUP BY day) d ON p.day = d.day) SELECT count(*) AS days, count(*) FILTER (WHERE a <> b) AS moved FROM n"))
def evt_08(k: Lake) -> DataFrame:
    d = peaks_of(k).join(k.tel.groupBy("day").agg(round_half(F.avg("dv"), 6).alias("duty")), "day")
    return same_order(d.select("peak", "duty", "day"), "peak", "duty", "day").withColumnRenamed("rows", "days")


CLASS_SQL = f"{PEAK_SQL}, {REP_DAYS_SQL}, cal AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS day), cls AS (SELECT cal.day, peak, CASE WHEN peak IS NULL THEN 'not judged' WHEN cal.day IN (SELECT day FROM rd) AND peak > {ALARM_LEVEL} THEN 'hit' WHEN cal.day IN (SELECT day FROM rd) THEN 'missed' WHEN peak > {ALARM_LEVEL} THEN 'false' WHEN peak > 0.7 THEN 'above noise' ELSE 'normal' END AS class FROM cal LEFT JOIN peaks ON cal.day = peaks.day)"


def classes(k: Lake) -> DataFrame:
    cal = k.spark.range(33).select(F.date_add(lit("2024-01-01").cast("date"), col("id").cast("int")).alias("day"))
    return grading.classify_days(cal.join(peaks_of(k).select("day", "peak"), "day", "left"), k.reports, ALARM_LEVEL, 0.7)


@query("evt_09_day_classes", tel_sql(f"{CLASS_SQL} SELECT * FROM cls", rep=True))
def evt_09(k: Lake) -> DataFrame:
    return classes(k)


@query("evt_09_class_counts", tel_sql(f"{CLASS_SQL} SELECT class, count(*) AS days FROM cls GROUP BY class", rep=True))
def evt_09_counts(k: Lake) -> DataFrame:
    return classes(k).groupBy("class").agg(F.count("*").alias("days"))


@query("evt_10_confusion", tel_sql(f"{PEAK_SQL}, {REP_DAYS_SQL}, d AS (SELECT day, peak > {ALARM_LEVEL} AS alarm, day IN (SELECT day FROM rd) AS reported FROM peaks) SELECT count(*) FILTER (WHERE alarm AND reported) AS hits, count(*) FILTER (WHERE alarm AND NOT reported) AS false_alarms, count(*) FILTER (WHERE NOT alarm AND reported) AS misses, count(*) FILTER (WHERE NOT alarm AND NOT reported) AS quiet FROM d", rep=True))
def evt_10(k: Lake) -> DataFrame:
    rd = grading.event_days(k.reports).select("day", lit(True).alias("_r")).distinct()
    d = peaks_of(k).join(rd, "day", "left").select((col("peak") > ALARM_LEVEL).alias("a"), F.coalesce("_r", lit(False)).alias("r"))
    return d.agg(F.count_if(col("a") & col("r")).alias("hits"), F.count_if(col("a") & ~col("r")).alias("false_alarms"), F.count_if(~col("a") & col("r")).alias("misses"), F.count_if(~col("a") & ~col("r")).alias("quiet"))


@query("evt_11_hours_above_floor", tel_sql(f"{RES_SQL}, {REP_DAYS_SQL} SELECT rd.nr, rd.day, count(*) FILTER (WHERE residual > 0.7) AS above, count(hres.hour) AS hours FROM rd LEFT JOIN hres ON rd.day = hres.day GROUP BY rd.nr, rd.day", rep=True))
def evt_11(k: Lake) -> DataFrame:
    return grading.event_days(k.reports).join(hours_of(k), "day", "left").groupBy("nr", "day").agg(F.count_if(col("residual") > 0.7).alias("above"), F.count("hour").alias("hours"))


@query("evt_12_cumulative", tel_sql(f"{PEAK_SQL}, {REP_DAYS_SQL}, {THR_SQL}, x AS (SELECT threshold, day, CASE WHEN peak > threshold THEN 1 ELSE 0 END AS a, CASE WHEN peak > threshold AND day IN (SELECT day FROM rd) THEN 1 ELSE 0 END AS t FROM peaks, thr) SELECT threshold, day, CAST(sum(a) OVER w AS BIGINT) AS alarms_so_far, CAST(sum(t) OVER w AS BIGINT) AS true_so_far FROM x WINDOW w AS (PARTITION BY threshold ORDER BY day)", rep=True))
def evt_12(k: Lake) -> DataFrame:
    return grading.cumulative_alarms(peaks_of(k), k.reports, thresholds_of(k))


@query("evt_13_grid_search", tel_sql(f"""o AS (SELECT {r('avg(dv)', 6)} AS duty, {r('count(*) FILTER (WHERE dv = 1) / 1000.0 + 1', 3)} AS starts FROM tel),
 g AS (SELECT 0.5 + 0.05 * a.i AS fill, 0.3 + 0.02 * b.i AS consumption FROM range(33) a(i), range(31) b(i)),
 d AS (SELECT fill::DOUBLE AS fill, consumption::DOUBLE AS consumption, fill IN (0.5, 2.1) OR consumption IN (0.3, 0.9) AS edge, abs(consumption::DOUBLE / (fill::DOUBLE + consumption::DOUBLE) / duty - 1) AS de, abs(60.0 / (2.0 / fill::DOUBLE + 2.0 / consumption::DOUBLE) / starts - 1) AS se FROM g, o),
 e AS (SELECT 'duty' AS judged_by, fill, consumption, edge, {r('de', 9)} AS error FROM d UNION ALL SELECT 'starts', fill, consumption, edge, {r('se', 9)} FROM d UNION ALL SELECT 'both', fill, consumption, edge, {r('(de + se) / 2', 9)} FROM d),
 b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY judged_by ORDER BY error, fill, consumption) = 1)
 SELECT b.judged_by, {r('b.error', 6)} AS error, {r('b.fill', 6)} AS fill, {r('b.consumption', 6)} AS consumption, b.edge AS on_edge, count(*) AS ties, {r('min(e.fill)', 6)} AS low_fill, {r('max(e.fill)', 6)} AS high_fill, {r('min(e.consumption)', 6)} AS low_consumption, {r('max(e.consumption)', 6)} AS high_consumption FROM e JOIN b ON e.judged_by = b.judged_by WHERE e.error <= b.error + 0.002 GROUP BY b.judged_by, b.error, b.fill, b.consumption, b.edge"""))
def evt_13(k: Lake) -> DataFrame:
    o = k.tel.agg(round_half(F.avg("dv"), 6).alias("duty"), round_half(F.count_if(col("dv") == 1) / lit(1000.0) + 1, 3).alias("starts")).first()
    return plant.grid_search(k.spark, (33, 0.5, 0.05), (31, 0.3, 0.02), 2.0, o.duty, o.starts)


@query("evt_14_leak_sweep", tel_sql(f"f AS (SELECT {r('max(oil) / 100', 3)} AS step FROM tel), l AS (SELECT i * step AS leak FROM range(25) t(i), f) SELECT {r('leak', 6)} AS leak, {r(f'least(1.0, ({CONSUMPTION}::DOUBLE + leak) / {DELIVERY}::DOUBLE)', 6)} AS duty, {r(f'least(1.0, ({CONSUMPTION}::DOUBLE + leak) / {DELIVERY}::DOUBLE) * {DELIVERY}::DOUBLE - {CONSUMPTION}::DOUBLE', 6)} AS residual FROM l"))
def evt_14(k: Lake) -> DataFrame:
    step = k.tel.agg(round_half(F.max("oil") / 100, 3).alias("s")).first().s
    return plant.leak_sweep(k.spark, 25, step, DELIVERY, CONSUMPTION)


# ---- gold

CYCLE_SQL = f"{SILVER_SQL}, sl AS (SELECT *, lag(dv) OVER (PARTITION BY day ORDER BY timestamp) AS was FROM silver WHERE measured), cyc AS (SELECT day, CAST(sum(readings) AS BIGINT) AS readings, {r(f'count(*) * 100.0 / {FULL_DAY}', 2)} AS percent, count(*) > 0.9 * {FULL_DAY} AS complete, {r(f'count(*) FILTER (WHERE dv = 1) * 24.0 / {FULL_DAY}')} AS loaded_hours, count(*) FILTER (WHERE was = 0 AND dv = 1) AS starts, {r('avg(oil)')} AS mean_oil, count(*) FILTER (WHERE doubtful) AS doubtful FROM sl GROUP BY day)"
HOURLY_SQL = f"{SILVER_SQL}, {SLOW_SQL}, gh AS (SELECT date_trunc('hour', timestamp) AS hour, {r('avg(oil)')} AS oil, {r('avg(dv)', 6)} AS duty, CAST(sum(readings) AS BIGINT) AS readings FROM silver WHERE measured GROUP BY 1), gold_h AS (SELECT hour, gh.oil, gh.duty, gh.readings, street, {r('gh.oil - street')} AS oil_over_street FROM gh JOIN slow USING (hour))"


@query("gld_01_daily_cycle", tel_sql(f"{CYCLE_SQL} SELECT * FROM cyc"))
def gld_01(k: Lake) -> DataFrame:
    return gold.daily_cycle(silver(k), FULL_DAY)


@query("gld_02_hours", tel_sql(f"{HOURLY_SQL} SELECT * FROM gold_h"))
def gld_02(k: Lake) -> DataFrame:
    return gold.hours(silver(k), slow_source(k))


@query("gld_03_failures", tel_sql(f"{CYCLE_SQL} SELECT nr, began, ended, {r('date_diff(' + chr(39) + 'second' + chr(39) + ', began, ended) / 3600.0', 2)} AS report_hours, failure, count(cyc.day) AS days_with_data, {r('sum(loaded_hours)')} AS loaded_hours, CAST(sum(starts) AS BIGINT) AS starts, {r('avg(mean_oil)')} AS mean_oil FROM rep LEFT JOIN cyc ON cyc.day BETWEEN CAST(began AS DATE) AND CAST(ended AS DATE) GROUP BY nr, began, ended, failure", rep=True))
def gld_03(k: Lake) -> DataFrame:
    return gold.failures(k.reports, gld_01(k))


@query("gld_04_monthly", tel_sql(f"{HOURLY_SQL} SELECT strftime(hour, '%Y-%m') AS month, count(*) AS hours, {r('avg(oil)')} AS oil, {r('avg(street)')} AS street FROM gold_h GROUP BY 1"))
def gld_04(k: Lake) -> DataFrame:
    return gold.monthly(gld_02(k))


@query("gld_05_days", tel_sql(f"{SILVER_SQL} SELECT day, CAST(sum(readings) AS BIGINT) AS readings, {r(f'coalesce(sum(dv), 0) * {MINUTES / 60}::DOUBLE')} AS loaded_hours FROM silver GROUP BY day"))
def gld_05(k: Lake) -> DataFrame:
    return gold.day_dimension(silver(k), MINUTES)
