"""A fleet: the operators that order, segment, grade or sum a record, by machine (events of four machines told apart by user)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.operators import gold, grading, plant, profile, residual
from telemill.operators.resample import resample
from telemill.plans.registry import ORDER, Lake, query, r, tel_sql
from telemill.plans.relational import SLOW_SQL, slow_source
from telemill.plans.timeseries import ALARM_LEVEL, EXTRA, MINUTES, THR_SQL, extra_report, thresholds_of
from telemill.sources.telemetry import CONSUMPTION, DELIVERY, HEALTHY

col, lit = F.col, F.lit
KEYS, MACHINES, FAR, LEAST, STEP = ["machine"], 4, 7200, 3, 3600
FLEET_SQL = f"fleet AS (SELECT *, user_id % {MACHINES} AS machine FROM tel)"
SEG_SQL = f"""{FLEET_SQL}, s AS (SELECT *, lag(dv) OVER m AS was, lag(timestamp) OVER m AS prev FROM fleet WINDOW m AS (PARTITION BY machine ORDER BY timestamp, event_id)),
 seg AS (SELECT *, CAST(sum(CASE WHEN was IS DISTINCT FROM dv THEN 1 ELSE 0 END) OVER (PARTITION BY machine ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM s),
 segs AS (SELECT machine, segment, max(dv) AS state, count(*) AS readings, max(coalesce(was = dv AND date_diff('second', prev, timestamp) > {FAR}, FALSE)) AS broken, arg_min(pressure, (timestamp, event_id)) AS first_value, arg_max(pressure, (timestamp, event_id)) AS last_value FROM seg GROUP BY machine, segment),
 clean AS (SELECT *, (readings - 1) * {MINUTES}::DOUBLE AS minutes, last_value - first_value AS change FROM segs WHERE NOT broken AND readings > 1)"""
RES_SQL = f"""{FLEET_SQL}, hres AS (SELECT machine, date_trunc('hour', timestamp) AS hour, CAST(timestamp AS DATE) AS day, count(*) AS readings, {r('avg(dv)', 6)} AS duty, {r(f'avg(dv) * {DELIVERY}::DOUBLE - {CONSUMPTION}::DOUBLE', 6)} AS residual FROM fleet GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST}),
 peaks AS (SELECT machine, day, max(residual) AS peak FROM hres GROUP BY 1, 2)"""
REP_SQL = "frep AS (SELECT CAST(m.machine AS BIGINT) AS machine, rep.* FROM rep, (VALUES (0), (1), (2)) m(machine)), rd AS (SELECT *, CAST(unnest(generate_series(CAST(began AS DATE)::TIMESTAMP, CAST(ended AS DATE)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM frep)"
EPI_SQL = f"{RES_SQL}, al AS (SELECT machine, day FROM peaks WHERE peak > {ALARM_LEVEL}), e1 AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY machine ORDER BY day) <= 1 THEN 0 ELSE 1 END AS fresh FROM al), e2 AS (SELECT *, sum(fresh) OVER (PARTITION BY machine ORDER BY day) AS e FROM e1), epi AS (SELECT machine, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM e2 GROUP BY machine, e)"
MIN_SQL = f"""{FLEET_SQL}, mins AS (SELECT machine, day, hour(timestamp) * 60 + minute(timestamp) AS minute, CAST(max(dv) AS BIGINT) AS loaded FROM fleet GROUP BY 1, 2, 3),
 curve AS (SELECT d.machine, d.day, m.minute, coalesce(loaded, 0) AS loaded, CASE WHEN loaded IS NULL THEN 0 ELSE 1 END AS recorded FROM (SELECT DISTINCT machine, day FROM fleet) d CROSS JOIN (SELECT unnest(range(1440)) AS minute) m LEFT JOIN mins ON mins.machine = d.machine AND mins.day = d.day AND mins.minute = m.minute),
 quarter AS (SELECT machine, day, CAST(minute // 15 AS BIGINT) AS slot, CAST(sum(loaded) AS BIGINT) AS loaded, CAST(sum(recorded) AS BIGINT) AS recorded FROM curve GROUP BY 1, 2, 3)"""
DAY_W = "(PARTITION BY machine, day ORDER BY slot)"
GRID_SQL = f"""{FLEET_SQL}, b AS (SELECT machine, time_bucket(INTERVAL {STEP} SECOND, min(timestamp)) AS lo, time_bucket(INTERVAL {STEP} SECOND, max(timestamp)) AS hi FROM fleet GROUP BY 1), grid AS (SELECT machine, unnest(generate_series(lo, hi, INTERVAL {STEP} SECOND)) AS slot FROM b),
 merged AS (SELECT machine, time_bucket(INTERVAL {STEP} SECOND, timestamp) AS slot, count(*) AS readings, max(dv = comp) AS doubtful, {r('avg(oil)')} AS oil, max(dv) AS dv FROM fleet GROUP BY 1, 2),
 silver AS (SELECT g.machine, g.slot AS timestamp, CAST(g.slot AS DATE) AS day, coalesce(readings, 0) AS readings, readings IS NOT NULL AS measured, coalesce(doubtful, FALSE) AS doubtful, oil, dv FROM grid g LEFT JOIN merged m ON g.machine = m.machine AND g.slot = m.slot)"""
HOURS_SQL = f"{GRID_SQL}, {SLOW_SQL}, gh AS (SELECT machine, timestamp AS hour, {r('avg(oil)')} AS oil, {r('avg(dv)', 6)} AS duty, CAST(sum(readings) AS BIGINT) AS readings FROM silver WHERE measured GROUP BY 1, 2), gold_h AS (SELECT machine, gh.hour, gh.oil, gh.duty, gh.readings, street, {r('gh.oil - street')} AS oil_over_street FROM gh JOIN slow ON gh.hour = slow.hour)"
CYCLE_SQL = f"{GRID_SQL}, sl AS (SELECT *, lag(dv) OVER (PARTITION BY machine, day ORDER BY timestamp) AS was FROM silver WHERE measured), cyc AS (SELECT machine, day, CAST(sum(readings) AS BIGINT) AS readings, {r('count(*) FILTER (WHERE dv = 1) * 24.0 / 24')} AS loaded_hours, count(*) FILTER (WHERE was = 0 AND dv = 1) AS starts, {r('avg(oil)')} AS mean_oil FROM sl GROUP BY 1, 2)"


def fleet(k: Lake) -> DataFrame:
    return k.tel.withColumn("machine", col("user_id") % MACHINES)


def clean(k: Lake) -> DataFrame:
    return plant.clean_segments(fleet(k), "dv", "pressure", FAR, ORDER, MINUTES, KEYS)


def hours_of(k: Lake) -> DataFrame:
    return residual.hourly_residual(fleet(k), "dv", DELIVERY, CONSUMPTION, LEAST, keys=KEYS)


def peaks_of(k: Lake) -> DataFrame:
    return residual.daily_peaks(hours_of(k), KEYS)


def reports_of(k: Lake) -> DataFrame:
    """Three machines with the documented failures, one without any."""
    return k.reports.crossJoin(k.spark.range(3).withColumnRenamed("id", "machine"))


def quarters(k: Lake) -> DataFrame:
    return residual.minute_curve(fleet(k), "dv", 15, keys=KEYS)


def silver(k: Lake) -> DataFrame:
    return resample(fleet(k), "timestamp", STEP, ["oil"], ["dv"], col("dv") == col("comp"), KEYS)


@query("fleet_ts_10_sampling", tel_sql(f"{FLEET_SQL}, g AS (SELECT machine, date_diff('minute', lag(timestamp) OVER (PARTITION BY machine ORDER BY timestamp, event_id), timestamp) AS gap FROM fleet), n AS (SELECT machine, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2) SELECT machine, arg_max(gap, n * 100000 - gap) AS period, CAST(sum(n) - max(n) AS BIGINT) AS irregular, CAST(sum(n) AS BIGINT) AS gaps, round((sum(n) - max(n)) / sum(n), 6) AS share FROM n GROUP BY machine"))
def fleet_ts_10(k: Lake) -> DataFrame:
    return profile.sampling(fleet(k), ORDER, "minute", keys=KEYS)


@query("fleet_ts_18_thresholds", tel_sql(f"{SEG_SQL} SELECT machine, CASE WHEN dv = 1 THEN 'start' ELSE 'stop' END AS direction, count(*) AS n, {r('median(pressure)')} AS threshold FROM s WHERE was <> dv GROUP BY 1, 2"))
def fleet_ts_18(k: Lake) -> DataFrame:
    return plant.thresholds(fleet(k), "dv", "pressure", ORDER, keys=KEYS)


@query("fleet_ts_20_durations", tel_sql(f"{SEG_SQL} SELECT machine, state, count(*) AS n, {r('median(minutes)')} AS typical_minutes, {r('max(minutes)')} AS longest FROM clean GROUP BY 1, 2"))
def fleet_ts_20(k: Lake) -> DataFrame:
    return plant.durations(clean(k), KEYS)


@query("fleet_ts_21_balance", tel_sql(f"{SEG_SQL}, b AS (SELECT machine, sum(change) FILTER (WHERE state = 1) AS gained, -sum(change) FILTER (WHERE state = 0) AS lost, sum(minutes) FILTER (WHERE state = 1) AS lm, sum(minutes) FILTER (WHERE state = 0) AS im FROM clean GROUP BY 1) SELECT machine, {r('gained')} AS gained, {r('lost')} AS lost, {r('lm')} AS loaded_minutes, {r('im')} AS idle_minutes, {r('gained / lm', 6)} AS fill_rate, {r('lost / im', 6)} AS drain_rate, {r('lm / (lm + im)', 6)} AS duty, {r('(gained - lost) / greatest(abs(gained), abs(lost))', 6)} AS imbalance FROM b"))
def fleet_ts_21(k: Lake) -> DataFrame:
    return plant.balance(clean(k), KEYS)


@query("fleet_ts_22_slopes", tel_sql(f"{FLEET_SQL}, s AS (SELECT machine, dv, lead(dv) OVER w AS nx, lead(pressure) OVER w - pressure AS d FROM fleet WINDOW w AS (PARTITION BY machine, day ORDER BY timestamp, event_id)) SELECT machine, {r('median(d) FILTER (WHERE nx = dv AND dv = 1)')} AS loaded_step, {r('median(d) FILTER (WHERE nx = dv AND dv = 0)')} AS idle_step, {r('min(abs(d)) FILTER (WHERE abs(d) > 1e-9)')} AS smallest_step FROM s GROUP BY 1"))
def fleet_ts_22(k: Lake) -> DataFrame:
    return plant.slopes(fleet(k), "dv", "pressure", ORDER, keys=KEYS)


@query("fleet_ts_23_ramp", tel_sql(f"{SEG_SQL}, x AS (SELECT machine, row_number() OVER w - 1 AS step, pressure - lag(pressure) OVER w AS d FROM seg WHERE dv = 1 WINDOW w AS (PARTITION BY machine, segment ORDER BY timestamp, event_id)) SELECT machine, step, count(*) AS n, {r('median(d)')} AS change FROM x WHERE step BETWEEN 1 AND 10 GROUP BY 1, 2"))
def fleet_ts_23(k: Lake) -> DataFrame:
    return plant.ramp(fleet(k), "dv", "pressure", ORDER, keys=KEYS)


@query("fleet_ts_28_noise_floor", tel_sql(f"{RES_SQL} SELECT machine, count(*) AS hours, {r('quantile_cont(residual, 0.5)', 6)} AS median, {r('quantile_cont(residual, 0.95)', 6)} AS p95, {r('quantile_cont(residual, 0.99)', 6)} AS p99, max(residual) AS high FROM hres WHERE day BETWEEN DATE '{HEALTHY[0]}' AND DATE '{HEALTHY[1]}' GROUP BY 1"))
def fleet_ts_28(k: Lake) -> DataFrame:
    return residual.noise_floor(hours_of(k), *HEALTHY, keys=KEYS)


@query("fleet_ts_39_minute_curve", tel_sql(f"{MIN_SQL} SELECT * FROM quarter"))
def fleet_ts_39(k: Lake) -> DataFrame:
    return quarters(k)


@query("fleet_ts_40_regrain", tel_sql(f"{MIN_SQL} SELECT *, CAST(sum(loaded) OVER {DAY_W} AS BIGINT) AS loaded_so_far, CAST(sum(recorded) OVER {DAY_W} AS BIGINT) AS recorded_so_far FROM quarter"))
def fleet_ts_40(k: Lake) -> DataFrame:
    return residual.cumulative(quarters(k), ["loaded", "recorded"], KEYS)


@query("fleet_ts_41_carry_free", tel_sql(f"{MIN_SQL}, q AS (SELECT machine, day, slot, round_even(sum(loaded) OVER {DAY_W} * 0.3::DOUBLE, 0) AS run FROM quarter) SELECT machine, day, slot, CAST(run - coalesce(lag(run) OVER {DAY_W}, 0) AS BIGINT) AS whole FROM q"))
def fleet_ts_41(k: Lake) -> DataFrame:
    return residual.carry_free(quarters(k), "loaded", 0.3, KEYS).select(*KEYS, "day", "slot", "whole")


@query("fleet_ts_42_record_gaps", tel_sql(f"{MIN_SQL}, e AS (SELECT machine, day, slot, slot - row_number() OVER {DAY_W} AS g FROM quarter WHERE recorded = 0) SELECT machine, day, min(slot) AS from_slot, max(slot) + 1 AS to_slot FROM e GROUP BY machine, day, g"))
def fleet_ts_42(k: Lake) -> DataFrame:
    return residual.record_gaps(quarters(k), KEYS)


@query("fleet_ts_43_healthy_band", tel_sql(f"{MIN_SQL} SELECT machine, day, slot, {r(f'sum(recorded) OVER {DAY_W} * ({CONSUMPTION}::DOUBLE + 0.1165::DOUBLE) / {DELIVERY}::DOUBLE')} AS most FROM quarter"))
def fleet_ts_43(k: Lake) -> DataFrame:
    return residual.healthy_band(quarters(k), DELIVERY, CONSUMPTION, 0.1165, KEYS)


@query("fleet_evt_02_episodes", tel_sql(f"{EPI_SQL} SELECT * FROM epi"))
def fleet_evt_02(k: Lake) -> DataFrame:
    return grading.episodes(peaks_of(k).where(col("peak") > ALARM_LEVEL), KEYS).drop("episode")


@query("fleet_evt_03_sweep", tel_sql(f"""{RES_SQL}, {REP_SQL}, {THR_SQL}, ev AS (SELECT machine, nr, began, day, FALSE AS x FROM rd UNION ALL SELECT 1, '{EXTRA[0]}', TIMESTAMP '{EXTRA[1]}', unnest([DATE '2024-01-15', DATE '2024-01-16']), TRUE),
 f AS (SELECT machine, day, bool_or(NOT x) AS own FROM ev GROUP BY 1, 2), a AS (SELECT p.machine, threshold, p.day, peak > threshold AS alarm, coalesce(own, FALSE) AS own, f.day IS NOT NULL AS any_ev FROM peaks p CROSS JOIN thr LEFT JOIN f ON f.day = p.day AND f.machine = p.machine),
 e AS (SELECT a.machine, threshold, count(DISTINCT ev.began) FILTER (WHERE NOT x) AS detected, count(DISTINCT ev.began) AS detected_with FROM a JOIN ev ON a.day = ev.day AND a.machine = ev.machine WHERE alarm GROUP BY 1, 2),
 c AS (SELECT machine, threshold, count(*) FILTER (WHERE alarm) AS alarm_days, count(*) FILTER (WHERE alarm AND NOT own) AS false_days, count(*) FILTER (WHERE alarm AND NOT any_ev) AS false_days_with FROM a GROUP BY 1, 2), m AS (SELECT machine, count(DISTINCT strftime(day, '%Y-%m')) AS m FROM peaks GROUP BY 1)
 SELECT machine, threshold, alarm_days, coalesce(detected, 0) AS detected, false_days, coalesce(detected_with, 0) AS detected_with, false_days_with, {r('false_days / m')} AS false_per_month, {r('false_days_with / m')} AS false_per_month_with FROM c LEFT JOIN e USING (machine, threshold) JOIN m USING (machine)""", rep=True))
def fleet_evt_03(k: Lake) -> DataFrame:
    extra = extra_report(k).withColumn("machine", lit(1).cast("bigint"))
    return grading.sweep(peaks_of(k), reports_of(k), thresholds_of(k), keys=KEYS, extra=extra)


@query("fleet_evt_04_lead_times", tel_sql(f"{EPI_SQL}, {REP_SQL}, j AS (SELECT frep.machine, nr, began, CAST(began AS DATE) AS sd, first_day, days FROM frep LEFT JOIN epi ON epi.machine = frep.machine AND first_day < CAST(began AS DATE) AND CAST(began AS DATE) <= last_day + 1) SELECT machine, nr, began, min(first_day) AS episode_from, sd - min(first_day) AS lead_days, arg_min(days, first_day) AS episode_days FROM j GROUP BY machine, nr, began, sd", rep=True))
def fleet_evt_04(k: Lake) -> DataFrame:
    return grading.lead_times(peaks_of(k).where(col("peak") > ALARM_LEVEL), reports_of(k), KEYS)


@query("fleet_evt_05_false_alarms", tel_sql(f"{RES_SQL}, {REP_SQL}, n AS (SELECT p.machine, count(*) FILTER (WHERE peak > {ALARM_LEVEL} AND d.day IS NULL) AS false_days, count(DISTINCT month(p.day)) AS m FROM peaks p LEFT JOIN (SELECT DISTINCT machine, day FROM rd) d ON d.machine = p.machine AND d.day = p.day GROUP BY 1) SELECT machine, false_days, {r('false_days / m')} AS per_month FROM n", rep=True))
def fleet_evt_05(k: Lake) -> DataFrame:
    return grading.false_alarms(peaks_of(k), reports_of(k), ALARM_LEVEL, keys=KEYS)


@query("fleet_evt_09_day_classes", tel_sql(f"{RES_SQL}, {REP_SQL} SELECT p.machine, p.day, peak, CASE WHEN d.day IS NOT NULL AND peak > {ALARM_LEVEL} THEN 'hit' WHEN d.day IS NOT NULL THEN 'missed' WHEN peak > {ALARM_LEVEL} THEN 'false' WHEN peak > 0.7 THEN 'above noise' ELSE 'normal' END AS class FROM peaks p LEFT JOIN (SELECT DISTINCT machine, day FROM rd) d ON d.machine = p.machine AND d.day = p.day", rep=True))
def fleet_evt_09(k: Lake) -> DataFrame:
    return grading.classify_days(peaks_of(k).select(*KEYS, "day", "peak"), reports_of(k), ALARM_LEVEL, 0.7, keys=KEYS)


@query("fleet_evt_12_cumulative", tel_sql(f"{RES_SQL}, {REP_SQL}, {THR_SQL}, x AS (SELECT p.machine, threshold, p.day, CASE WHEN peak > threshold THEN 1 ELSE 0 END AS a, CASE WHEN peak > threshold AND d.day IS NOT NULL THEN 1 ELSE 0 END AS t FROM peaks p CROSS JOIN thr LEFT JOIN (SELECT DISTINCT machine, day FROM rd) d ON d.machine = p.machine AND d.day = p.day) SELECT machine, threshold, day, CAST(sum(a) OVER w AS BIGINT) AS alarms_so_far, CAST(sum(t) OVER w AS BIGINT) AS true_so_far FROM x WINDOW w AS (PARTITION BY machine, threshold ORDER BY day)", rep=True))
def fleet_evt_12(k: Lake) -> DataFrame:
    return grading.cumulative_alarms(peaks_of(k), reports_of(k), thresholds_of(k), keys=KEYS)


@query("fleet_gld_02_hours", tel_sql(f"{HOURS_SQL} SELECT * FROM gold_h"))
def fleet_gld_02(k: Lake) -> DataFrame:
    return gold.hours(silver(k), slow_source(k), keys=KEYS)


@query("fleet_gld_03_failures", tel_sql(f"{CYCLE_SQL}, {REP_SQL} SELECT frep.machine, nr, began, ended, {r('date_diff(' + chr(39) + 'second' + chr(39) + ', began, ended) / 3600.0', 2)} AS report_hours, failure, count(cyc.day) AS days_with_data, {r('sum(loaded_hours)')} AS loaded_hours, CAST(sum(starts) AS BIGINT) AS starts, {r('avg(mean_oil)')} AS mean_oil FROM frep LEFT JOIN cyc ON cyc.machine = frep.machine AND cyc.day BETWEEN CAST(began AS DATE) AND CAST(ended AS DATE) GROUP BY frep.machine, nr, began, ended, failure", rep=True))
def fleet_gld_03(k: Lake) -> DataFrame:
    return gold.failures(reports_of(k), gold.daily_cycle(silver(k), 24, keys=KEYS), KEYS)


@query("fleet_gld_04_monthly", tel_sql(f"{HOURS_SQL} SELECT machine, strftime(hour, '%Y-%m') AS month, count(*) AS hours, {r('avg(oil)')} AS oil, {r('avg(street)')} AS street FROM gold_h GROUP BY 1, 2"))
def fleet_gld_04(k: Lake) -> DataFrame:
    return gold.monthly(fleet_gld_02(k), KEYS)


@query("fleet_gld_05_days", tel_sql(f"{GRID_SQL} SELECT machine, day, CAST(sum(readings) AS BIGINT) AS readings, {r('coalesce(sum(dv), 0)')} AS loaded_hours FROM silver GROUP BY 1, 2"))
def fleet_gld_05(k: Lake) -> DataFrame:
    return gold.day_dimension(silver(k), 60, KEYS)
