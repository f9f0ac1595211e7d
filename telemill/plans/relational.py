"""Projection, filters, joins, aggregates, windows, sorts, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from telemill.functions import boundary_diff, bucket, epoch_seconds, frame_median, month_of, on_days, round_half, share, trunc_ts, upper_median
from telemill.functions.canonical import hash_sql, row_hash
from telemill.operators.intervals import interval_join
from telemill.operators.quantiles import quantiles
from telemill.operators.ranks import global_rank, same_order, trailing
from telemill.operators.windows import islands, ordered_lag, ordered_running_sum, segment_rows, segment_steps
from telemill.plans.registry import ORDER, Lake, query, r, tel_sql

col, lit = F.col, F.lit

# ---- projection


@query("prj_01_rename", tel_sql("SELECT timestamp AS at, day, oil AS oil_temperature, dv * 2 AS twice FROM tel"))
def prj_01(k: Lake) -> DataFrame:
    return k.tel.select(col("timestamp").alias("at"), "day", col("oil").alias("oil_temperature"), (col("dv") * 2).alias("twice"))


@query("prj_02_exclude", "SELECT * EXCLUDE (props, user_id) FROM events")
def prj_02(k: Lake) -> DataFrame:
    return k.table("events").drop("props", "user_id")


@query("prj_03_dynamic_columns", tel_sql(f"SELECT event_id, {', '.join(f'{r(c)} AS {c}' for c in ('pressure', 'oil', 'current'))} FROM tel"))
def prj_03(k: Lake) -> DataFrame:
    return k.tel.select("event_id", *[round_half(c, 3).alias(c) for c in ("pressure", "oil", "current")])


# ---- filters


@query("flt_01_equal_and", tel_sql("SELECT event_id, timestamp, pressure FROM tel WHERE lps = 1 AND pressure > 300"))
def flt_01(k: Lake) -> DataFrame:
    return k.tel.where((col("lps") == 1) & (col("pressure") > 300)).select("event_id", "timestamp", "pressure")


@query("flt_02_between", tel_sql("SELECT event_id, day FROM tel WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-05' AND timestamp >= TIMESTAMP '2024-01-03 06:00:00' AND timestamp < TIMESTAMP '2024-01-05 18:00:00'"))
def flt_02(k: Lake) -> DataFrame:
    at = lambda s: lit(s).cast("timestamp_ntz")
    return on_days(k.tel, "2024-01-03", "2024-01-05").where((col("timestamp") >= at("2024-01-03 06:00:00")) & (col("timestamp") < at("2024-01-05 18:00:00"))).select("event_id", "day")


@query("flt_03_in_list", "SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'error') AND user_id NOT IN (1, 2, 3)")
def flt_03(k: Lake) -> DataFrame:
    return k.table("events").where(col("event_type").isin("view", "error") & ~col("user_id").isin(1, 2, 3)).select("event_id", "event_type")


@query("flt_04_like_and_time", tel_sql("SELECT nr, began, failure, (SELECT count(*) FROM tel WHERE day = CAST(began AS DATE)) AS readings FROM rep WHERE failure LIKE 'Air L%' AND began < TIMESTAMP '2024-01-20 00:00:00'", rep=True))
def flt_04(k: Lake) -> DataFrame:
    hit = k.reports.where(col("failure").like("Air L%") & (col("began") < lit("2024-01-20").cast("timestamp_ntz"))).withColumn("day", F.to_date("began"))
    n = k.tel.groupBy("day").agg(F.count("*").alias("readings"))  # by day first: the record never meets the few reports
    return hit.join(n, "day", "left").select("nr", "began", "failure", F.coalesce("readings", lit(0).cast("bigint")).alias("readings"))


@query("flt_05_null_tests", "SELECT count(*) AS n, count(*) FILTER (WHERE x IS NULL) AS n_null, count(*) FILTER (WHERE x IS NOT NULL) AS n_there, count(*) FILTER (WHERE x = NULL) AS n_equal FROM (SELECT CASE WHEN event_type = 'click' THEN NULL ELSE value END AS x FROM events)")
def flt_05(k: Lake) -> DataFrame:
    x = F.when(col("event_type") != "click", col("value"))
    return k.table("events").select(x.alias("x")).agg(F.count("*").alias("n"), F.count_if(col("x").isNull()).alias("n_null"), F.count_if(col("x").isNotNull()).alias("n_there"), F.count_if(col("x") == lit(None)).alias("n_equal"))


@query("flt_06_is_distinct_from", "SELECT event_id FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS a, CASE WHEN value > 100 THEN NULL ELSE 'view' END AS b FROM events) WHERE a IS DISTINCT FROM b")
def flt_06(k: Lake) -> DataFrame:
    t = k.table("events").select("event_id", F.when(col("event_type") != "click", col("event_type")).alias("a"), F.when(col("value") <= 100, "view").alias("b"))
    return t.where(~col("a").eqNullSafe(col("b"))).select("event_id")


@query("flt_07_float_equality", tel_sql(f"s AS (SELECT DISTINCT pressure FROM tel), near AS (SELECT pressure FROM s ORDER BY abs(pressure - 8.2), pressure LIMIT 4) SELECT 'exact' AS what, count(*)::DOUBLE AS x FROM tel WHERE pressure = 8.2 UNION ALL SELECT 'rounded', count(*)::DOUBLE FROM tel WHERE {r('pressure', 1)} = 8.2 UNION ALL SELECT 'neighbour', pressure FROM near"))
def flt_07(k: Lake) -> DataFrame:
    n = F.count("*").cast("double").alias("x")
    exact = k.tel.where(col("pressure") == 8.2).agg(n).select(lit("exact").alias("what"), "x")
    rounded = k.tel.where(round_half("pressure", 1) == 8.2).agg(n).select(lit("rounded").alias("what"), "x")
    near = k.tel.select("pressure").distinct().orderBy(F.abs(col("pressure") - 8.2), "pressure").limit(4)
    return exact.union(rounded).union(near.select(lit("neighbour"), "pressure"))


@query("flt_08_contradiction", tel_sql("SELECT event_id, day, dv, comp FROM tel WHERE dv = comp"))
def flt_08(k: Lake) -> DataFrame:
    return k.tel.where(col("dv") == col("comp")).select("event_id", "day", "dv", "comp")


@query("flt_09_one_day", tel_sql("SELECT day, count(*) AS n FROM tel WHERE day = DATE '2024-01-12' GROUP BY day"))
def flt_09(k: Lake) -> DataFrame:
    return on_days(k.tel, "2024-01-12", "2024-01-12").groupBy("day").agg(F.count("*").alias("n"))


@query("flt_10_literal_types", "SELECT count(*) FILTER (WHERE 0.1 + 0.2 = 0.3) AS as_decimal, count(*) FILTER (WHERE 0.1::DOUBLE + 0.2::DOUBLE = 0.3::DOUBLE) AS as_double FROM events")
def flt_10(k: Lake) -> DataFrame:
    return k.table("events").agg(F.count_if(F.expr("0.1 + 0.2 = 0.3")).alias("as_decimal"), F.count_if(lit(0.1) + lit(0.2) == lit(0.3)).alias("as_double"))


# ---- joins

SLOW_SQL = f"slow AS (SELECT date_trunc('hour', timestamp) AS hour, {r('avg(pressure)')} AS street FROM tel WHERE event_type = 'view' GROUP BY 1), fast AS (SELECT date_trunc('hour', timestamp) AS hour, {r('avg(oil)')} AS oil, {r('avg(dv)')} AS duty, count(*) AS readings FROM tel WHERE event_type <> 'view' GROUP BY 1)"


def slow_source(k: Lake) -> DataFrame:
    """Hourly mean of one event type: the slow series (weather)."""
    return k.tel.where("event_type = 'view'").groupBy(trunc_ts("hour", "timestamp").alias("hour")).agg(round_half(F.avg("pressure"), 3).alias("street"))


def fast_hours(k: Lake) -> DataFrame:
    """All other readings brought to the hour."""
    return k.tel.where("event_type <> 'view'").groupBy(trunc_ts("hour", "timestamp").alias("hour")).agg(round_half(F.avg("oil"), 3).alias("oil"), round_half(F.avg("dv"), 3).alias("duty"), F.count("*").alias("readings"))


@query("joi_01_inner", "SELECT n.n_name, count(*) AS orders, round(sum(o.o_totalprice) * 100, 0) / 100 AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
def joi_01(k: Lake) -> DataFrame:
    j = k.table("orders").join(k.table("customer"), col("o_custkey") == col("c_custkey")).join(k.table("nation"), col("c_nationkey") == col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("orders"), round_half(F.sum("o_totalprice"), 2).alias("total"))


DAYS_SQL = "cal AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day)"


def calendar(k: Lake) -> DataFrame:
    return k.spark.range(30).select(F.date_add(lit("2024-01-01").cast("date"), col("id").cast("int")).alias("day"))


def with_holes(t: DataFrame) -> DataFrame:
    """The record without two of its days."""
    return t.where(~col("day").isin("2024-01-09", "2024-01-21"))


HOLES_SQL = "held AS (SELECT * FROM tel WHERE day NOT IN (DATE '2024-01-09', DATE '2024-01-21'))"


@query("joi_02_left_keeps_grid", tel_sql(f"{DAYS_SQL}, {HOLES_SQL}, n AS (SELECT day, count(*) AS readings FROM held GROUP BY day) SELECT cal.day, n.readings FROM cal LEFT JOIN n ON cal.day = n.day"))
def joi_02(k: Lake) -> DataFrame:
    return calendar(k).join(with_holes(k.tel).groupBy("day").agg(F.count("*").alias("readings")), "day", "left")


@query("joi_03_left_using", tel_sql(f"{DAYS_SQL}, {HOLES_SQL}, n AS (SELECT day, count(*) AS readings FROM held GROUP BY day) SELECT day FROM cal LEFT JOIN n USING (day) WHERE readings IS NULL"))
def joi_03(k: Lake) -> DataFrame:
    return joi_02(k).where("readings is null").select("day")


def report_days(k: Lake) -> DataFrame:
    """One row per report and day it touches: turns an interval join into an equi-join."""
    return k.reports.withColumn("day", F.explode(F.sequence(F.to_date("began"), F.to_date("ended"))))


REP_DAYS_SQL = "rd AS (SELECT nr, began, ended, failure, CAST(unnest(generate_series(CAST(began AS DATE)::TIMESTAMP, CAST(ended AS DATE)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM rep)"


@query("joi_04_range_left", tel_sql("n AS (SELECT day, count(*) AS readings FROM tel GROUP BY day) SELECT n.day, n.readings, rep.nr IS NOT NULL AS reported, rep.began FROM n LEFT JOIN rep ON n.day BETWEEN CAST(rep.began AS DATE) AND CAST(rep.ended AS DATE)", rep=True))
def joi_04(k: Lake) -> DataFrame:
    n = k.tel.groupBy("day").agg(F.count("*").alias("readings"))
    return interval_join(n, k.reports, "day", "began", "ended", how="left", exact=False).select("day", "readings", col("nr").isNotNull().alias("reported"), "began")


@query("joi_05_readings_per_report", tel_sql("SELECT rep.nr, rep.began, count(tel.event_id) AS readings, CAST(coalesce(sum(tel.dv), 0) AS BIGINT) AS loaded FROM rep LEFT JOIN tel ON tel.day BETWEEN CAST(rep.began AS DATE) AND CAST(rep.ended AS DATE) GROUP BY rep.nr, rep.began", rep=True))
def joi_05(k: Lake) -> DataFrame:
    n = k.tel.groupBy("day").agg(F.count("event_id").alias("n"), F.sum("dv").alias("up"))
    held = interval_join(n, k.reports.select("nr", "began", "ended"), "day", "began", "ended", exact=False).select("nr", "began", "n", "up")
    j = k.reports.select("nr", "began").join(held, ["nr", "began"], "left")
    return j.groupBy("nr", "began").agg(F.coalesce(F.sum("n"), lit(0)).alias("readings"), F.coalesce(F.sum("up"), lit(0.0)).cast("bigint").alias("loaded"))


@query("joi_06_counts_side_by_side", tel_sql("d AS (SELECT DISTINCT day FROM tel), c AS (SELECT CAST(began AS DATE) AS a, CAST(ended AS DATE) AS b FROM rep) SELECT (SELECT count(*) FROM d JOIN c ON day BETWEEN a AND b) AS n_inner, (SELECT count(*) FROM d LEFT JOIN c ON day BETWEEN a AND b) AS n_left, (SELECT count(*) FROM d, c) AS n_cross", rep=True))
def joi_06(k: Lake) -> DataFrame:
    d, rd = k.tel.select("day").distinct(), report_days(k)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(d.join(rd, "day"), "n_inner").crossJoin(n(d.join(rd, "day", "left"), "n_left")).crossJoin(n(d.crossJoin(k.reports), "n_cross"))


@query("joi_07_cross", "SELECT n.n_name, r.r_name FROM nation n CROSS JOIN region r")
def joi_07(k: Lake) -> DataFrame:
    return k.table("nation").select("n_name").crossJoin(k.table("region").select("r_name"))


@query("joi_08_fan_out", tel_sql("SELECT (SELECT count(*) FROM rep a JOIN rep b ON a.nr = b.nr) AS by_number, (SELECT count(*) FROM rep a JOIN rep b ON a.nr = b.nr AND a.began = b.began) AS by_key, (SELECT count(*) FROM events) AS readings", rep=True))
def joi_08(k: Lake) -> DataFrame:
    a, b = k.reports.alias("a"), k.reports.alias("b")
    one = a.join(b, col("a.nr") == col("b.nr")).agg(F.count("*").alias("by_number"))
    two = a.join(b, (col("a.nr") == col("b.nr")) & (col("a.began") == col("b.began"))).agg(F.count("*").alias("by_key"))
    return one.crossJoin(two).crossJoin(k.tel.agg(F.count("*").alias("readings")))


GRID_SQL = "bounds AS (SELECT time_bucket(INTERVAL 600 SECOND, min(timestamp)) AS lo, time_bucket(INTERVAL 600 SECOND, max(timestamp)) AS hi FROM tel), grid AS (SELECT unnest(generate_series(lo, hi, INTERVAL 600 SECOND)) AS slot FROM bounds)"


@query("joi_09_exact_grid", tel_sql(f"{GRID_SQL} SELECT count(*) AS kept, (SELECT count(*) FROM tel) AS readings FROM grid JOIN tel ON grid.slot = date_trunc('minute', tel.timestamp)"))
def joi_09(k: Lake) -> DataFrame:
    from telemill.operators.resample import slot_grid

    t = k.tel.withColumn("slot", trunc_ts("minute", "timestamp"))
    return slot_grid(k.tel, "timestamp", 600).join(t, "slot").agg(F.count("*").alias("kept")).crossJoin(k.tel.agg(F.count("*").alias("readings")))


@query("joi_10_anti", tel_sql(f"{DAYS_SQL}, {HOLES_SQL} SELECT day FROM cal WHERE day NOT IN (SELECT day FROM held)"))
def joi_10(k: Lake) -> DataFrame:
    return calendar(k).join(with_holes(k.tel).select("day").distinct(), "day", "left_anti")


@query("joi_11_semi", tel_sql("full_day AS (SELECT day FROM tel GROUP BY day HAVING count(*) > 320) SELECT event_id, day FROM tel WHERE day IN (SELECT day FROM full_day)"))
def joi_11(k: Lake) -> DataFrame:
    full = k.tel.groupBy("day").agg(F.count("*").alias("n")).where("n > 320")
    return k.tel.join(full, "day", "left_semi").select("event_id", "day")


HOURS_SQL = f"hrs AS (SELECT CAST(timestamp AS DATE) AS day, date_trunc('hour', timestamp) AS hour, {r('avg(dv)')} AS duty, count(*) AS readings FROM tel GROUP BY 1, 2)"


def hours(k: Lake) -> DataFrame:
    return k.tel.groupBy("day", trunc_ts("hour", "timestamp").alias("hour")).agg(round_half(F.avg("dv"), 3).alias("duty"), F.count("*").alias("readings"))


@query("joi_12_first_hour_of_peak", tel_sql(f"{HOURS_SQL} SELECT a.day, (SELECT min(b.hour) FROM hrs b WHERE b.day = a.day AND b.duty > 0.5) AS first_above, (SELECT min(b.hour) FROM hrs b WHERE b.day = a.day AND b.duty = max(a.duty)) AS peak_hour FROM hrs a GROUP BY a.day"))
def joi_12(k: Lake) -> DataFrame:
    h = hours(k)
    peak = h.groupBy("day").agg(F.max("duty").alias("peak"))
    return h.join(peak, "day").groupBy("day").agg(F.min(F.when(col("duty") > 0.5, col("hour"))).alias("first_above"), F.min(F.when(col("duty") == col("peak"), col("hour"))).alias("peak_hour"))


@query("joi_13_percent_of_total", tel_sql(f"SELECT event_type, count(*) AS n, {r('100.0 * count(*) / (SELECT count(*) FROM tel)')} AS percent FROM tel GROUP BY event_type"))
def joi_13(k: Lake) -> DataFrame:
    total = k.tel.agg(F.count("*").alias("total"))
    n = k.tel.groupBy("event_type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))
    return n.select("event_type", "n", round_half(lit(100.0) * col("n") / col("total"), 3).alias("percent"))


@query("joi_14_cross_frequency", tel_sql(f"{SLOW_SQL} SELECT hour, oil, duty, readings, street FROM fast JOIN slow USING (hour)"))
def joi_14(k: Lake) -> DataFrame:
    return fast_hours(k).join(slow_source(k), "hour")


@query("joi_15_point_in_interval", tel_sql("SELECT d.day, rep.nr, rep.began FROM (SELECT DISTINCT day FROM tel) d JOIN rep ON d.day >= CAST(rep.began AS DATE) AND d.day <= CAST(rep.ended AS DATE)", rep=True))
def joi_15(k: Lake) -> DataFrame:
    return interval_join(k.tel.select("day").distinct(), k.reports, "day", "began", "ended", exact=False).select("day", "nr", "began")


SPANS = [("years", "2021-03-01 00:00:00", "2024-01-20 12:00:00"), ("decades", "1969-12-31 00:00:00", "2031-05-05 05:05:05"), ("minutes", "2024-01-12 10:03:30", "2024-01-12 11:47:10"), ("seconds", "2024-01-15 00:00:05", "2024-01-15 00:20:09"), ("nothing", "2024-01-18 02:00:00", "2024-01-18 01:00:00")]
SPANS_SQL = "spans AS (SELECT name, CAST(a AS TIMESTAMP) AS began, CAST(b AS TIMESTAMP) AS ended FROM (VALUES " + ", ".join(str(x) for x in SPANS) + ") v(name, a, b))"


@query("joi_17_dyadic_cover", tel_sql(f"{SPANS_SQL} SELECT name, began, count(*) AS readings, {r('sum(pressure)', 2)} AS pressure, min(event_id) AS least_id FROM tel JOIN spans ON tel.timestamp BETWEEN began AND ended GROUP BY name, began"))
def joi_17(k: Lake) -> DataFrame:
    """Readings in intervals of decades and of minutes at once: blocks of seconds of several sizes, equi-joins only."""
    at = lambda c: col(c).cast("timestamp_ntz")
    spans = k.spark.createDataFrame(SPANS, "name string, a string, b string").select("name", at("a").alias("began"), at("b").alias("ended"))
    held = interval_join(k.tel, spans, "timestamp", "began", "ended", seconds=1)
    return held.groupBy("name", "began").agg(F.count("*").alias("readings"), round_half(F.sum("pressure"), 2).alias("pressure"), F.min("event_id").alias("least_id"))


@query("joi_16_interval_days", tel_sql(f"{REP_DAYS_SQL} SELECT nr, began, rd.day, count(event_id) AS readings FROM rd LEFT JOIN tel ON tel.day = rd.day GROUP BY nr, began, rd.day", rep=True))
def joi_16(k: Lake) -> DataFrame:
    n = k.tel.groupBy("day").agg(F.count("event_id").alias("n"))
    return report_days(k).join(n, "day", "left").select("nr", "began", "day", F.coalesce("n", lit(0).cast("bigint")).alias("readings"))


# ---- aggregates


@query("agg_01_global", f"SELECT count(*) AS n, min(value) AS low, max(value) AS high, {r('avg(value)')} AS mean, {r('sum(value)', 2)} AS total FROM events")
def agg_01(k: Lake) -> DataFrame:
    return k.table("events").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), round_half(F.avg("value"), 3).alias("mean"), round_half(F.sum("value"), 2).alias("total"))


@query("agg_02_empty_set", "SELECT count(*) AS n, avg(value) AS mean, min(value) AS low, sum(value) AS total FROM events WHERE value < -1")
def agg_02(k: Lake) -> DataFrame:
    return k.table("events").where("value < -1").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.sum("value").alias("total"))


@query("agg_03_group_keys", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_03(k: Lake) -> DataFrame:
    return k.table("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("agg_04_group_expression", tel_sql("SELECT CASE WHEN current < 10 THEN 'off' WHEN current < 100 THEN 'idle' ELSE 'loaded' END AS state, hour(timestamp) AS h, count(*) AS n FROM tel GROUP BY 1, 2"))
def agg_04(k: Lake) -> DataFrame:
    return k.tel.groupBy(current_state().alias("state"), F.hour("timestamp").cast("bigint").alias("h")).agg(F.count("*").alias("n"))


def current_state():
    return F.when(col("current") < 10, "off").when(col("current") < 100, "idle").otherwise("loaded")


@query("agg_05_conditional_sum", tel_sql("SELECT day, CAST(sum(CASE WHEN dv = 1 THEN 1 ELSE 0 END) AS BIGINT) AS loaded, count(CASE WHEN lps = 1 THEN 1 END) AS alarms FROM tel GROUP BY day"))
def agg_05(k: Lake) -> DataFrame:
    return k.tel.groupBy("day").agg(F.sum(F.when(col("dv") == 1, 1).otherwise(0)).alias("loaded"), F.count_if(col("lps") == 1).alias("alarms"))


@query("agg_06_filter_clause", tel_sql(f"SELECT count(*) FILTER (WHERE dv = 1) AS loaded, {r('sum(pressure) FILTER (WHERE comp = 1)', 2)} AS pressure_off FROM tel"))
def agg_06(k: Lake) -> DataFrame:
    return k.tel.agg(F.count_if(col("dv") == 1).alias("loaded"), round_half(F.sum(F.when(col("comp") == 1, col("pressure"))), 2).alias("pressure_off"))


@query("agg_07_having", tel_sql("SELECT day, count(*) AS n FROM tel GROUP BY day HAVING count(*) > 330"))
def agg_07(k: Lake) -> DataFrame:
    return k.tel.groupBy("day").agg(F.count("*").alias("n")).where("n > 330")


@query("agg_08_count_distinct", tel_sql("SELECT count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN dv = 1 THEN day END) AS loaded_days, count(DISTINCT lower(event_type)) AS kinds FROM tel"))
def agg_08(k: Lake) -> DataFrame:
    return k.tel.agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(col("dv") == 1, col("day"))).alias("loaded_days"), F.count_distinct(F.lower("event_type")).alias("kinds"))


TWO_LEVEL = f"SELECT month, count(*) AS days, {r('avg(duty)')} AS duty FROM (SELECT strftime(day, '%Y-%m') AS month, day, {r('avg(dv)', 6)} AS duty FROM tel GROUP BY 1, 2 HAVING count(*) > 0.9 * 144) GROUP BY month"


@query("agg_09_two_levels", tel_sql(TWO_LEVEL))
def agg_09(k: Lake) -> DataFrame:
    days = k.tel.groupBy(month_of("day").alias("month"), "day").agg(round_half(F.avg("dv"), 6).alias("duty"), F.count("*").alias("n")).where("n > 0.9 * 144")
    return days.groupBy("month").agg(F.count("*").alias("days"), round_half(F.avg("duty"), 3).alias("duty"))


@query("agg_10_named_steps", tel_sql(TWO_LEVEL))
def agg_10(k: Lake) -> DataFrame:
    """The two levels as named SQL steps; the same rows as the nested form."""
    k.tel.createOrReplaceTempView("tel_steps")
    return k.spark.sql("""
        WITH per_day AS (SELECT date_format(day, 'yyyy-MM') AS month, day, round(avg(dv) * 1e6D, 0) / 1e6D AS duty FROM tel_steps GROUP BY 1, 2 HAVING count(*) > 0.9 * 144)
        SELECT month, count(*) AS days, round(avg(duty) * 1e3D, 0) / 1e3D AS duty FROM per_day GROUP BY month""")


@query("agg_11_median", tel_sql(f"SELECT event_type, {r('median(pressure)')} AS mid, {r('median(CASE WHEN pressure > 50 THEN pressure END)')} AS mid_high FROM tel GROUP BY event_type"))
def agg_11(k: Lake) -> DataFrame:
    q = quantiles(k.tel, {"mid": (col("pressure"), 0.5), "mid_high": (F.when(col("pressure") > 50, col("pressure")), 0.5)}, keys=["event_type"])
    return q.select("event_type", *[round_half(c, 3).alias(c) for c in ("mid", "mid_high")])


@query("agg_12_quantiles", tel_sql(f"SELECT {r('quantile_cont(pressure, 0.95)')} AS p95, {r('quantile_cont(pressure, 0.99)')} AS p99 FROM tel"))
def agg_12(k: Lake) -> DataFrame:
    q = quantiles(k.tel, {"p95": (col("pressure"), 0.95), "p99": (col("pressure"), 0.99)})
    return q.select(*[round_half(c, 3).alias(c) for c in ("p95", "p99")])


@query("agg_25_ranks_selected", tel_sql(f"SELECT event_type, {r('quantile_cont(pressure, 0.1)')} AS p10, {r('median(oil)')} AS mid, {r('quantile_cont(pressure, 0.999)')} AS p999, count(*) AS n FROM tel GROUP BY event_type"))
def agg_25(k: Lake) -> DataFrame:
    """The same quantiles as from a group too large for a task: ranks are selected whatever the size."""
    q = quantiles(k.tel, {"p10": (col("pressure"), 0.1), "mid": (col("oil"), 0.5), "p999": (col("pressure"), 0.999)}, [F.count("*").alias("n")], ["event_type"], limit=20, accuracy=100)
    return q.select("event_type", *[round_half(c, 3).alias(c) for c in ("p10", "mid", "p999")], "n")


@query("agg_13_upper_median", tel_sql("n AS (SELECT event_type, day, count(*) AS c FROM tel GROUP BY 1, 2) SELECT event_type, (list_sort(list(c)))[len(list(c)) // 2 + 1] AS upper_mid FROM n GROUP BY event_type"))
def agg_13(k: Lake) -> DataFrame:
    return k.tel.groupBy("event_type", "day").agg(F.count("*").alias("c")).groupBy("event_type").agg(upper_median("c").alias("upper_mid"))


@query("agg_14_mode", tel_sql("SELECT event_type, count(*) AS n FROM tel GROUP BY event_type ORDER BY n DESC, event_type LIMIT 1"))
def agg_14(k: Lake) -> DataFrame:
    return k.tel.groupBy("event_type").agg(F.count("*").alias("n")).orderBy(col("n").desc(), "event_type").limit(1)


@query("agg_15_correlation", tel_sql(f"{SLOW_SQL} SELECT {r('corr(oil, street)', 6)} AS oil_street, {r('corr(oil, duty)', 6)} AS oil_duty FROM fast JOIN slow USING (hour)"))
def agg_15(k: Lake) -> DataFrame:
    return joi_14(k).agg(round_half(F.corr("oil", "street"), 6).alias("oil_street"), round_half(F.corr("oil", "duty"), 6).alias("oil_duty"))


@query("agg_16_first_last", tel_sql("SELECT day, arg_min(pressure, (timestamp, event_id)) AS first_pressure, arg_max(pressure, (timestamp, event_id)) AS last_pressure FROM tel GROUP BY day"))
def agg_16(k: Lake) -> DataFrame:
    return k.tel.groupBy("day").agg(F.min_by("pressure", F.struct(*ORDER)).alias("first_pressure"), F.max_by("pressure", F.struct(*ORDER)).alias("last_pressure"))


@query("agg_17_any_value", tel_sql("SELECT event_type, any_value(dv) AS dv, any_value(comp) AS comp FROM tel GROUP BY event_type"))
def agg_17(k: Lake) -> DataFrame:
    return k.tel.groupBy("event_type").agg(F.any_value("dv").alias("dv"), F.any_value("comp").alias("comp"))


@query("agg_18_duty", tel_sql(f"SELECT day, {r('avg(CASE WHEN dv = 1 THEN 1.0 ELSE 0.0 END)', 6)} AS duty FROM tel GROUP BY day"))
def agg_18(k: Lake) -> DataFrame:
    return k.tel.groupBy("day").agg(round_half(share(col("dv") == 1), 6).alias("duty"))


@query("agg_19_max_of_flags", tel_sql("SELECT time_bucket(INTERVAL 600 SECOND, timestamp) AS slot, max(dv) AS dv, max(comp) AS comp, max(lps) AS lps FROM tel GROUP BY 1"))
def agg_19(k: Lake) -> DataFrame:
    return k.tel.groupBy(bucket("timestamp", 600).alias("slot")).agg(*[F.max(c).alias(c) for c in ("dv", "comp", "lps")])


@query("agg_20_ratio_of_sums", tel_sql(f"SELECT day, {r('sum(oil * dv) / sum(dv)', 6)} AS oil_loaded FROM tel GROUP BY day"))
def agg_20(k: Lake) -> DataFrame:
    return k.tel.groupBy("day").agg(round_half(F.sum(col("oil") * col("dv")) / F.sum("dv"), 6).alias("oil_loaded"))


PERIODS = [("before", "2024-01-01", "2024-01-10"), ("during", "2024-01-11", "2024-01-20"), ("after", "2024-01-21", "2024-01-30")]


@query("agg_21_ranges_by_period", tel_sql("p AS (SELECT * FROM (VALUES ('before', DATE '2024-01-01', DATE '2024-01-10'), ('during', DATE '2024-01-11', DATE '2024-01-20'), ('after', DATE '2024-01-21', DATE '2024-01-30')) v(period, a, b)) SELECT period, min(pressure) AS low, max(pressure) AS high, min(oil) AS oil_low, max(oil) AS oil_high FROM tel JOIN p ON day BETWEEN a AND b GROUP BY period"))
def agg_21(k: Lake) -> DataFrame:
    p = k.spark.createDataFrame(PERIODS, "period string, a string, b string").select("period", F.explode(F.sequence(F.to_date("a"), F.to_date("b"))).alias("day"))
    return k.tel.join(p, "day").groupBy("period").agg(F.min("pressure").alias("low"), F.max("pressure").alias("high"), F.min("oil").alias("oil_low"), F.max("oil").alias("oil_high"))


WIDE = ("pressure", "oil", "current", "dv", "comp", "lps")


@query("agg_22_wide_profile", tel_sql(" UNION ALL ".join(f"SELECT '{c}' AS signal, count(DISTINCT {c}) AS n_distinct, min({c}) AS low, max({c}) AS high FROM tel" for c in WIDE)))
def agg_22(k: Lake) -> DataFrame:
    from telemill.operators.profile import profile_columns

    return profile_columns(k.tel, list(WIDE))


@query("agg_23_frequencies", tel_sql("g AS (SELECT date_diff('minute', lag(timestamp) OVER (ORDER BY timestamp, event_id), timestamp) AS gap FROM tel) SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY gap"))
def agg_23(k: Lake) -> DataFrame:
    g = ordered_lag(k.tel, {"timestamp": "p"}, ORDER).select(boundary_diff("minute", "p", "timestamp").alias("gap")).where("gap is not null")
    return g.groupBy("gap").agg(F.count("*").alias("n"))


@query("agg_24_histogram", tel_sql("SELECT CAST(floor(pressure / 10) AS INTEGER) + 1 AS bin, count(*) AS n FROM tel WHERE pressure >= 0 AND pressure < 600 GROUP BY 1"))
def agg_24(k: Lake) -> DataFrame:
    t = k.tel.where("pressure >= 0 and pressure < 600")
    return t.groupBy(F.width_bucket("pressure", lit(0.0), lit(600.0), lit(60)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


# ---- windows


@query("win_01_gap", tel_sql("SELECT event_id, date_diff('second', lag(timestamp) OVER (ORDER BY timestamp, event_id), timestamp) AS gap FROM tel"))
def win_01(k: Lake) -> DataFrame:
    return ordered_lag(k.tel, {"timestamp": "p"}, ORDER).select("event_id", boundary_diff("second", "p", "timestamp").alias("gap"))


@query("win_02_transitions", tel_sql("s AS (SELECT event_id, timestamp, dv, lag(dv) OVER (ORDER BY timestamp, event_id) AS was FROM tel) SELECT event_id, was, dv FROM s WHERE was <> dv"))
def win_02(k: Lake) -> DataFrame:
    return ordered_lag(k.tel, {"dv": "was"}, ORDER).where("was <> dv").select("event_id", "was", "dv")


@query("win_03_lag_in_day", tel_sql("s AS (SELECT day, dv, lag(dv) OVER (PARTITION BY day ORDER BY timestamp, event_id) AS was FROM tel) SELECT day, count(*) FILTER (WHERE was = 0 AND dv = 1) AS starts FROM s GROUP BY day"))
def win_03(k: Lake) -> DataFrame:
    was = F.lag("dv").over(W.partitionBy("day").orderBy(*ORDER))
    return k.tel.withColumn("was", was).groupBy("day").agg(F.count_if((col("was") == 0) & (col("dv") == 1)).alias("starts"))


@query("win_04_lead", tel_sql(f"SELECT event_id, {r('lead(pressure) OVER (PARTITION BY day ORDER BY timestamp, event_id) - pressure')} AS slope, lead(dv) OVER (PARTITION BY day ORDER BY timestamp, event_id) AS next_dv FROM tel"))
def win_04(k: Lake) -> DataFrame:
    w = W.partitionBy("day").orderBy(*ORDER)
    return k.tel.select("event_id", round_half(F.lead("pressure").over(w) - col("pressure"), 3).alias("slope"), F.lead("dv").over(w).alias("next_dv"))


SEG_SQL = "s AS (SELECT *, lag(dv) OVER (ORDER BY timestamp, event_id) AS was, lag(timestamp) OVER (ORDER BY timestamp, event_id) AS prev FROM tel), seg AS (SELECT *, CAST(sum(CASE WHEN was IS DISTINCT FROM dv THEN 1 ELSE 0 END) OVER (ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM s)"


@query("win_05_segment_id", tel_sql(f"{SEG_SQL} SELECT event_id, segment FROM seg"))
def win_05(k: Lake) -> DataFrame:
    return segment_rows(k.tel, "dv", ORDER).select("event_id", col("segment").cast("bigint").alias("segment"))


@query("win_06_row_number", tel_sql(f"{SEG_SQL} SELECT event_id, row_number() OVER (PARTITION BY segment ORDER BY timestamp, event_id) AS step FROM seg"))
def win_06(k: Lake) -> DataFrame:
    return segment_steps(segment_rows(k.tel, "dv", ORDER), {"pressure": "before"}, ORDER).select("event_id", "step")


@query("win_07_lag_in_segment", tel_sql(f"{SEG_SQL} SELECT event_id, lag(pressure) OVER (PARTITION BY segment ORDER BY timestamp, event_id) AS before FROM seg"))
def win_07(k: Lake) -> DataFrame:
    return segment_steps(segment_rows(k.tel, "dv", ORDER), {"pressure": "before"}, ORDER).select("event_id", "before")


@query("win_08_trailing_median", tel_sql(f"d AS (SELECT day, {r('max(pressure)')} AS peak FROM tel GROUP BY day) SELECT day, peak, {r('median(peak) OVER (ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)')} AS baseline FROM d"))
def win_08(k: Lake) -> DataFrame:
    d = k.tel.groupBy("day").agg(round_half(F.max("pressure"), 3).alias("peak"))
    return trailing(d, "day", 14, {"baseline": frame_median("peak")}).withColumn("baseline", round_half("baseline", 3))


@query("win_14_trailing_blocks", tel_sql(f"d AS (SELECT day, {r('max(pressure)')} AS peak, count(*) AS n FROM tel GROUP BY day) SELECT day, {r('median(peak) OVER w')} AS baseline, CAST(sum(n) OVER w AS BIGINT) AS readings_before FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"))
def win_14(k: Lake) -> DataFrame:
    """A series of many blocks: frames that reach over the edges of blocks of the calendar and of ranks."""
    d = k.tel.groupBy("day").agg(round_half(F.max("pressure"), 3).alias("peak"), F.count("*").alias("n"))
    out = trailing(d, "day", 3, {"baseline": frame_median("peak"), "readings_before": F.sum("n")}, block_rows=4, block_days=5)
    return out.select("day", round_half("baseline", 3).alias("baseline"), "readings_before")


@query("win_09_cumulative", tel_sql("SELECT event_id, day, CAST(sum(dv) OVER (PARTITION BY day ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS loaded_so_far FROM tel"))
def win_09(k: Lake) -> DataFrame:
    w = W.partitionBy("day").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    return k.tel.select("event_id", "day", F.sum("dv").over(w).cast("bigint").alias("loaded_so_far"))


@query("win_10_record_gap", tel_sql("g AS (SELECT event_id, timestamp, lag(timestamp) OVER (ORDER BY timestamp, event_id) AS prev FROM tel), x AS (SELECT event_id, prev AS from_ts, timestamp AS to_ts, date_diff('second', prev, timestamp) AS gap FROM g) SELECT * FROM x WHERE gap = (SELECT max(gap) FROM x)"))
def win_10(k: Lake) -> DataFrame:
    g = ordered_lag(k.tel, {"timestamp": "from_ts"}, ORDER).select("event_id", "from_ts", col("timestamp").alias("to_ts"), boundary_diff("second", "from_ts", "timestamp").alias("gap"))
    return g.join(F.broadcast(g.agg(F.max("gap").alias("gap"))), "gap").select("event_id", "from_ts", "to_ts", "gap")


@query("win_11_episodes", tel_sql("a AS (SELECT day FROM tel GROUP BY day HAVING sum(lps) > 12), b AS (SELECT day, CASE WHEN day - lag(day) OVER (ORDER BY day) <= 1 THEN 0 ELSE 1 END AS fresh FROM a), c AS (SELECT day, sum(fresh) OVER (ORDER BY day) AS e FROM b) SELECT min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM c GROUP BY e"))
def win_11(k: Lake) -> DataFrame:
    return islands(k.tel.groupBy("day").agg(F.sum("lps").alias("alarms")).where("alarms > 12")).select("first_day", "last_day", "days")


@query("win_12_running_sum_of_record", tel_sql("SELECT event_id, CAST(sum(lps) OVER (ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS alarms_so_far FROM tel"))
def win_12(k: Lake) -> DataFrame:
    return ordered_running_sum(k.tel, "lps", "n", ORDER).select("event_id", col("n").cast("bigint").alias("alarms_so_far"))


@query("win_13_gap_per_machine", tel_sql("SELECT event_id, date_diff('second', lag(timestamp) OVER (PARTITION BY user_id ORDER BY timestamp, event_id), timestamp) AS gap FROM tel"))
def win_13(k: Lake) -> DataFrame:
    return ordered_lag(k.tel, {"timestamp": "p"}, ORDER, keys=["user_id"]).select("event_id", boundary_diff("second", "p", "timestamp").alias("gap"))


# ---- sorts and top-k


@query("srt_01_order", tel_sql("SELECT day, count(*) AS n FROM tel GROUP BY day ORDER BY n DESC, day"))
def srt_01(k: Lake) -> DataFrame:
    return k.tel.groupBy("day").agg(F.count("*").alias("n")).orderBy(col("n").desc(), "day")


@query("srt_02_top_k", tel_sql("SELECT event_id, timestamp, pressure FROM tel WHERE lps = 1 ORDER BY pressure DESC, event_id LIMIT 10"))
def srt_02(k: Lake) -> DataFrame:
    return k.tel.where("lps = 1").orderBy(col("pressure").desc(), "event_id").limit(10).select("event_id", "timestamp", "pressure")


@query("srt_03_tie_check", "SELECT count(*) AS straddling FROM (SELECT o_orderdate FROM orders WHERE o_orderdate = (SELECT o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1 OFFSET 9))")
def srt_03(k: Lake) -> DataFrame:
    """How many rows share the sort key of row 10: over one, an order without a tie-break is not repeatable."""
    o = k.table("orders").select("o_orderdate", "o_orderkey")
    edge = o.orderBy(col("o_orderdate").desc(), "o_orderkey").limit(10).agg(F.min("o_orderdate").alias("edge"))
    return o.join(F.broadcast(edge), col("o_orderdate") == col("edge")).agg(F.count("*").alias("straddling"))


@query("srt_04_preview", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 5")
def srt_04(k: Lake) -> DataFrame:
    return k.table("events").orderBy("event_id").limit(5).select("event_id", "event_type")


@query("srt_05_days_in_top", tel_sql(f"{REP_DAYS_SQL}, top AS (SELECT day, {r('avg(dv)', 6)} AS duty FROM tel GROUP BY day ORDER BY duty DESC, day LIMIT 10) SELECT DISTINCT rd.day, rd.day IN (SELECT day FROM top) AS in_top FROM rd", rep=True))
def srt_05(k: Lake) -> DataFrame:
    top = agg_18(k).orderBy(col("duty").desc(), "day").limit(10).select("day", lit(True).alias("t"))
    return report_days(k).select("day").distinct().join(top, "day", "left").select("day", F.coalesce("t", lit(False)).alias("in_top"))


ORDERS_SQL = f"m AS (SELECT day, {r('avg(dv)', 6)} AS a, {r('max(pressure)')} AS b FROM tel GROUP BY day), n AS (SELECT day, row_number() OVER (ORDER BY a, day) AS ra, row_number() OVER (ORDER BY b, day) AS rb FROM m)"


@query("srt_06_same_order", tel_sql(f"{ORDERS_SQL} SELECT count(*) AS days, count(*) FILTER (WHERE ra <> rb) AS moved FROM n"))
def srt_06(k: Lake) -> DataFrame:
    m = k.tel.groupBy("day").agg(round_half(F.avg("dv"), 6).alias("a"), round_half(F.max("pressure"), 3).alias("b"))
    return same_order(m, "a", "b", "day").withColumnRenamed("rows", "days")


@query("srt_07_global_rank", tel_sql("SELECT event_id, row_number() OVER (ORDER BY pressure DESC, event_id) AS place FROM tel"))
def srt_07(k: Lake) -> DataFrame:
    """The place of every reading among all, by ranges of the order instead of one task."""
    return global_rank(k.tel.select("event_id", "pressure"), [(-col("pressure")), "event_id"], "place").select("event_id", "place")


# ---- set operations

ALARM_SQL = "alarm AS (SELECT day FROM tel GROUP BY day HAVING sum(lps) > 12)"


def alarm_days(k: Lake) -> DataFrame:
    return k.tel.groupBy("day").agg(F.sum("lps").alias("n")).where("n > 12").select("day")


@query("set_01_union_all", tel_sql("SELECT day, count(*) AS n FROM (SELECT * FROM tel UNION ALL SELECT * FROM tel) GROUP BY day"))
def set_01(k: Lake) -> DataFrame:
    return k.tel.unionByName(k.tel).groupBy("day").agg(F.count("*").alias("n"))


@query("set_02_difference", tel_sql(f"{ALARM_SQL}, {REP_DAYS_SQL} SELECT day FROM alarm EXCEPT SELECT day FROM rd", rep=True))
def set_02(k: Lake) -> DataFrame:
    return alarm_days(k).subtract(report_days(k).select("day"))


@query("set_03_intersection", tel_sql(f"{ALARM_SQL}, {REP_DAYS_SQL} SELECT day FROM alarm INTERSECT SELECT day FROM rd", rep=True))
def set_03(k: Lake) -> DataFrame:
    return alarm_days(k).intersect(report_days(k).select("day"))


@query("set_04_distinct", "SELECT DISTINCT l_shipdate, l_returnflag FROM lineitem")
def set_04(k: Lake) -> DataFrame:
    return k.table("lineitem").select("l_shipdate", "l_returnflag").distinct()


@query("set_05_union_of_days", tel_sql(f"{ALARM_SQL}, {REP_DAYS_SQL} SELECT day FROM alarm UNION SELECT day FROM rd", rep=True))
def set_05(k: Lake) -> DataFrame:
    return alarm_days(k).union(report_days(k).select("day")).distinct()


# ---- scalar functions


def _fn(name: str, sql: str, columns) -> None:
    """A query of expressions over the readings, by event_id; columns are made when it runs."""
    query(name, tel_sql(f"SELECT event_id, {sql} FROM tel"))(lambda k: k.tel.select("event_id", *[c.alias(n) for n, c in columns().items()]))


_fn("fn_01_cast_date", "CAST(timestamp AS DATE) AS d", lambda: dict(d=F.to_date("timestamp")))
_fn("fn_02_time_bucket", "time_bucket(INTERVAL 10 SECOND, timestamp) AS ten, time_bucket(INTERVAL 7 SECOND, timestamp) AS seven, time_bucket(INTERVAL 1 HOUR, timestamp) AS hour", lambda: dict(ten=bucket("timestamp", 10), seven=bucket("timestamp", 7, "2000-01-03 00:00:00"), hour=bucket("timestamp", 3600)))
_fn("fn_03_date_trunc", "date_trunc('hour', timestamp) AS h, CAST(date_trunc('month', timestamp) AS TIMESTAMP) AS m, CAST(date_trunc('week', timestamp) AS TIMESTAMP) AS w", lambda: dict(h=trunc_ts("hour", "timestamp"), m=trunc_ts("month", "timestamp"), w=trunc_ts("week", "timestamp")))
_fn("fn_04_date_diff", "date_diff('second', TIMESTAMP '2024-01-01 00:00:00.5', timestamp) AS s, date_diff('minute', TIMESTAMP '2024-01-01 00:00:59', timestamp) AS m, date_diff('hour', TIMESTAMP '2024-01-01 00:59:59', timestamp) AS h", lambda: dict(s=boundary_diff("second", lit("2024-01-01 00:00:00.5").cast("timestamp_ntz"), "timestamp"), m=boundary_diff("minute", lit("2024-01-01 00:00:59").cast("timestamp_ntz"), "timestamp"), h=boundary_diff("hour", lit("2024-01-01 00:59:59").cast("timestamp_ntz"), "timestamp")))
_fn("fn_06_strftime", "strftime(day, '%Y-%m') AS month, strftime(timestamp, '%H:%M') AS clock", lambda: dict(month=month_of("day"), clock=F.date_format("timestamp", "HH:mm")))
_fn("fn_07_parts", "hour(timestamp) AS h, minute(timestamp) AS m", lambda: dict(h=F.hour("timestamp").cast("bigint"), m=F.minute("timestamp").cast("bigint")))
_fn("fn_09_round", f"{r('pressure', 1)} AS one, {r('oil', 2)} AS two, {r('pressure', 0)} AS none", lambda: dict(one=round_half("pressure", 1), two=round_half("oil", 2), none=round_half("pressure", 0)))
_fn("fn_10_arithmetic", f"abs(pressure - 100) AS off, {r('oil * 3600.0::DOUBLE / 7', 6)} AS scaled, event_id % 7 AS rest, round(oil * 2, 0) / 2 AS half_step", lambda: dict(off=F.abs(col("pressure") - 100), scaled=round_half(col("oil") * lit(3600.0) / lit(7.0), 6), rest=col("event_id") % 7, half_step=F.round(col("oil") * 2, 0) / 2))
_fn("fn_11_case", "CASE WHEN pressure < 10 THEN 'low' WHEN pressure < 100 THEN 'middle' ELSE 'high' END AS band", lambda: dict(band=F.when(col("pressure") < 10, "low").when(col("pressure") < 100, "middle").otherwise("high")))
_fn("fn_12_coalesce", "coalesce(CASE WHEN dv = 1 THEN pressure END, -1.0::DOUBLE) AS x", lambda: dict(x=F.coalesce(F.when(col("dv") == 1, col("pressure")), lit(-1.0))))
_fn("fn_13_lower", "lower(upper(event_type)) AS kind", lambda: dict(kind=F.lower(F.upper("event_type"))))
_fn("fn_16_predicates", "lps = 1 AS alarm, user_id IS NOT NULL AS known", lambda: dict(alarm=col("lps") == 1, known=col("user_id").isNotNull()))
_fn("fn_17_casts", "CAST(event_id AS DOUBLE) AS as_double, CAST(event_id AS VARCHAR) AS as_text, CAST(dv AS BIGINT) AS as_long", lambda: dict(as_double=col("event_id").cast("double"), as_text=col("event_id").cast("string"), as_long=col("dv").cast("bigint")))
_fn("fn_18_negative_zero", "CASE WHEN round((dv - 1) * 0.0::DOUBLE, 2) = 0 THEN 0.0::DOUBLE ELSE round((dv - 1) * 0.0::DOUBLE, 2) END AS x", lambda: dict(x=round_half((col("dv") - 1) * lit(0.0), 2)))


@query("fn_05_parse_text_dates", tel_sql("SELECT nr, began, ended, date_diff('minute', began, ended) AS minutes, (SELECT count(*) FROM tel WHERE timestamp BETWEEN began AND ended) AS readings FROM rep", rep=True))
def fn_05(k: Lake) -> DataFrame:
    t = k.tel.select("day", "timestamp").join(F.broadcast(report_days(k)), "day").where(col("timestamp").between(col("began"), col("ended")))
    n = t.groupBy("nr", "began").agg(F.count("*").alias("n"))
    out = k.reports.join(n, ["nr", "began"], "left")
    return out.select("nr", "began", "ended", boundary_diff("minute", "began", "ended").alias("minutes"), F.coalesce("n", lit(0).cast("bigint")).alias("readings"))


@query("fn_08_series", tel_sql("b AS (SELECT min(day)::TIMESTAMP AS a, max(day)::TIMESTAMP AS z FROM tel) SELECT unnest(generate_series(a, z, INTERVAL 6 HOUR)) AS at FROM b"))
def fn_08(k: Lake) -> DataFrame:
    b = k.tel.agg(F.min("day").cast("timestamp_ntz").alias("a"), F.max("day").cast("timestamp_ntz").alias("z"))
    return b.select(F.explode(F.sequence("a", "z", F.expr("interval 6 hours"))).alias("at"))


#: Names of types: what SQL calls them, and what they are called here; a sum of decimals keeps one digit less.
TYPE_NAMES = {"TIMESTAMP": "timestamp_ntz", "DOUBLE": "double", "DECIMAL(3,1)": "decimal(2,1)", "BIGINT": "bigint", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean"}
_TYPE_SQL = "(VALUES " + ", ".join(str(x) for x in TYPE_NAMES.items()) + ") names(theirs, ours)"


@query("fn_14_typeof", tel_sql(f"t AS (SELECT DISTINCT unnest(['timestamp', 'dv', 'day', 'event_id', 'event_type', 'decimal_sum', 'double_sum']) AS what, unnest([typeof(timestamp), typeof(dv), typeof(day), typeof(event_id), typeof(event_type), typeof(0.1 + 0.2), typeof(0.1::DOUBLE + 0.2::DOUBLE)]) AS theirs FROM tel) SELECT what, ours AS type FROM t JOIN {_TYPE_SQL} USING (theirs)"))
def fn_14(k: Lake) -> DataFrame:
    """Type names differ between engines; the SQL looks them up."""
    of = {"timestamp": col("timestamp"), "dv": col("dv"), "day": col("day"), "event_id": col("event_id"), "event_type": col("event_type"), "decimal_sum": F.expr("0.1 + 0.2"), "double_sum": lit(0.1) + lit(0.2)}
    told = F.array(*[F.struct(lit(n).alias("what"), F.typeof(c).alias("type")) for n, c in of.items()])
    return k.tel.select(F.inline(told)).distinct()


FN_15_KINDS = {"event_id": "plain", "event_type": "plain", "timestamp": "time", "day": "date", "pressure": "number", "dv": "number"}


@query("fn_15_row_hash", tel_sql(f"SELECT event_id, {hash_sql(FN_15_KINDS)} AS row_hash FROM tel"))
def fn_15(k: Lake) -> DataFrame:
    """A hash of each row by the text of its values, the same in any engine."""
    return k.tel.select("event_id", row_hash(k.tel, list(FN_15_KINDS)).alias("row_hash"))


@query("fn_19_column_list", "SELECT column_name, (SELECT count(*) FROM events) AS rows FROM (DESCRIBE SELECT * FROM events)")
def fn_19(k: Lake) -> DataFrame:
    t = k.table("events")
    return k.spark.createDataFrame([(c,) for c, _ in t.dtypes], "column_name string").crossJoin(t.agg(F.count("*").alias("rows")))


@query("fn_20_epoch", tel_sql("SELECT event_id, CAST(floor(epoch(timestamp)) AS BIGINT) AS s FROM tel"))
def fn_20(k: Lake) -> DataFrame:
    return k.tel.select("event_id", epoch_seconds("timestamp").alias("s"))
