"""Operators against hand-computed answers: the edge cases the SQL comparison does not reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from telemill.functions import on_days
from telemill.operators import contracts as dq
from telemill.operators import grading, plant, profile, reconcile, residual, windows
from telemill.operators.resample import conservation, resample
from telemill.sources import ingest, scans, scratch, sinks

T = dt.datetime
D = dt.date


@pytest.fixture
def raw(spark):
    """Two readings in one slot, a hole, a contradiction; the first reading is off the slot's edge."""
    rows = [(T(2024, 1, 1, 23, 50, 3), 1.0, 1.0, 0.0), (T(2024, 1, 1, 23, 50, 9), 2.0, 0.0, 1.0), (T(2024, 1, 1, 23, 50, 31), 4.0, 1.0, 1.0), (T(2024, 1, 2, 0, 0, 0), 5.0, 0.0, 1.0)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, x double, dv double, comp double")


def test_resample_keeps_everything(raw):
    grid = resample(raw, "ts", 10, ["x"], ["dv"], F.col("dv") == F.col("comp"))
    rows = grid.orderBy("ts").collect()
    assert len(rows) == 61 and rows[0].ts == T(2024, 1, 1, 23, 50) and rows[-1].ts == T(2024, 1, 2)
    assert (rows[0].readings, rows[0].x, rows[0].dv, rows[0].doubtful) == (2, 1.5, 1.0, False)
    assert rows[1].readings == 0 and not rows[1].measured and rows[1].x is None and rows[1].dv is None
    assert rows[3].doubtful and rows[3].day == D(2024, 1, 1) and rows[-1].day == D(2024, 1, 2)
    told = conservation(grid, raw, "ts", 10).first()
    assert told.conserved and told.kept == 4 and told.slots == told.expected == 61


def test_resample_by_key(spark, raw):
    both = raw.withColumn("m", F.lit("a")).union(raw.where("x > 1").withColumn("m", F.lit("b")))
    n = {r.m: r["count"] for r in resample(both, "ts", 10, ["x"], keys=["m"]).groupBy("m").count().collect()}
    assert n == {"a": 61, "b": 61}


def test_daily_profile(spark):
    days = spark.createDataFrame([(D(2024, 1, 1),)] * 10 + [(D(2024, 1, 2),)] * 1, "day date")
    got = {r.day.day: (r.readings, r.complete, r.brimming, r.nearly_empty) for r in profile.completeness(days, 11).collect()}
    assert got == {1: (10, True, False, False), 2: (1, False, False, True)}


def test_sampling_mode_prefers_the_shorter_gap(spark):
    rows = [(i, T(2024, 1, 1) + dt.timedelta(seconds=s)) for i, s in enumerate((0, 10, 20, 25, 30))]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz").withColumn("day", F.to_date("ts"))
    got = profile.sampling(df, ["ts", "id"]).first()
    assert (got.period, got.irregular, got.gaps) == (5, 2, 4)


def test_balance_by_hand(spark):
    segs = spark.createDataFrame([(1.0, 10.0, 5.0), (0.0, 20.0, -4.0)], "state double, counted_minutes double, change double")
    b = plant.balance(segs).first()
    assert (b.gained, b.lost, b.fill_rate, b.drain_rate, b.duty, b.imbalance) == (5.0, 4.0, 0.5, 0.2, 0.333333, 0.2)


def test_predictions_and_searches(spark):
    p = plant.predictions(spark.createDataFrame([(8.0, 10.0, 1.0, 0.1)], "start double, stop double, fill double, consumption double")).first()
    assert (p.band, p.delivery, p.duty, p.cycle_minutes) == (2.0, 1.1, 0.090909, 22.0)
    best = plant.grid_search(spark, (5, 0.8, 0.1), (5, 0.05, 0.025), 2.0, p.duty, 60 / 22.0).first()
    assert (best.fill, best.consumption) == (1.0, 0.1) and best.ties >= 1
    leak = plant.leak_sweep(spark, 4, 0.5, 1.25, 0.05).orderBy("leak").collect()
    assert [r.residual for r in leak] == [0.0, 0.5, 1.0, 1.2]


def test_unknown_hours_are_not_zero(spark):
    rows = [(T(2024, 1, 1, 0, m), 1.0) for m in range(8)] + [(T(2024, 1, 1, 1, 0), 1.0)]
    h = residual.hourly_residual(spark.createDataFrame(rows, "timestamp timestamp_ntz, dv double"), "dv", 1.25, 0.05, 8).collect()
    assert [(r.hour.hour, r.residual) for r in h] == [(0, 1.2)]


def test_peak_hour_is_the_earliest_tie(spark):
    h = spark.createDataFrame([(T(2024, 1, 1, k), D(2024, 1, 1), v) for k, v in ((3, 0.5), (5, 0.9), (7, 0.9))], "hour timestamp_ntz, day date, residual double")
    got = residual.daily_peaks(h).first()
    assert got.peak == 0.9 and got.peak_hour == T(2024, 1, 1, 5)


def test_carry_free_sums_stay_whole(spark):
    curve = spark.createDataFrame([(D(2024, 1, 1), i, 1) for i in range(10)], "day date, slot long, loaded long")
    got = residual.carry_free(curve, "loaded", 0.3).orderBy("slot").collect()
    assert sum(r.whole for r in got) == 3 and {r.whole for r in got} == {0, 1}


def test_record_gaps(spark):
    curve = spark.createDataFrame([(D(2024, 1, 1), i, int(i in (2, 3, 6))) for i in range(8)], "day date, slot long, recorded long")
    assert sorted((r.from_slot, r.to_slot) for r in residual.record_gaps(curve).collect()) == [(0, 2), (4, 6), (7, 8)]


@pytest.fixture
def reports(spark):
    return spark.createDataFrame([("#1", T(2024, 1, 5), T(2024, 1, 6, 4)), ("#1", T(2024, 1, 9), T(2024, 1, 9, 2))], "nr string, began timestamp_ntz, ended timestamp_ntz")


def test_grading_by_hand(spark, reports):
    days = spark.createDataFrame([(D(2024, 1, d), p) for d, p in ((1, 0.1), (3, 0.9), (4, 0.9), (5, 0.9), (7, 0.8), (9, 0.2))], "day date, peak double")
    thr = spark.createDataFrame([(0.5,), (0.1,)], "threshold double")
    got = {r.threshold: r for r in grading.sweep(days, reports, thr).collect()}
    assert (got[0.5].alarm_days, got[0.5].detected, got[0.5].false_days) == (4, 1, 3)
    assert (got[0.1].detected, got[0.1].false_days) == (2, 3)
    assert grading.highest_full_threshold(grading.sweep(days, reports, thr), 2).first().threshold == 0.1
    lead = {r.began.day: (r.lead_days, r.episode_days) for r in grading.lead_times(days.where("peak > 0.5").select("day"), reports).collect()}
    assert lead == {5: (2, 3), 9: (None, None)}
    kinds = {r.day.day: r["class"] for r in grading.classify_days(days.union(spark.createDataFrame([(D(2024, 1, 10), None)], "day date, peak double")), reports, 0.5, 0.15).collect()}
    assert kinds == {1: "normal", 3: "false", 4: "false", 5: "hit", 7: "false", 9: "missed", 10: "not judged"}


def test_contract_that_cannot_run_is_broken(spark):
    df = spark.createDataFrame([(1, 2.0)], "k int, oil double")
    promises = [("oil", dq.not_null("oil")), ("unique", dq.unique("k")), ("columns", dq.has_columns(["k", "oil"]))]
    assert [r.broken for r in dq.check(df, promises).collect()] == [False, False, False]
    got = {r.promise: (r.offenders, r.broken) for r in dq.check(df.withColumnRenamed("oil", "x"), promises).collect()}
    assert got == {"oil": (None, True), "unique": (0, False), "columns": (1, True)}


def test_impossible_rows_are_caught_by_their_rule(spark):
    rows = [(1, 5.0, 0.0), (2, -1.0, 0.0), (3, 30.0, 1.0), (4, 5.0, 7.0), (None, 5.0, 0.0), (6, None, 0.0)]
    df = spark.createDataFrame(rows, "k int, hours double, flag double")
    rules = {"key": F.col("k").isNotNull(), "hours": F.col("hours").between(0, 24), "flag": F.col("flag").isin(0.0, 1.0), "known": F.col("hours").isNotNull()}
    good, bad = dq.split(df, rules)
    assert [r.k for r in good.collect()] == [1]
    assert {r.k: r.broken for r in bad.collect()} == {2: ["hours"], 3: ["hours"], 4: ["flag"], None: ["key"], 6: ["known"]}
    assert dq.key_violations(df.union(df.where("k = 1")), ["k"]).count() == 3
    assert dq.orphans(df, df.where("k > 1"), "k").count() == 1


def test_fingerprint_ignores_order_not_content(spark):
    a = spark.range(100).select("id", (F.col("id") * 2).alias("x"))
    f = lambda d: reconcile.fingerprint(d).first()
    assert f(a) == f(a.orderBy(F.col("id").desc()).repartition(7)) and f(a) != f(a.where("id > 0")) and f(a.where("id < 0")).hash_sum == 0
    told = reconcile.same_rows(a, a.union(a.where("id = 1"))).first()
    assert (told.only_left, told.only_right) == (0, 1)


def test_csv_with_a_blank_header(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(",timestamp," + ",".join(scans.ANALOGUE + scans.DIGITAL) + "\n7,2020-02-01 00:00:10," + ",".join(["1.5"] * 7 + ["1.0"] * 8) + "\n")
    row = scans.scan_csv(spark, str(path)).first()
    assert row.source_index == 7 and row.timestamp == T(2020, 2, 1, 0, 0, 10) and row.day == D(2020, 2, 1) and row.LPS == 1.0


def test_weather_and_reports(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"hourly": {"time": ["2020-02-01T00:00", "2020-02-01T01:00"], "temperature_2m": [9.4, 9.1],\n "relative_humidity_2m": [70, 71], "precipitation": [0.0, 0.2]}}')
    rows = scans.scan_hourly_json(spark, str(tmp_path / "w.json")).collect()
    assert [(r.hour.hour, str(r.temperature), r.rain) for r in rows] == [(0, "9.4", 0.0), (1, "9.1", 0.2)]
    (tmp_path / "r.csv").write_text("nr,start_time,end_time,failure,severity,report\n#1,4/18/2020 0:00,4/18/2020 23:59,Air leak,High,\n")
    assert scans.scan_reports(spark, str(tmp_path / "r.csv")).first().ended == T(2020, 4, 18, 23, 59)


def test_versions(spark, tmp_path):
    root = str(tmp_path / "v")
    assert sinks.versions(spark, root) is None
    assert [sinks.write_version(spark.range(n), root) for n in (3, 5)] == [0, 1]
    assert sinks.read_version(spark, root).count() == 5 and sinks.read_version(spark, root, 0).count() == 3
    with pytest.raises(ValueError):
        sinks.read_version(spark, root, 9)


def test_guarded_append_once(spark, tmp_path):
    source, target, manifest = (str(tmp_path / n) for n in "stm")
    spark.range(10).write.csv(source)
    read = lambda paths: spark.read.csv(paths, schema="id long")
    assert ingest.guarded_append(spark, source, target, manifest, read) > 0
    assert ingest.guarded_append(spark, source, target, manifest, read) == 0
    spark.range(10, 12).coalesce(1).write.mode("append").csv(source)
    assert ingest.guarded_append(spark, source, target, manifest, read) == 1
    assert spark.read.parquet(target).count() == 12


def test_backfill_leaves_other_days(spark, tmp_path):
    days = spark.range(4).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), "id")
    path = str(tmp_path / "days")
    assert ingest.replace(days, path) == ingest.replace(days, path) == 4
    ingest.backfill(days.withColumn("id", F.col("id") + 100), path, "2024-01-02", "2024-01-02")
    assert {r.day.day: r.id for r in spark.read.parquet(path).collect()} == {1: 0, 2: 101, 3: 2, 4: 3}


def test_day_filter_prunes_partitions(spark, tmp_path):
    days = spark.range(4).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), "id")
    sinks.write_days(days, str(tmp_path / "p"))
    plan = scans.scan_days(spark, str(tmp_path / "p"), ("2024-01-02", "2024-01-03"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_two_machines_do_not_mix(spark, reports):
    """Segments, steps, curves and sweeps of one machine are what they are without the other."""
    rows = [(m, T(2024, 1, 1 + k // 40, k % 24, k % 60), D(2024, 1, 1 + k // 40), k, float((k // (3 + m)) % 2), float(k * k % 17)) for m in (0, 1) for k in range(120)]
    df = spark.createDataFrame(rows, "machine long, timestamp timestamp_ntz, day date, event_id long, dv double, pressure double")
    order = ["timestamp", "event_id"]
    plain = lambda d: sorted(tuple(r) for r in d.drop("machine").collect())
    for fn in (
        lambda d, keys: plant.thresholds(d, "dv", "pressure", order, keys=keys), lambda d, keys: plant.ramp(d, "dv", "pressure", order, keys=keys),
        lambda d, keys: plant.slopes(d, "dv", "pressure", order, keys=keys), lambda d, keys: plant.balance(plant.clean_segments(d, "dv", "pressure", 10**6, order, 1.0, keys), keys),
        lambda d, keys: residual.record_gaps(residual.minute_curve(d, "dv", 15, keys=keys), keys), lambda d, keys: profile.sampling(d, order, keys=keys),
    ):
        both = fn(df, ["machine"])
        for m in (0, 1):
            assert plain(both.where(F.col("machine") == m)) == plain(fn(df.where(F.col("machine") == m), None))
    days = spark.createDataFrame([(m, D(2024, 1, d), p + m / 10) for m in (0, 1) for d, p in ((3, 0.9), (4, 0.9), (5, 0.45), (9, 0.2))], "machine long, day date, peak double")
    thr = spark.createDataFrame([(0.5,)], "threshold double")
    got = {r.machine: (r.alarm_days, r.detected, r.false_days) for r in grading.sweep(days, reports.withColumn("machine", F.lit(1).cast("long")), thr, keys=["machine"]).collect()}
    assert got == {0: (2, 0, 2), 1: (3, 1, 2)}


def test_sweep_with_an_extra_event(spark, reports):
    days = spark.createDataFrame([(D(2024, 1, d), 0.9) for d in (1, 3, 5)], "day date, peak double")
    extra = spark.createDataFrame([("#9", T(2024, 1, 3), T(2024, 1, 5, 4))], "nr string, began timestamp_ntz, ended timestamp_ntz")
    r = grading.sweep(days, reports, spark.createDataFrame([(0.5,)], "threshold double"), extra=extra).first()
    assert (r.detected, r.false_days, r.detected_with, r.false_days_with) == (1, 2, 2, 1)


def test_steps_cross_chunks(spark):
    """A state that never changes is numbered through, day by day."""
    rows = [(T(2024, 1, 1 + k // 3, k % 3), D(2024, 1, 1 + k // 3), k, 1.0, float(k)) for k in range(10)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, day date, event_id long, dv double, x double")
    got = windows.segment_steps(windows.segment_rows(df, "dv", ["timestamp", "event_id"]), {"x": "before"}, ["timestamp", "event_id"]).orderBy("timestamp").collect()
    assert [r.step for r in got] == list(range(1, 11)) and [r.before for r in got] == [None, *map(float, range(9))]


def test_grid_search_tells_edges(spark):
    got = {r.judged_by: r for r in plant.grid_search(spark, (5, 1.0, 0.1), (5, 0.1, 0.1), 2.0, 0.2, 99.0).collect()}
    assert got["duty"].error == 0 and not got["duty"].on_edge and got["starts"].on_edge and set(got) == {"duty", "starts", "both"}


def test_time_range_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).select(F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz").alias("timestamp")).write.parquet(path)
    df = on_days(spark.read.parquet(path).withColumn("day", F.to_date("timestamp")), "1970-01-02", "1970-01-03")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 2 and "GreaterThanOrEqual(timestamp" in plan and "LessThan(timestamp" in plan


def test_scratch_needs_a_shared_folder(monkeypatch):
    import types

    other = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None), sparkContext=types.SimpleNamespace(master="yarn", applicationId="a"))
    with pytest.raises(ValueError):
        scratch.shared_folder(other)
    other.sparkContext.master = "local[2]"
    assert scratch.shared_folder(other)
