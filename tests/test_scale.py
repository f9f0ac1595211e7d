"""Operators that hold no group, series or file in one task, against plain computations on small and odd inputs."""

import hashlib
import random
from collections import Counter
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from telemill.functions import canonical, frame_median
from telemill.operators import grading, intervals, quantiles, ranks, reconcile
from telemill.sources import ingest, sinks
from telemill.sources.scratch import scratch

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def single_tasks(df):
    return df._jdf.queryExecution().executedPlan().toString().count("SinglePartition")


# ---- quantiles


def test_quantiles_of_a_million_values(spark, monkeypatch):
    """A million distinct values in one group: no step holds more of them than a bracket."""
    held = {}
    save = quantiles._saved

    def counting(df, name):
        out = save(df, name)
        held[name] = max(held.get(name, 0), out.count())
        return out

    monkeypatch.setattr(quantiles, "_saved", counting)
    df = spark.range(1_000_000, numPartitions=8).select((F.pmod(F.col("id") * 7919, F.lit(1_000_003)) / 7.0 - 1000).alias("x"))
    want = np.quantile((np.arange(1_000_000, dtype=np.int64) * 7919 % 1_000_003) / 7.0 - 1000, [0.5, 0.95, 0.999])
    shares = {"a": 0.5, "b": 0.95, "c": 0.999}
    got = quantiles.quantiles(df, {n: (F.col("x"), p) for n, p in shares.items()}, [F.count("*").alias("n")], limit=5000).first()
    assert got.n == 1_000_000 and np.allclose([got.a, got.b, got.c], want, rtol=1e-12)
    assert held["inside"] < 5000
    rough = quantiles.quantiles(df, {n: (F.col("x"), p) for n, p in shares.items()}, limit=2000, accuracy=50).first()  # brackets of 80,000 are cut
    assert np.allclose([rough.a, rough.b, rough.c], want, rtol=1e-12) and "cells" in held


@pytest.mark.parametrize("limit, accuracy", [(1 << 20, 10_000), (7, 20), (1, 3), (3, 1)])
def test_quantiles_of_odd_groups(spark, limit, accuracy):
    rng = random.Random(4)
    rows = [(g, k, float(v)) for g, values in {
        "one": [5], "two": [1, 2], "ties": [3] * 40 + [4], "many": [rng.gauss(0, 9) for _ in range(200)], "steps": [rng.randrange(4) for _ in range(99)], "far": [-1e300, 1e300, 0, 1, float("inf")],
    }.items() for k in (1, None) for v in values]
    rows += [("none", 1, None), ("one", 1, None), ("two", None, float("nan"))]
    df = spark.createDataFrame(rows, "g string, k int, x double").repartition(5)
    shares = {"low": 0.0, "p10": 0.1, "mid": 0.5, "p99": 0.99, "high": 1.0}
    got = {(r.g, r.k): r for r in quantiles.quantiles(df, {n: (F.col("x"), p) for n, p in shares.items()}, [F.count("*").alias("n")], ["g", "k"], limit, accuracy).collect()}
    assert len(got) == 13
    for (g, k), r in got.items():
        values = [x for a, b, x in rows if (a, b) == (g, k) and x is not None and x == x]
        for name, p in shares.items():
            if not values:
                assert r[name] is None
            elif g == "far" and name in ("p99", "high"):
                assert r[name] == float("inf")
            else:
                assert np.isclose(r[name], np.quantile(values, p), rtol=1e-12)
    none = quantiles.quantiles(df.limit(0), {"mid": (F.col("x"), 0.5)}, limit=limit)
    assert none.first().mid is None


# ---- ranks and frames


def test_global_rank(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(5)) for k in range(500)]
    df = spark.createDataFrame(rows, "id int, x int").repartition(6)
    out = ranks.global_rank(df, ["x", "id"], "place", parts=7)
    assert {r.id: r.place for r in out.collect()} == {k: n for n, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1)}
    assert "Window" in out._jdf.queryExecution().executedPlan().toString() and out.columns == ["id", "x", "place"]
    told = ranks.same_order(df.withColumn("y", F.col("x") * 2), "x", "y", "id").first()
    assert (told["rows"], told.moved) == (500, 0)
    assert ranks.global_rank(df.limit(0), ["id"]).count() == 0


@pytest.mark.parametrize("length", [0, 1, 13, 14, 15, 60])
def test_trailing_frames_of_any_length(spark, length):
    """Series shorter than, as long as and longer than the frame, with days missing, of several machines."""
    rng = random.Random(length)
    rows = []
    for machine in (1, 2, None):
        day = date(1969, 12, 1)
        for _ in range(length + (machine or 0)):
            day += timedelta(days=rng.choice([1, 1, 1, 2, 50]))
            rows.append((machine, day, float(rng.randrange(100))))
    df = spark.createDataFrame(rows, "machine int, day date, peak double")
    whole = df.where("machine = 2")
    for frame, keys, input_ in ((14, ["machine"], df), (3, ["machine"], df), (14, None, whole)):
        got = {(r.machine, r.day): (r.mid, r.n) for r in ranks.trailing(input_, "day", frame, {"mid": frame_median("peak"), "n": F.count("peak")}, keys, block_rows=8, block_days=30).collect()}
        for machine in {r[0] for r in rows} if keys else {2}:
            own = sorted(r for r in rows if r[0] == machine)
            for i, (_, day, _) in enumerate(own):
                before = [x for *_, x in own[max(0, i - frame) : i]]
                assert got.pop((machine, day)) == (pd.Series(before).median() if before else None, len(before))
        assert not got


# ---- sweeps


@pytest.mark.parametrize("keys", [[], ["machine"]])
def test_sweep_of_many_thresholds(spark, keys):
    rng = random.Random(8)
    day = lambda k: date(2024, 1, 1) + timedelta(days=k)
    machines = (1, 2) if keys else (1,)
    scores = [(m, day(k), rng.choice([None, round(rng.random(), 3), 0.5])) for m in machines for k in range(40)]
    reports = [(m, f"#{n}", datetime(2024, 1, 1 + 5 * n, 7), datetime(2024, 1, 2 + 6 * n, 3)) for m in machines for n in range(4)]
    extra = [(m, "#x", datetime(2024, 1, 20, 7), datetime(2024, 1, 21, 3)) for m in machines] + [reports[0]]
    frame = lambda rows: spark.createDataFrame(rows, "machine int, nr string, began timestamp_ntz, ended timestamp_ntz")
    levels = [k / 700 for k in range(700)] + [0.5, 0.5, 2.0]
    thresholds = spark.createDataFrame([(x,) for x in levels], "threshold double")
    out = grading.sweep(spark.createDataFrame(scores, "machine int, day date, peak double"), frame(reports), thresholds, keys=keys, extra=frame(extra))
    got = {(r.machine if keys else 1, r.threshold): r for r in out.collect()}
    assert len(got) == len(machines) * len(set(levels))
    cover = lambda rows, m: {(nr, began): {day(k) for k in range(60) if began.date() <= day(k) <= ended.date()} for mm, nr, began, ended in rows if mm == m}
    for (m, level), r in got.items():
        alarm = {d for mm, d, s in scores if mm == m and s is not None and s > level}
        own, both = cover(reports, m), cover(reports + extra, m)
        wrong = lambda events: len(alarm - set().union(*events.values()))
        found = lambda events: sum(bool(days & alarm) for days in events.values())
        assert (r.alarm_days, r.detected, r.false_days, r.detected_with, r.false_days_with) == (len(alarm), found(own), wrong(own), found(both), wrong(both))
        assert r.false_per_month == round(wrong(own) / 2, 3)
    assert grading.sweep(spark.createDataFrame([], "machine int, day date, peak double"), frame(reports), thresholds, keys=keys).count() == 0


# ---- intervals


@pytest.mark.parametrize("seconds", [1, 7, 3600, 86400])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_intervals_by_dyadic_cover(spark, seconds, how):
    rng = random.Random(seconds)
    at = lambda: datetime(1970, 1, 1) + timedelta(seconds=rng.randrange(-10**6, 10**7), microseconds=rng.choice([0, 1, 999_999]))
    points = [(k, k % 3, at()) for k in range(300)] + [(900, None, at()), (901, 1, None)]
    spans = [(f"s{k}", k % 2, a, a + timedelta(seconds=rng.choice([-5, 0, 1, 59, 3600, 10**5, 10**7]))) for k in range(40) for a in [at()]]
    spans += [("all", 1, datetime(1900, 1, 1), datetime(2100, 1, 1)), ("none", 0, None, datetime(2100, 1, 1)), (points[0][0], 0, points[0][2], points[0][2])]
    p = spark.createDataFrame(points, "id int, g int, t timestamp_ntz")
    s = spark.createDataFrame([(str(n), g, a, b) for n, g, a, b in spans], "name string, g int, began timestamp_ntz, ended timestamp_ntz")
    hit = lambda t, a, b: t is not None and a is not None and a <= t <= b
    for keys in (None, ["g"]):
        out = intervals.interval_join(p, s if keys else s.drop("g"), "t", "began", "ended", seconds, keys, how)
        want = Counter((i, str(n)) for i, g, t in points for n, h, a, b in spans if hit(t, a, b) and (not keys or g == h))
        if how == "left":
            want += Counter((i, None) for i, *_ in points if not any(x == i for x, _ in want))
        assert Counter((r.id, r.name) for r in out.collect()) == want
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_points_are_never_broadcast(spark, tmp_path, monkeypatch):
    """Points in a small file beside intervals whose size the planner does not know: only what was counted is broadcast."""
    path = str(tmp_path / "points")
    spark.range(20_000).select("id", F.timestamp_seconds(F.col("id") * 7).cast("timestamp_ntz").alias("t")).write.parquet(path)
    points, text = spark.read.parquet(path), [("long", "1960-01-01 00:00:00", "2030-01-01 00:00:00"), ("short", "1970-01-01 00:00:10", "1970-01-01 00:02:00")]
    s = spark.createDataFrame(text, "name string, a string, b string").select("name", F.col("a").cast("timestamp_ntz").alias("began"), F.col("b").cast("timestamp_ntz").alias("ended"))
    for seconds, most, sides in ((1, 100_000, 1), (86400, 100_000, 2), (86400, 3, 0)):
        monkeypatch.setattr(intervals, "MAX_BROADCAST", most, raising=False)
        out = intervals.interval_join(points, s, "t", "began", "ended", seconds)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BuildLeft") == 0 and plan.count("BroadcastExchange") == plan.count("BuildRight") == sides
        assert Counter(r.name for r in out.collect()) == {"long": 20_000, "short": 16}


def test_cover_is_small_and_disjoint(spark):
    rows = [(a, a + n) for a in range(-9, 9) for n in range(-1, 20)] + [(-(10**9), 10**9)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = intervals.cover(df, F.col("a"), F.col("b")).collect()
    held = {}
    for r in got:
        held.setdefault((r.a, r.b), []).append((r["_block"] << r["_level"], (r["_block"] + 1) << r["_level"]))
    for (a, b), blocks in held.items():
        blocks.sort()
        assert blocks[0][0] == a and blocks[-1][1] == b + 1 and all(x[1] == y[0] for x, y in zip(blocks, blocks[1:], strict=False))
    assert len(held) == sum(a <= b for a, b in rows) and len(held[-(10**9), 10**9]) <= 60


# ---- ingest


def test_append_survives_a_crash_before_its_commit(spark, tmp_path, monkeypatch):
    source, target, manifest = (str(tmp_path / n) for n in "stm")
    spark.range(10).repartition(2).write.csv(source)
    read = lambda paths: spark.read.csv(paths, schema="id long")
    commit = ingest._commit

    def crash(*_):
        raise RuntimeError("the driver is gone")

    monkeypatch.setattr(ingest, "_commit", crash)
    with pytest.raises(RuntimeError):
        ingest.guarded_append(spark, source, target, manifest, read)
    with pytest.raises(ValueError):
        ingest.read_committed(spark, target, manifest)
    monkeypatch.setattr(ingest, "_commit", commit)
    files = ingest.guarded_append(spark, source, target, manifest, read, files_per_commit=1)
    assert files == 2 and sorted(r.id for r in ingest.read_committed(spark, target, manifest).collect()) == list(range(10))
    assert spark.read.parquet(target).count() > 10  # the crash left rows, which nothing reads
    assert ingest.sweep_uncommitted(spark, target, manifest) == 1 and spark.read.parquet(target).count() == 10
    # the second commit of a run fails: the first stays, the rest comes with the next run
    spark.range(20, 24).repartition(2).write.mode("append").csv(source)
    calls = []
    monkeypatch.setattr(ingest, "_commit", lambda *a: crash() if calls else (calls.append(1), commit(*a)))
    with pytest.raises(RuntimeError):
        ingest.guarded_append(spark, source, target, manifest, read, files_per_commit=1)
    monkeypatch.setattr(ingest, "_commit", commit)
    assert ingest.guarded_append(spark, source, target, manifest, read) == 1
    assert sorted(r.id for r in ingest.read_committed(spark, target, manifest).collect()) == [*range(10), *range(20, 24)]


def test_equal_new_files_are_appended_once_and_all_noted(spark, tmp_path):
    source, target, manifest = (str(tmp_path / n) for n in "stm")
    (tmp_path / "s").mkdir()
    for name in ("b.csv", "a.csv"):
        (tmp_path / "s" / name).write_text("1\n2\n")
    read = lambda paths: spark.read.csv(paths, schema="id long")
    assert ingest.guarded_append(spark, source, target, manifest, read) == 1
    noted = {r.path.rsplit("/", 1)[1]: r.appended for r in ingest.committed(spark, manifest).collect()}
    assert noted == {"a.csv": True, "b.csv": False} and ingest.read_committed(spark, target, manifest).count() == 2


def test_block_hashes_of_any_bytes(spark, tmp_path):
    rng = random.Random(1)
    files = {"a": bytes(rng.randrange(256) for _ in range(5000)), "b": b"\n" * 700, "c": b"x" * 900, "d": b"line\n" * 400 + b"tail", "e": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)

    def want(data, size):
        blocks, at = {}, 0
        lines = data.split(b"\n")
        if lines[-1] == b"":
            lines.pop()
        for line in lines:
            blocks.setdefault(at // size, []).append((at, line))
            at += len(line) + 1
        return {b: (x[0][0], min(x[-1][0] + len(x[-1][1]) + 1, len(data)), hashlib.sha256(b"\n".join(line for _, line in x)).hexdigest()) for b, x in blocks.items()}

    before = None
    for split in ("128m", "300"):  # the reader's ranges don't show
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            got = ingest.block_hashes(spark, str(tmp_path), 256)
            rows = {(r.path.rsplit("/", 1)[1], r.block): (r.from_byte, r.to_byte, r.sha256) for r in got.collect()}
            trees = {r.path.rsplit("/", 1)[1]: r.sha256 for r in ingest.tree_hashes(got).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert rows == {(name, b): x for name, data in files.items() for b, x in want(data, 256).items()}
        assert before is None or before == trees
        before = trees
    kept = scratch(spark, "before")
    ingest.block_hashes(spark, str(tmp_path), 256).write.parquet(kept)
    changed = bytearray(files["d"])
    changed[1111] ^= 1
    (tmp_path / "d").write_bytes(bytes(changed))
    off = ingest.changed_blocks(spark.read.parquet(kept), ingest.block_hashes(spark, str(tmp_path), 256)).collect()
    assert [(r.path.rsplit("/", 1)[1], r.block) for r in off] == [("d", 1111 // 256)] and off[0].from_byte <= 1111 < off[0].to_byte


# ---- differences


def test_differing_rows_as_exceptall(spark):
    rng = random.Random(3)
    value = lambda: rng.choice([None, 0.0, -0.0, 1.5, float("nan")])
    rows = [(rng.choice([None, *range(60)]), value(), rng.choice([None, "a", "b"])) for _ in range(600)]
    other = [r for r in rows if rng.random() > 0.03] + rows[:5] + [(None, None, "a"), ("7" and 7, None, None)]
    a, b = (spark.createDataFrame(x, "k int, x double, s string").repartition(3) for x in (rows, other))
    for keys in (None, ["k"]):
        got = reconcile.differing_rows(a, b, keys, buckets=16)
        for side, want in (("only_left", a.exceptAll(b)), ("only_right", b.exceptAll(a))):
            more = got.where(f"{side} > 0").select(F.explode(F.array_repeat(F.struct("k", "x", "s"), F.col(side).cast("int"))).alias("r")).select("r.*")
            assert more.exceptAll(want).count() == 0 and want.exceptAll(more).count() == 0
    assert reconcile.differing_rows(a, a.orderBy("x")).count() == 0
    left, right = reconcile.suspects(a, a.withColumn("x", F.when(F.col("k") == 7, 9.0).otherwise(F.col("x"))), ["k"], buckets=64)
    assert {r.k for r in left.collect()} == {7} and {r.k for r in right.collect()} == {7}  # all others are left where they are


def test_version_diff_with_few_changes(spark):
    old = spark.range(50).select("id", (F.col("id") * 2).alias("v"))
    new = old.withColumn("v", F.when(F.col("id") == 9, 100).when(F.col("id") == 30, 59).otherwise(F.col("v"))).where("id <> 4")
    told = lambda k: [(r.id, r.change) for r in reconcile.version_diff(old, new, "id", "v", k).collect()]
    assert told(2) == [(9, 82), (30, -1)] and told(4) == [(9, 82), (30, -1), (0, 0), (1, 0)]


# ---- sinks


def test_a_day_of_a_third_of_all_rows(spark):
    day = F.when(F.col("id") % 3 == 0, F.lit("2024-01-05")).otherwise(F.concat(F.lit("2024-02-"), F.lpad((F.col("id") % 20 + 1).cast("string"), 2, "0"))).cast("date")
    df = spark.range(30_000, numPartitions=4).select("id", day.alias("day"), (F.col("id") * 1.5).alias("x"))
    cuts = []
    for parts in (4, 9):
        path = scratch(spark, "days")
        plan = sinks.write_days_sized(df.repartition(parts), path, ["id"], 500, order=["id"])
        held = spark.read.parquet(path).withColumn("file", F.input_file_name())
        files = [(r.day, r.n, r.h) for r in held.groupBy("day", "file").agg(F.count("*").alias("n"), F.sum("id").alias("h")).collect()]
        assert all(250 <= n <= 1000 for _, n, _ in files)
        assert Counter(d for d, *_ in files) == {r.day: r.files for r in plan.collect()} and Counter(d for d, *_ in files)[date(2024, 1, 5)] == 20
        cuts.append(sorted(files))
    assert cuts[0] == cuts[1]  # the same rows give the same files in any run
    sinks.write_days_sized(df.limit(0), scratch(spark, "none"), ["id"])


def test_small_files_ask_for_no_task_each(spark, monkeypatch):
    """A task writes a file of each day of a group of days; large files have a task each, small groups several."""
    frame, dealt = type(spark.range(0)), []
    save = frame.repartitionById
    monkeypatch.setattr(frame, "repartitionById", lambda df, n, by: dealt.append(n) or save(df, n, by))
    df = spark.range(6000, numPartitions=4).select("id", F.date_add(F.lit("2024-01-01"), F.floor(F.sqrt(F.col("id") / 60)).cast("int")).alias("day"))
    want = {r.day: (r.n, max(1, int(r.n / 100 + 0.5))) for r in df.groupBy("day").agg(F.count("*").alias("n")).collect()}
    found = sorted((files for _, files in want.values()), reverse=True)
    for most, rows in ((64, 4_000_000), (4, 4_000_000), (64, 300), (64, 100)):
        monkeypatch.setattr(sinks, "FILES_PER_TASK", most, raising=False)
        monkeypatch.setattr(sinks, "ROWS_PER_FILE", rows)
        path = scratch(spark, "small")
        sinks.write_days_sized(df, path, ["id"], 100)
        held = spark.read.parquet(path).withColumn("file", F.input_file_name()).groupBy("day").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files")).collect()
        assert {r.day: (r.n, r.files) for r in held} == want
        assert dealt.pop() == sum(found[:: min(most, rows // 100)])


def test_layouts_pass_through_no_single_task(spark, monkeypatch):
    """A month of rows in several files in each layout that it fills, and the same rows in all."""
    monkeypatch.setattr(sinks, "LAYOUT_ROWS", 500, raising=False)
    df = spark.range(6000, numPartitions=4).select("id", F.timestamp_seconds(1_706_745_600 + F.col("id") * 400).cast("timestamp_ntz").alias("timestamp"))
    for name, path in sinks.write_layouts(df, scratch(spark, "layouts")).items():
        held = spark.read.parquet(path).withColumn("file", F.input_file_name())
        files = [r.n for r in held.groupBy("file").agg(F.count("*").alias("n")).collect()]
        assert sum(files) == 6000 and held.select("id").distinct().count() == 6000
        assert len(files) >= 4 and max(files) <= 1500, name


def test_bulk_load_after_a_failure(spark, monkeypatch):
    url, name = "jdbc:derby:memory:retry;create=true", "readings"
    df = spark.range(1000).select("id", (F.col("id") * 0.5).alias("x"))
    load = lambda: {r.load_part: (r.sent, r.arrived, r.total) for r in sinks.load_with_ledger(df, url, name, DERBY, F.col("id") % 4, 4, "x").collect()}
    run = sinks._statement

    def dies(spark_, url_, *texts):
        if any(t.startswith("RENAME") for t in texts):
            raise RuntimeError("the driver is gone")
        run(spark_, url_, *texts)

    monkeypatch.setattr(sinks, "_statement", dies)
    with pytest.raises(RuntimeError):
        load()
    monkeypatch.setattr(sinks, "_statement", run)
    # one part arrived in part, one twice
    run(spark, "jdbc:derby:memory:retry", f'DELETE FROM {name}_staging WHERE "id" IN (6, 10)')
    df.where("id % 4 = 3").withColumn("load_part", F.lit(3)).write.mode("append").jdbc("jdbc:derby:memory:retry", f"{name}_staging", properties={"driver": DERBY})
    want = {p: (250, 250, sum(k * 0.5 for k in range(p, 1000, 4))) for p in range(4)}
    assert load() == want
    assert load() == want  # over the table that is there
    back = spark.read.jdbc("jdbc:derby:memory:retry", name, properties={"driver": DERBY})
    assert sorted(r.id for r in back.collect()) == list(range(1000))


# ---- hashes of rows


def test_canonical_rows(spark):
    rows = [
        (1, "é", 1.5, date(1969, 12, 31), datetime(2024, 1, 1, 0, 0, 0, 5), True, b"\x00\xff"),
        (None, None, None, None, None, None, None),
        (-7, "", -0.0, date(2024, 2, 29), datetime(1969, 12, 31, 23, 59, 59), False, b""),
        (2, "1:a", float("nan"), None, None, None, None), (3, "-", float("-inf"), None, None, None, None), (4, "x", 1e13, None, None, None, None), (5, "x", 1e300, None, None, None, None), (6, "x", 0.0000005, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "k int, s string, x double, d date, t timestamp_ntz, b boolean, y binary")
    texts = [r[0] for r in df.select(canonical.row_text(df)).collect()]
    assert texts[0] == "1:11:é7:15000002:-116:17040672000000054:true4:00ff" and texts[1] == "-------"
    assert texts[2] == "2:-70:1:05:197828:-10000005:false0:" and texts[3].startswith("1:23:1:a3:nan") and texts[4].startswith("1:31:-4:-inf")
    assert texts[5].startswith("1:41:x14:10000000000000") and texts[6].startswith("1:51:x3:inf") and texts[7].startswith("1:61:x1:1")
    hashes = [r[0] for r in df.select(canonical.row_hash(df)).collect()]
    assert hashes == [int(hashlib.sha256(t.encode()).hexdigest()[:15], 16) for t in texts]
    total = reconcile.portable_fingerprint(df).first()
    assert (total["rows"], total.hash_sum) == (8, sum(hashes) % canonical.MODULUS)
    assert reconcile.portable_fingerprint(df.limit(0)).first().hash_sum == 0
