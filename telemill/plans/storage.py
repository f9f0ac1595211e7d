"""Scans, sinks, ingest and snapshots: each query writes what it needs from the given tables and reads it back."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.functions import round_half
from telemill.operators import reconcile
from telemill.plans.registry import Lake, query, r, tel_sql
from telemill.plans.relational import with_holes
from telemill.plans.timeseries import silver
from telemill.sources import ingest, scans, sinks
from telemill.sources.scratch import scratch

col, lit = F.col, F.lit
PER_DAY = tel_sql("SELECT day, count(*) AS n FROM tel GROUP BY day")
TEXT_TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def per_day(df: DataFrame) -> DataFrame:
    return df.groupBy("day").agg(F.count("*").alias("n"))


def _csv(k: Lake) -> str:
    """The readings as raw files whose first header cell is empty."""
    path = scratch(k.spark, "csv")
    raw = k.tel.select(col("event_id").alias("idx"), F.date_format("timestamp", TEXT_TS).alias("timestamp"), "pressure", "oil", "dv")
    raw.write.csv(path, header=True)
    return path


RAW = T.StructType([T.StructField("source_index", T.LongType()), T.StructField("timestamp", T.TimestampNTZType()), *[T.StructField(c, T.DoubleType()) for c in ("pressure", "oil", "dv")]])


@query("src_01_csv", tel_sql(f"SELECT day, count(*) AS n, min(event_id) AS first_index, {r('sum(pressure)', 2)} AS pressure FROM tel WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY day"))
def src_01(k: Lake) -> DataFrame:
    t = scans.scan_csv(k.spark, _csv(k), RAW, ("2024-01-05", "2024-01-20"))
    return t.groupBy("day").agg(F.count("*").alias("n"), F.min("source_index").alias("first_index"), round_half(F.sum("pressure"), 2).alias("pressure"))


def _days(k: Lake, df: DataFrame | None = None) -> str:
    path = scratch(k.spark, "days")
    sinks.write_days(k.tel if df is None else df, path, order=["timestamp"])
    return path


@query("src_02_partitioned", tel_sql("SELECT day, count(*) AS n FROM tel WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-04' GROUP BY day"))
def src_02(k: Lake) -> DataFrame:
    return per_day(scans.scan_days(k.spark, _days(k), ("2024-01-03", "2024-01-04")))


@query("src_03_json_arrays", tel_sql("h AS (SELECT date_trunc('hour', timestamp) AS hour, CAST(round(avg(oil), 1) AS DECIMAL(3,1)) AS temperature, count(*)::DOUBLE AS humidity, sum(lps) AS rain FROM tel WHERE event_type = 'view' AND pressure < 900 GROUP BY 1) SELECT count(*) AS hours, min(hour) AS first_hour, max(hour) AS last_hour, CAST(sum(humidity) AS BIGINT) AS humidity FROM h"))
def src_03(k: Lake) -> DataFrame:
    """A payload of parallel arrays, as a weather service gives it, back to rows."""
    path = scratch(k.spark, "json")
    h = k.tel.where("event_type = 'view' and pressure < 900").groupBy(F.date_trunc("hour", "timestamp").alias("hour")).agg(F.round(F.avg("oil"), 1).alias("t"), F.count("*").cast("double").alias("h"), F.sum("lps").alias("r"))
    rows = F.sort_array(F.collect_list(F.struct("hour", "t", "h", "r")))
    part = lambda f: F.transform(col("a"), f)
    by_day = h.groupBy(F.to_date("hour")).agg(rows.alias("a"))
    by_day.select(F.struct(part(lambda x: F.date_format(x["hour"], "yyyy-MM-dd'T'HH:mm")).alias("time"), part(lambda x: x["t"]).alias("temperature_2m"), part(lambda x: x["h"]).alias("relative_humidity_2m"), part(lambda x: x["r"]).alias("precipitation")).alias("hourly")).repartition(40).write.json(path)
    # a file may hold several days, one object per line
    kind = "hourly struct<time:array<string>,temperature_2m:array<double>,relative_humidity_2m:array<double>,precipitation:array<double>>"
    lines = k.spark.read.json(path, schema=kind)
    single = scratch(k.spark, "payload")
    lines.agg(F.flatten(F.collect_list("hourly.time")).alias("time"), F.flatten(F.collect_list("hourly.temperature_2m")).alias("temperature_2m"), F.flatten(F.collect_list("hourly.relative_humidity_2m")).alias("relative_humidity_2m"), F.flatten(F.collect_list("hourly.precipitation")).alias("precipitation")).select(F.struct("*").alias("hourly")).write.json(single)
    t = scans.scan_hourly_json(k.spark, single)
    return t.agg(F.count("*").alias("hours"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.sum("humidity").cast("bigint").alias("humidity"))


@query("src_04_text_dates", tel_sql("SELECT nr, began, ended, failure, (SELECT count(*) FROM tel) AS readings FROM rep", rep=True))
def src_04(k: Lake) -> DataFrame:
    from telemill.sources.telemetry import REPORTS

    path = scratch(k.spark, "reports")
    k.spark.createDataFrame([(*x, "", "") for x in REPORTS], "nr string, start_time string, end_time string, failure string, severity string, report string").coalesce(1).write.csv(path, header=True)
    return scans.scan_reports(k.spark, path).select("nr", "began", "ended", "failure").crossJoin(k.tel.agg(F.count("*").alias("readings")))


def _versions(k: Lake) -> str:
    root = scratch(k.spark, "versions")
    sinks.write_version(per_day(k.tel.where("event_type <> 'error'")), root)
    sinks.write_version(per_day(k.tel), root)
    return root


@query("src_05_as_of", tel_sql("SELECT 'old' AS what, day, count(*) AS n FROM tel WHERE event_type <> 'error' GROUP BY day UNION ALL SELECT 'latest', day, count(*) FROM tel GROUP BY day"))
def src_05(k: Lake) -> DataFrame:
    root = _versions(k)
    old, new = sinks.read_version(k.spark, root, 0), sinks.read_version(k.spark, root)
    return old.select(lit("old").alias("what"), "day", "n").union(new.select(lit("latest"), "day", "n"))


@query("src_06_current_version", tel_sql("SELECT 1::BIGINT AS version, count(*) AS days, (SELECT count(*) FROM tel) AS readings FROM (SELECT DISTINCT day FROM tel)"))
def src_06(k: Lake) -> DataFrame:
    root = _versions(k)
    current = sinks.versions(k.spark, root).agg(F.max("version").alias("version"))
    return current.crossJoin(sinks.read_version(k.spark, root).agg(F.count("*").alias("days"), F.sum("n").alias("readings")))


@query("src_07_views", PER_DAY)
def src_07(k: Lake) -> DataFrame:
    scans.as_views({"tel_view": k.tel})
    return k.spark.sql("SELECT day, count(*) AS n FROM tel_view GROUP BY day")


@query("src_08_arrow_table", tel_sql("SELECT day, count(*) AS n FROM tel WHERE lps = 1 GROUP BY day"))
def src_08(k: Lake) -> DataFrame:
    """A summary as an Arrow table, and back as a relation."""
    summary: pa.Table = per_day(k.tel.where("lps = 1")).toArrow()
    return k.spark.createDataFrame(summary)


@query("src_09_inventory", tel_sql("SELECT count(*) AS rows, count(DISTINCT day) AS partitions, TRUE AS has_files FROM tel"))
def src_09(k: Lake) -> DataFrame:
    return scans.layer_summary(k.spark.read.parquet(_days(k))).select("rows", "partitions", ((col("files") >= col("partitions")) & (col("bytes") > 0)).alias("has_files"))


@query("src_10_column_weights")
def src_10(k: Lake) -> DataFrame:
    return scans.column_weights(k.table("events"))


@query("src_11_calendar", tel_sql("b AS (SELECT min(day)::TIMESTAMP AS a, max(day)::TIMESTAMP AS z FROM tel) SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM b"))
def src_11(k: Lake) -> DataFrame:
    return k.tel.agg(F.min("day").alias("a"), F.max("day").alias("z")).select(F.explode(F.sequence("a", "z")).alias("day"))


@query("src_12_literals", tel_sql("v AS (SELECT * FROM (VALUES ('a', 1.5::DOUBLE), ('b', NULL), (NULL, 2.5::DOUBLE)) x(name, x)) SELECT name, x, x IS NULL AS hole, (SELECT count(*) FROM tel WHERE oil > coalesce(x, 0)) AS above FROM v"))
def src_12(k: Lake) -> DataFrame:
    v = k.spark.createDataFrame([("a", 1.5), ("b", None), (None, 2.5)], "name string, x double")
    limits = [F.struct(lit(x).alias("_x"), F.count_if(col("oil") > x).alias("above")) for x in (0.0, 1.5, 2.5)]  # one pass for all
    n = k.tel.agg(F.array(*limits).alias("a")).select(F.inline("a"))
    return v.join(F.broadcast(n), F.coalesce("x", lit(0.0)) == col("_x")).select("name", "x", col("x").isNull().alias("hole"), "above")


@query("flt_09_by_partition", tel_sql("SELECT count(*) AS by_partition, count(*) AS by_expression FROM tel WHERE day = DATE '2024-01-12'"))
def flt_09_partition(k: Lake) -> DataFrame:
    """One day of the day layout by its partition key, which opens one folder, and by an expression on the time, which opens all."""
    t, day = k.spark.read.parquet(_days(k)), lit("2024-01-12").cast("date")
    key, expression = t.where(col("day") == day), t.where(F.to_date("timestamp") == day)
    return key.agg(F.count("*").alias("by_partition")).crossJoin(expression.agg(F.count("*").alias("by_expression")))


# ---- sinks


@query("snk_01_by_day", PER_DAY)
def snk_01(k: Lake) -> DataFrame:
    return per_day(k.spark.read.parquet(_days(k)))


@query("snk_01_by_day_salted", PER_DAY)
def snk_01_salted(k: Lake) -> DataFrame:
    path = scratch(k.spark, "salted")
    sinks.write_days_salted(k.tel, path, 4, ["event_id"])
    return per_day(k.spark.read.parquet(path))


@query("snk_02_single_file", tel_sql("SELECT count(*) AS n, 1::BIGINT AS files FROM tel"))
def snk_02(k: Lake) -> DataFrame:
    path = scratch(k.spark, "single")
    sinks.write_single(k.tel, path, ["day"])
    return scans.inventory(k.spark.read.parquet(path)).agg(F.sum("rows").alias("n"), F.count("*").alias("files"))


@query("snk_03_ordered_csv", tel_sql(f"SELECT count(*) AS n, {r('sum(pressure)', 2)} AS pressure, min(timestamp) AS first_ts FROM tel"))
def snk_03(k: Lake) -> DataFrame:
    path = scratch(k.spark, "csv")
    sinks.write_ordered_csv(k.tel.select("event_id", F.date_format("timestamp", TEXT_TS).alias("timestamp"), "pressure"), path, ["timestamp", "event_id"])
    t = k.spark.read.csv(path, header=True, schema="event_id long, timestamp timestamp_ntz, pressure double")
    return t.agg(F.count("*").alias("n"), round_half(F.sum("pressure"), 2).alias("pressure"), F.min("timestamp").alias("first_ts"))


DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@query("snk_04_jdbc", tel_sql(f"SELECT CAST(event_id % 8 AS INTEGER) AS load_part, count(*) AS sent, count(*) AS arrived, {r('sum(pressure)')} AS total FROM tel GROUP BY 1"))
def snk_04(k: Lake) -> DataFrame:
    """Bulk load of the record into the database that comes with Spark, any JDBC URL works alike: sent from the lake, arrived and total from the database."""
    name = scratch(k.spark, "readings").rsplit("-", 1)[1][:12]
    rows = k.tel.select("event_id", F.date_format("timestamp", TEXT_TS).alias("at"), "pressure", "dv")
    out = sinks.load_with_ledger(rows, f"jdbc:derby:memory:lake{name};create=true", f"readings_{name}", DERBY, col("event_id") % 8, 8, "pressure")
    return out.select("load_part", "sent", col("arrived").cast("bigint").alias("arrived"), round_half(col("total"), 3).alias("total"))


@query("snk_05_metrics", tel_sql(f"SELECT count(*) AS readings, {r('avg(dv)', 6)} AS duty FROM tel"))
def snk_05(k: Lake) -> DataFrame:
    path = scratch(k.spark, "metrics")
    sinks.write_metrics(k.tel.agg(F.count("*").alias("readings"), round_half(F.avg("dv"), 6).alias("duty")), path)
    return k.spark.read.json(path, schema="readings long, duty double")


@query("snk_06_versions", tel_sql("SELECT 0::BIGINT AS version, count(DISTINCT day) FILTER (WHERE event_type <> 'error') AS rows FROM tel UNION ALL SELECT 1::BIGINT, count(DISTINCT day) FROM tel"))
def snk_06(k: Lake) -> DataFrame:
    """Every version of the manifest with the rows it still has."""
    root = _versions(k)
    told = [sinks.read_version(k.spark, root, v).agg(F.count("*").alias("rows")).select(lit(v).cast("bigint").alias("version"), "rows") for v in range(2)]
    return sinks.versions(k.spark, root).select("version").join(told[0].union(told[1]), "version", "left")


@query("snk_07_samples", tel_sql("SELECT event_id, timestamp, dv FROM tel WHERE day = DATE '2024-01-12'"))
def snk_07(k: Lake) -> DataFrame:
    path = scratch(k.spark, "sample")
    sinks.write_sample(k.tel, path, ["event_id", "timestamp", "dv"], col("day") == lit("2024-01-12").cast("date"), ["timestamp", "event_id"])
    return k.spark.read.parquet(path)


LAYOUTS_SQL = tel_sql("n AS (SELECT count(*) AS n FROM tel WHERE day = DATE '2024-01-12') SELECT layout, n FROM (VALUES ('single'), ('month'), ('week'), ('day')) v(layout), n")


@query("snk_08_layouts", LAYOUTS_SQL)
def snk_08(k: Lake) -> DataFrame:
    """A one-day count over four layouts; the filter on the partition prunes folders in the last three."""
    out = None
    day = F.to_date(lit("2024-01-12"))
    for name, path in sinks.write_layouts(k.tel, scratch(k.spark, "layouts")).items():
        t = k.spark.read.parquet(path).where(col("day") == day)
        t = t.where(col("part") == F.date_trunc(name, day).cast("date")) if name != "single" else t
        t = t.agg(F.count("*").alias("n")).select(lit(name).alias("layout"), "n")
        out = t if out is None else out.union(t)
    return out


@query("rec_04_layouts_agree", tel_sql("SELECT 1::BIGINT AS answers, (SELECT count(*) FROM tel WHERE day = DATE '2024-01-12') AS n"))
def rec_04(k: Lake) -> DataFrame:
    return snk_08(k).agg(F.count_distinct("n").alias("answers"), F.max("n").alias("n"))


@query("snk_09_column_ladder", tel_sql("SELECT columns, count(*) AS rows, TRUE AS near FROM tel, (VALUES (1), (2), (4)) v(columns) GROUP BY columns"))
def snk_09(k: Lake) -> DataFrame:
    """Ever fewer columns rewritten: the rows stay, and the file has about the size that the footers of the whole one predict."""
    out, whole = None, scratch(k.spark, "ladder")
    k.tel.write.parquet(whole)
    weights = scans.column_weights(k.spark.read.parquet(whole))
    for cols in (["dv"], ["dv", "oil"], ["dv", "oil", "pressure", "timestamp"]):
        path = scratch(k.spark, "ladder")
        k.tel.select(*cols).write.parquet(path)
        predicted = weights.where(col("column").isin(cols)).agg(F.sum("packed").alias("predicted"))
        w = scans.column_weights(k.spark.read.parquet(path)).agg(F.count("*").cast("int").alias("columns"), F.max("rows").alias("rows"), F.sum("packed").alias("measured")).crossJoin(predicted)
        w = w.select("columns", "rows", (F.abs(col("predicted") / col("measured") - 1) < 0.25).alias("near"))
        out = w if out is None else out.union(w)
    return out


@query("snk_10_same_content", tel_sql("SELECT arm, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS ids, TRUE AS same FROM tel, (VALUES ('one'), ('other')) v(arm) GROUP BY arm"))
def snk_10(k: Lake) -> DataFrame:
    """Written twice from other partitions: the same content."""
    a, b = (k.spark.read.parquet(_days(k, df)).select(*k.tel.columns) for df in (k.tel, k.tel.repartition(9)))
    same = reconcile.compare_fingerprints(reconcile.fingerprint(a).withColumn("table", lit("tel")), reconcile.fingerprint(b).withColumn("table", lit("tel"))).select("same")
    told = lambda df, arm: df.agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids")).select(lit(arm).alias("arm"), "rows", "ids")
    return told(a, "one").union(told(b, "other")).crossJoin(F.broadcast(same))


AIM = 100


@query("snk_12_sized_days", tel_sql(f"SELECT day, count(*) AS n, CAST(greatest(1, round(count(*) / {AIM}.0)) AS BIGINT) AS files, TRUE AS near_aim, sum(event_id)::BIGINT AS ids FROM tel GROUP BY day"))
def snk_12(k: Lake) -> DataFrame:
    """Days in files of a hundred rows or so: files as found in the folders, and whether each is within a factor of two of its share."""
    path = scratch(k.spark, "sized")
    sinks.write_days_sized(k.tel, path, ["event_id"], AIM, order=["timestamp", "event_id"])
    held = k.spark.read.parquet(path)
    files = held.groupBy("day", F.input_file_name().alias("file")).agg(F.count("*").alias("c"), F.sum("event_id").alias("i"))
    share = F.sum("c") / F.count("*")
    return files.groupBy("day").agg(F.sum("c").alias("n"), F.count("*").alias("files"), ((F.min("c") * 2 >= share) & (F.max("c") <= 2 * share)).alias("near_aim"), F.sum("i").alias("ids"))


@query("snk_11_table", PER_DAY)
def snk_11(k: Lake) -> DataFrame:
    """A table of the catalog made from a view, its files in the shared folder."""
    path = scratch(k.spark, "table")
    per_day(k.tel).createOrReplaceTempView("per_day_view")
    return sinks.load_table(k.spark.table("per_day_view"), path.rsplit("/", 1)[1].replace("-", "_"), path)


# ---- ingest


@query("ing_01_replace", tel_sql("SELECT count(*) AS first_run, count(*) AS second_run FROM tel"))
def ing_01(k: Lake) -> DataFrame:
    path = scratch(k.spark, "bronze")
    a, b = ingest.replace(k.tel, path), ingest.replace(k.tel, path)
    return k.spark.createDataFrame([(a, b)], "first_run long, second_run long")


@query("ing_02_backfill", tel_sql("SELECT day, count(*) AS n FROM tel WHERE day NOT IN (DATE '2024-01-10', DATE '2024-01-11') GROUP BY day UNION ALL SELECT day, count(*) AS n FROM tel WHERE event_type = 'view' AND day IN (DATE '2024-01-10', DATE '2024-01-11') GROUP BY day"))
def ing_02(k: Lake) -> DataFrame:
    path = _days(k)
    ingest.backfill(k.tel.where("event_type = 'view'"), path, "2024-01-10", "2024-01-11")
    return per_day(k.spark.read.parquet(path))


@query("ing_02_untouched", tel_sql("SELECT count(DISTINCT day) - 2 AS stayed, 2::BIGINT AS went, 2::BIGINT AS came FROM tel"))
def ing_02_untouched(k: Lake) -> DataFrame:
    path = _days(k)
    listed = scratch(k.spark, "listed")
    ingest.file_times(k.spark.read.parquet(path)).write.parquet(listed)
    before = k.spark.read.parquet(listed)
    ingest.backfill(k.tel.where("event_type = 'view'"), path, "2024-01-10", "2024-01-11")
    return ingest.untouched(before, ingest.file_times(k.spark.read.parquet(path)))


@query("ing_03_naive_append", tel_sql("SELECT 3 * count(*) AS n FROM tel"))
def ing_03(k: Lake) -> DataFrame:
    path = scratch(k.spark, "append")
    for _ in range(3):
        ingest.append(k.tel, path)
    return k.spark.read.parquet(path).agg(F.count("*").alias("n"))


def _guarded(k: Lake, change: bool) -> DataFrame:
    source, target, manifest = (scratch(k.spark, n) for n in ("source", "target", "manifest"))
    read = lambda paths: k.spark.read.csv(paths, header=True, schema="event_id long, pressure double")

    def run(number: int) -> DataFrame:
        ingest.guarded_append(k.spark, source, target, manifest, read)
        held = ingest.read_committed(k.spark, target, manifest).agg(F.count("*").alias("rows"), round_half(F.sum("pressure"), 2).alias("pressure"), F.count_distinct("event_id").alias("readings"))
        return k.spark.createDataFrame([(number, *held.first())], "run int, rows long, pressure double, readings long")

    k.tel.select("event_id", "pressure").write.csv(source, header=True)
    runs = [run(0), run(1)]
    if change:
        k.tel.select("event_id", (col("pressure") + 1).alias("pressure")).write.mode("overwrite").csv(source, header=True)
        runs.append(run(2))
    return reduce(DataFrame.union, runs)


RUN_SQL = f"SELECT {{run}} AS run, {{times}} * count(*) AS rows, {r('{total}', 2)} AS pressure, count(DISTINCT event_id) AS readings FROM tel"
RUNS_SQL = " UNION ALL ".join(RUN_SQL.format(run=n, times=1, total="sum(pressure)") for n in range(2))


@query("ing_04_guarded_append", tel_sql(RUNS_SQL))
def ing_04(k: Lake) -> DataFrame:
    """What is held after the first run and after a second one that must add nothing."""
    return _guarded(k, False)


@query("ing_05_changed_source", tel_sql(f"{RUNS_SQL} UNION ALL {RUN_SQL.format(run=2, times=2, total='2 * sum(pressure) + count(*)')}"))
def ing_05(k: Lake) -> DataFrame:
    """As ing_04, and a third run over a source whose files all changed."""
    return _guarded(k, True)


@query("ing_06_manifest", tel_sql("SELECT count(*) AS rows, count(DISTINCT day) AS partitions FROM tel"))
def ing_06(k: Lake) -> DataFrame:
    source, out = _csv(k), scratch(k.spark, "manifest")
    row = ingest.manifest_row(scans.scan_csv(k.spark, source, RAW), ingest.file_hashes(k.spark, source))
    sinks.write_metrics(row, out)
    return k.spark.read.json(out, schema="files long, bytes long, sha256 string, rows long, partitions long").where("length(sha256) = 64").select("rows", "partitions")


@query("ing_07_empty_days", tel_sql("cal AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day), h AS (SELECT day, count(*) AS n FROM tel WHERE day NOT IN (DATE '2024-01-09', DATE '2024-01-21') GROUP BY day) SELECT day, coalesce(n, 0) AS n FROM cal LEFT JOIN h USING (day)"))
def ing_07(k: Lake) -> DataFrame:
    return ingest.with_empty_days(per_day(with_holes(k.tel)), "2024-01-01", "2024-01-30")


@query("fpr_01_source_hash", tel_sql("SELECT day, sha256(string_agg(CAST(event_id AS VARCHAR) || chr(10), '' ORDER BY event_id)) AS sha256 FROM tel GROUP BY day"))
def fpr_01(k: Lake) -> DataFrame:
    """Source files, one a day with a line for each reading, and the hash of each file."""
    path = scratch(k.spark, "lines")
    lines = k.tel.select("day", "event_id").repartition("day").sortWithinPartitions("day", "event_id")
    lines.select(col("event_id").cast("string").alias("value"), "day").write.partitionBy("day").text(path)
    return ingest.file_hashes(k.spark, path, "*.txt").select(F.to_date(F.regexp_extract("path", "day=([0-9-]+)", 1)).alias("day"), "sha256")


LINES_SQL = "l AS (SELECT day, event_id, CAST(event_id AS VARCHAR) AS line FROM tel), o AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY day ORDER BY event_id) AS upto FROM l), b AS (SELECT *, upto - length(line) - 1 AS since, CAST(upto - length(line) - 1 AS BIGINT) // 64 AS block FROM o)"


@query("fpr_07_block_hashes", tel_sql(f"{LINES_SQL} SELECT day, CAST(block AS BIGINT) AS block, CAST(min(since) AS BIGINT) AS from_byte, CAST(max(upto) AS BIGINT) AS to_byte, sha256(string_agg(line, chr(10) ORDER BY event_id)) AS sha256 FROM b GROUP BY day, block"))
def fpr_07(k: Lake) -> DataFrame:
    """Source files hashed in blocks of 64 bytes, wherever the reader splits them."""
    path = scratch(k.spark, "lines")
    lines = k.tel.select("day", "event_id").repartition("day").sortWithinPartitions("day", "event_id")
    lines.select(col("event_id").cast("string").alias("value"), "day").write.partitionBy("day").text(path)
    found = ingest.block_hashes(k.spark, path, 64, "*.txt")
    return found.select(F.to_date(F.regexp_extract("path", "day=([0-9-]+)", 1)).alias("day"), "block", "from_byte", "to_byte", "sha256")


@query("fpr_06_missing_paths", tel_sql("SELECT 2::BIGINT AS gone FROM tel LIMIT 1"))
def fpr_06(k: Lake) -> DataFrame:
    path = _days(k)
    before = scans.inventory(k.spark.read.parquet(path))
    after = before.where(~col("path").contains("day=2024-01-09") & ~col("path").contains("day=2024-01-21"))
    return reconcile.missing_paths(before, after).agg(F.count("*").alias("gone"))


@query("pipe_01_bronze_to_gold", tel_sql("SELECT day, count(*) AS readings FROM tel GROUP BY day"))
def pipe_01(k: Lake) -> DataFrame:
    """Bronze, silver and gold written one after the other, and gold read back."""
    from telemill.operators.gold import daily_cycle
    from telemill.sources.telemetry import FULL_DAY

    bronze = k.spark.read.parquet(_days(k))
    lake = Lake(k.spark, k.sf_dir)
    lake.__dict__["tel"] = bronze
    silver_at, gold_at = scratch(k.spark, "silver"), scratch(k.spark, "gold")
    sinks.write_days(silver(lake), silver_at, order=["timestamp"])
    daily_cycle(k.spark.read.parquet(silver_at), FULL_DAY).write.parquet(gold_at)
    return k.spark.read.parquet(gold_at).select("day", "readings")
