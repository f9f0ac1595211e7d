"""Writers: day partitions, single files, layouts, samples, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from telemill.operators.ranks import offset_of_parts
from telemill.sources.scratch import scratch


def write_days(df: DataFrame, path: str, day: str = "day", mode: str = "overwrite", order: list[str] | None = None) -> None:
    """Parquet folders by day, ZSTD; a day's rows meet in one task and, with ``order``, in one order.

    A day that outgrows a task is for ``write_days_sized``, or ``files_per_day`` of ``write_days_salted``.
    """
    out = df.repartition(day)
    out = out.sortWithinPartitions(day, *order) if order else out
    out.write.mode(mode).partitionBy(day).option("compression", "zstd").parquet(path)


def write_days_salted(df: DataFrame, path: str, files_per_day: int, by: list[str], day: str = "day", mode: str = "overwrite") -> None:
    """As write_days, with a day spread over several tasks and files by a hash of ``by``."""
    out = df.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(files_per_day))).repartition(day, "_salt").drop("_salt")
    out.write.mode(mode).partitionBy(day).option("compression", "zstd").parquet(path)


#: Rows of a file of ``write_days_sized``, and at most so many rows, and files, of one of its tasks where files are smaller.
ROWS_PER_FILE, FILES_PER_TASK = 4_000_000, 64


def write_days_sized(df: DataFrame, path: str, by: list[str], rows_per_file: int = ROWS_PER_FILE, day: str = "day", mode: str = "overwrite", order: list[str] | None = None, rows_per_task: int | None = None) -> DataFrame:
    """As write_days, each day in as many files as its rows ask for; (day, rows, files) as counted before the write.

    A day's rows are counted, and dealt by a hash of ``by`` into its number of pieces, one piece a file.  Counts and hash
    depend on the rows alone, so the same rows give the same cut in any run.  A task writes a piece of each day of a group
    of days: its rows are those of one file where files are large, and small files ask for no task each.
    """
    counts = df.groupBy(day).agg(F.count("*").alias("_count"))
    pieces = F.greatest(F.lit(1), F.round(F.col("_count") / rows_per_file)).cast("long")
    counts = counts.select(F.col(day).alias("_day"), F.col("_count").alias("_rows"), pieces.alias("_count"))
    # groups of days with like numbers of pieces; the window holds one row a day of the calendar
    most = min(FILES_PER_TASK, max(1, (rows_per_task or ROWS_PER_FILE) // rows_per_file))
    counts = counts.withColumn("_group", F.floor((F.row_number().over(W.orderBy(F.desc("_count"), "_day")) - 1) / most))
    tasks = offset_of_parts(counts.groupBy("_group").agg(F.max("_count").alias("_count")), "_group").withColumnRenamed("_count", "_tasks")
    plan_path = scratch(df.sparkSession, "day-pieces")
    counts.join(tasks, "_group").drop("_group").write.parquet(plan_path)
    plan = df.sparkSession.read.parquet(plan_path)
    total = plan.agg(F.max(F.col("_offset") + F.col("_tasks"))).first()[0] or 1
    salt = F.pmod(F.xxhash64(*by), F.col("_count"))
    out = df.join(F.broadcast(plan), F.col(day).eqNullSafe(F.col("_day")), "left")  # one row a day of the calendar
    out = out.repartitionById(int(total), (F.col("_offset") + salt).cast("int")).select(*df.columns)
    out = out.sortWithinPartitions(day, *order) if order else out
    out.write.mode(mode).partitionBy(day).option("compression", "zstd").parquet(path)
    return plan.select(F.col("_day").alias(day), F.col("_rows").alias("rows"), F.col("_count").alias("files"))


def write_single(df: DataFrame, path: str, drop: list[str] | None = None) -> None:
    """One file, for small reference tables."""
    df.drop(*(drop or [])).coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_ordered_csv(df: DataFrame, path: str, order: list[str]) -> None:
    df.orderBy(*order).write.mode("overwrite").csv(path, header=True)


def write_metrics(df: DataFrame, path: str) -> None:
    """A summary as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_sample(df: DataFrame, path: str, columns: list[str], where: Column | None = None, order: list[str] | None = None) -> None:
    """Some columns, some rows, in order of time."""
    out = df.where(where) if where is not None else df
    out.select(*columns).orderBy(*(order or columns[:1])).write.mode("overwrite").option("compression", "zstd").parquet(path)


#: Rows of a file of a layout: a task sorts them.
LAYOUT_ROWS = 1_000_000


def write_layouts(df: DataFrame, root: str, ts: str = "timestamp") -> dict[str, str]:
    """The same rows as one folder, by month, by week and by day; none of them in one task, a part in as many files as it asks for."""
    paths = {"single": f"{root}/single"}
    df.write.mode("overwrite").parquet(paths["single"])
    for name in ("month", "week", "day"):
        paths[name] = f"{root}/{name}"
        part = F.date_trunc(name, F.col(ts)).cast("date")
        write_days_sized(df.withColumn("part", part), paths[name], df.columns, LAYOUT_ROWS, day="part", rows_per_task=LAYOUT_ROWS)
    return paths


def load_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Materialise a view as a table of the catalog, in the warehouse or under a path."""
    out = df.write.mode("overwrite")
    (out.option("path", path) if path else out).saveAsTable(name)
    return df.sparkSession.table(name)


def load_jdbc(df: DataFrame, url: str, table: str, driver: str, properties: dict | None = None) -> DataFrame:
    """Load a table of an external database, and compare the row counts."""
    props = {"driver": driver, **(properties or {})}
    df.write.mode("overwrite").jdbc(url, table, properties=props)
    back = df.sparkSession.read.jdbc(url, table, properties=props)
    return df.agg(F.count("*").alias("sent")).crossJoin(back.agg(F.count("*").alias("arrived"))).withColumn("same", F.col("sent") == F.col("arrived"))


def _statement(spark: SparkSession, url: str, *texts: str) -> None:
    """Run statements of the database, each on its own."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        for text in texts:
            run = connection.createStatement()
            run.executeUpdate(text)
            run.close()
    finally:
        connection.close()


def _loaded(spark: SparkSession, url: str, table: str, props: dict, values: str) -> DataFrame | None:
    """(part, arrived, ...) as the database counts them; None where it has no such table."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    there = connection.getMetaData().getTables(None, None, table.upper(), None).next()
    connection.close()
    if not there:
        return None
    return spark.read.jdbc(url, f"(SELECT \"load_part\", count(*) AS \"arrived\"{values} FROM {table} GROUP BY \"load_part\") counted", properties=props)


def load_with_ledger(df: DataFrame, url: str, table: str, driver: str, part: Column, parts: int, total: str | None = None, tries: int = 3, properties: dict | None = None) -> DataFrame:
    """Bulk load of a whole record into an external database that survives failures; (load_part, sent, arrived[, total]).

    ``part`` deals the rows into ``parts`` parts, 0 on, which are written in parallel into a staging table.  The ledger of
    a part is what the database itself counts for it: a part whose count is not the source's is deleted and sent again, in
    this run or in the next, so nothing stands there twice.  When all counts are equal the staging table takes the
    table's name; a run that dies in between is completed by the next.  A staging table is taken up for the same source
    only: drop it where the source has changed since.  ``total`` names a column whose sum by part the database tells too.
    """
    spark, props = df.sparkSession, {"driver": driver, **(properties or {})}
    spark._jvm.java.lang.Class.forName(driver)
    staging = f"{table}_staging"
    rows = df.withColumn("load_part", F.coalesce(part.cast("int"), F.lit(0)))
    path = scratch(spark, "sent")
    rows.groupBy("load_part").agg(F.count("*").alias("sent")).write.parquet(path)
    sent = spark.read.parquet(path)
    for attempt in range(tries + 1):
        there = _loaded(spark, url, staging, props, "")
        want = sent if there is None else sent.join(there, "load_part", "left")
        missing = [r.load_part for r in (want if there is None else want.where("arrived IS NULL OR arrived <> sent")).select("load_part").collect()]  # at most parts
        if there is not None and not missing:
            break
        if attempt == tries:
            raise OSError(f"{table}: parts {missing} did not arrive whole")
        if there is not None:
            _statement(spark, url, f"DELETE FROM {staging} WHERE \"load_part\" IN ({', '.join(map(str, missing))})")
        rows.where(F.col("load_part").isin(missing)).repartition(min(parts, max(1, len(missing))), "load_part").write.mode("append").jdbc(url, staging, properties=props)
    if _loaded(spark, url, table, props, "") is not None:
        _statement(spark, url, f"DROP TABLE {table}")
    _statement(spark, url, f"RENAME TABLE {staging} TO {table}")
    return sent.join(_loaded(spark, url, table, props, f", sum(\"{total}\") AS \"total\"" if total else ""), "load_part", "full")


# ---- versions: a folder per version, and a manifest row for each


def write_version(df: DataFrame, root: str) -> int:
    """Append the next version and its manifest row; readers of older versions are not touched."""
    spark = df.sparkSession
    known = versions(spark, root)
    number = 0 if known is None else (known.agg(F.max("version")).first()[0] + 1)
    df.write.parquet(f"{root}/data/version={number}")
    spark.createDataFrame([(number, f"{root}/data/version={number}")], "version long, path string").coalesce(1).write.mode("append").json(f"{root}/manifest")
    return number


def versions(spark: SparkSession, root: str) -> DataFrame | None:
    """The manifest; None before the first version."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.json(f"{root}/manifest", schema="version long, path string")


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version by number, or the latest one."""
    known = versions(spark, root)
    at = known.where(F.col("version") == version) if version is not None else known.orderBy(F.col("version").desc())
    found = at.select("path").first()
    if found is None:
        raise ValueError(f"no version {version}")
    return spark.read.parquet(found.path)
