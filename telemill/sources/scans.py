"""Readers: telemetry CSV, partitioned Parquet, parallel-array JSON, small reference CSV, footers, inventories."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.functions import on_days

# fixed values: the columns of the raw file
ANALOGUE = ["TP2", "TP3", "H1", "DV_pressure", "Reservoirs", "Oil_temperature", "Motor_current"]
DIGITAL = ["COMP", "DV_eletric", "Towers", "MPG", "LPS", "Pressure_switch", "Oil_level", "Caudal_impulses"]


def telemetry_schema() -> T.StructType:
    """The raw file's columns; its first header cell is empty and becomes source_index."""
    fields = [T.StructField("source_index", T.LongType()), T.StructField("timestamp", T.TimestampNTZType())]
    return T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in ANALOGUE + DIGITAL])


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, days: tuple[str, str] | None = None, ts: str = "timestamp") -> DataFrame:
    """Telemetry CSV with a declared schema (nothing is inferred) and the derived day."""
    out = spark.read.csv(path, header=True, schema=schema or telemetry_schema(), enforceSchema=True).withColumn("day", F.to_date(ts))
    return on_days(out, *days) if days else out


def scan_days(spark: SparkSession, root: str, days: tuple[str, str] | None = None) -> DataFrame:
    """Day-partitioned Parquet; a day range prunes partitions."""
    out = spark.read.parquet(root)
    return on_days(out, *days) if days else out


def scan_hourly_json(spark: SparkSession, path: str) -> DataFrame:
    """{hourly: {time: [], temperature_2m: [], relative_humidity_2m: [], precipitation: []}} to one row per hour."""
    # fixed values: the names of the weather service's fields
    kind = "hourly struct<time:array<string>,temperature_2m:array<double>,relative_humidity_2m:array<double>,precipitation:array<double>>"
    rows = spark.read.json(path, schema=kind, multiLine=True).select(F.inline(F.arrays_zip("hourly.time", "hourly.temperature_2m", "hourly.relative_humidity_2m", "hourly.precipitation")))
    hour = F.to_timestamp_ntz(F.col("time"), F.lit("yyyy-MM-dd'T'HH:mm"))
    return rows.select(hour.alias("hour"), F.col("temperature_2m").cast("decimal(3,1)").alias("temperature"), F.col("relative_humidity_2m").alias("humidity"), F.col("precipitation").alias("rain"), F.to_date(hour).alias("day"))


def scan_reports(spark: SparkSession, path: str) -> DataFrame:
    """Failure reports; dates are text in the file."""
    at = lambda c: F.to_timestamp_ntz(F.col(c), F.lit("M/d/yyyy H:mm"))
    raw = spark.read.csv(path, header=True, schema="nr string, start_time string, end_time string, failure string, severity string, report string")
    return raw.withColumn("began", at("start_time")).withColumn("ended", at("end_time"))


def as_views(tables: dict[str, DataFrame]) -> None:
    """Named temporary views, for SQL over them."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def inventory(df: DataFrame) -> DataFrame:
    """One row per file of a file-based table: path, bytes, rows."""
    return df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.max("_metadata.file_size").alias("bytes"), F.count("*").alias("rows"))


def layer_summary(df: DataFrame, partition: str = "day") -> DataFrame:
    n = df.select(partition, F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("b"))
    files = n.groupBy("p").agg(F.max("b").alias("b"), F.count("*").alias("n"))
    return files.agg(F.count("*").alias("files"), F.sum("b").alias("bytes"), F.sum("n").alias("rows")).crossJoin(n.agg(F.count_distinct(partition).alias("partitions")))


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq
    from pyarrow import fs

    for batch in batches:
        rows = []
        for path in batch.column("path").to_pylist():
            store, local = fs.FileSystem.from_uri(path)
            with store.open_input_file(local) as file:
                meta = pq.ParquetFile(file).metadata
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                for c in range(group.num_columns):
                    col = group.column(c)
                    rows.append((col.path_in_schema, col.total_compressed_size, col.total_uncompressed_size, group.num_rows))
        yield pa.RecordBatch.from_pydict({"column": pa.array([r[0] for r in rows], pa.string()), "packed": pa.array([r[1] for r in rows], pa.int64()), "raw": pa.array([r[2] for r in rows], pa.int64()), "rows": pa.array([r[3] for r in rows], pa.int64())})


def column_weights(df: DataFrame) -> DataFrame:
    """Parquet footers by column: compressed and raw bytes, their ratio, percent of the whole.  Only footers are read."""
    files = df.select(F.col("_metadata.file_path").alias("path")).distinct()
    by = files.mapInArrow(_footers, "column string, packed long, raw long, rows long").groupBy("column").agg(F.sum("packed").alias("packed"), F.sum("raw").alias("raw"), F.sum("rows").alias("rows"))
    total = F.broadcast(by.agg(F.sum("packed").alias("_t")))
    return by.crossJoin(total).select("column", "packed", "raw", "rows", (F.col("raw") / F.col("packed")).alias("ratio"), (F.col("packed") * 100.0 / F.col("_t")).alias("percent"))
