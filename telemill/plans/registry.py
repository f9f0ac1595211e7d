"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from telemill.sources.telemetry import REP_SQL, TEL_SQL, reports, telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: order that never ties
ORDER = ["timestamp", "event_id"]


class Lake:
    """The tables of a data folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def tel(self) -> DataFrame:
        return telemetry(self.spark, self.sf_dir)

    @cached_property
    def reports(self) -> DataFrame:
        return reports(self.spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def tel_sql(body: str, rep: bool = False) -> str:
    """SQL over tel (and rep): a SELECT, or further named steps and a SELECT."""
    head = f"WITH {TEL_SQL}" + (f", {REP_SQL}" if rep else "")
    body = body.strip()
    return f"{head} {body}" if body.upper().startswith("SELECT") else f"{head}, {body}"


def r(x: str, digits: int = 3) -> str:
    """The SQL of round_half."""
    return f"(round(round(({x}) * {10**digits}.0, 6), 0) / {10**digits}.0)"


def query(name: str, sql: str | None = None):
    """Register a function of a Lake."""

    def add(fn: Callable[[Lake], DataFrame]) -> Callable[[Lake], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Lake(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return add
