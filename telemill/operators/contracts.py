"""Data contracts: promises that must have no offenders, breakage suites, and row rules with a quarantine."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.operators.profile import all_of

Promise = tuple[str, Callable[[DataFrame], DataFrame]]


def check(df: DataFrame, promises: list[Promise]) -> DataFrame:
    """By promise: offenders and whether it is broken; a promise that cannot be put to the table is broken.

    Promises on rows and on aggregates are all judged in one pass; others take one each.
    """
    spark = df.sparkSession
    out, together = [], []
    for name, offenders in promises:
        try:
            if hasattr(offenders, "count_of"):
                df.agg(offenders.count_of).schema  # analysed now, run later
                together.append(F.struct(F.lit(name).alias("promise"), F.coalesce(offenders.count_of, F.lit(0)).cast("long").alias("offenders")))
            else:
                bad = offenders(df)
                bad.schema
                out.append(bad.agg(F.lit(name).alias("promise"), F.count("*").alias("offenders")))
        except AnalysisException:
            out.append(spark.range(1).select(F.lit(name).alias("promise"), F.lit(None).cast("long").alias("offenders")))
    if together:
        out.append(df.agg(F.array(*together).alias("_all")).select(F.inline("_all")))
    return reduce(DataFrame.unionByName, out).withColumn("broken", F.coalesce(F.col("offenders") > 0, F.lit(True)))


def _counted(offenders: Callable[[DataFrame], DataFrame], count_of: Column) -> Callable[[DataFrame], DataFrame]:
    """Offenders that an aggregate over the whole table counts."""
    offenders.count_of = count_of
    return offenders


def column_names(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "column string")


def has_columns(agreed: list[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: column_names(df.sparkSession, [c for c in agreed if c not in df.columns])


def no_other_columns(agreed: list[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: column_names(df.sparkSession, [c for c in df.columns if c not in agreed])


def unique(*keys: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def aggregate_in(value: Column, low: float, high: float) -> Callable[[DataFrame], DataFrame]:
    return _counted(lambda df: df.agg(value.alias("v")).where(~F.col("v").between(low, high)), (~value.between(low, high)).cast("long"))


def never(condition: Column) -> Callable[[DataFrame], DataFrame]:
    """Rows of a condition; it is projected first, as a filter alone would still find columns that were renamed away."""
    return _counted(lambda df: df.withColumn("_offends", condition).where("_offends").drop("_offends"), F.count_if(condition))


def accepted(column: str, values: list) -> Callable[[DataFrame], DataFrame]:
    return never(F.col(column).isNotNull() & ~F.col(column).isin(values))


def not_null(column: str) -> Callable[[DataFrame], DataFrame]:
    return never(F.col(column).isNull())


def breakage(df: DataFrame, changes: dict[str, Callable[[DataFrame], DataFrame]], contracts: dict[str, list[Promise]]) -> DataFrame:
    """By change and contract: how many promises notice it.  A promise of several contracts (known by its name) is judged once a change."""
    spark = df.sparkSession
    promises = list({name: (name, offenders) for contract in contracts.values() for name, offenders in contract}.values())
    members = spark.createDataFrame([(c, name) for c, contract in contracts.items() for name, _ in contract], "contract string, promise string")
    out = []
    for change, apply in changes.items():
        found = check(apply(df), promises).join(F.broadcast(members), "promise")
        out.append(found.groupBy("contract").agg(F.count_if("broken").alias("noticed")).select(F.lit(change).alias("change"), "contract", "noticed"))
    return reduce(DataFrame.unionByName, out)


def judge_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``broken``: the names of the rules a row breaks (a rule that is null for a row is not broken)."""
    named = [F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("broken", F.filter(F.array(*named), lambda x: x.isNotNull()))


def key_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows of a key that is null or stands more than once."""
    twice = df.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    cond = [df[k].eqNullSafe(twice[k]) for k in key]
    return df.where(~all_of([F.col(k).isNotNull() for k in key])).unionByName(df.where(all_of([F.col(k).isNotNull() for k in key])).join(twice, cond, "left_semi"))


def orphans(df: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose key the parent lacks."""
    return df.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def split(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine)."""
    judged = judge_rows(df, rules)
    return judged.where(F.size("broken") == 0).drop("broken"), judged.where(F.size("broken") > 0)


def rule_listing(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules by column: (column, kind, text)."""
    return spark.createDataFrame(rules, "column string, kind string, rule string").groupBy("column").agg(F.count("*").alias("rules"), F.array_join(F.sort_array(F.collect_list("kind")), ",").alias("kinds"))
