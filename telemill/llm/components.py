"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import join_groups, save


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the smallest: the larger neighbours (large) or the smaller ones and the node itself."""
    from_ = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))) if large else edges
    least = from_.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    total = from_.count()
    joined = join_groups(from_, least, "u", "n", total, F.xxhash64("v", F.lit(1))).withColumn("m", F.least("m", "u"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) of every node of an edge between different nodes; root is the smallest node of its component."""
    e = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u > v").distinct()
    e = save(e, "edges")
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before, now = None, state(e)
    while now != before:
        e = save(_star(save(_star(e, True), "edges"), False), "edges")
        before, now = now, state(e)
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
