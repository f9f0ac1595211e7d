"""The registered queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from telemill.llm import decontaminate, exact_dedup, licenses, ngram_join, passages, periodic_runs, quality, secrets, sentencepiece_sampling, site_tree, substring_dedup, token_alignment, warc
from telemill.llm.common import read_table


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.classify(read_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classify(read_table(spark, sf_dir, "documents"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classify(read_table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str, k: int = 2) -> DataFrame:
    """Digests of the encoding and of k sampled segmentations; the operator itself returns the ids."""
    out = sentencepiece_sampling.encode(read_table(spark, sf_dir, "documents"), k=k)
    sample = lambda s: F.struct(F.size(s["ids"]).alias("n"), F.xxhash64(s["ids"]).alias("ids_hash"), *[s[c] for c in ("log_prob", "perturbed", "log_inclusion")])
    return out.select("doc_id", F.size("ids").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "round_trip", F.transform("samples", sample).alias("samples"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The owner is the source; a repository is the part of a source in one language."""
    docs = read_table(spark, sf_dir, "documents")
    return secrets.scan(docs, F.concat_ws("/", "source", "lang"), F.col("source"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op11_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.digest(token_alignment.align(read_table(spark, sf_dir, "documents")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.planted(read_table(spark, sf_dir, "documents"))
    return periodic_runs.digest(periodic_runs.runs(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_ngram_join": op1_ngram_join,
    "op2_warc": op2_warc,
    "op3_passages": op3_passages,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_quality": op6_quality,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_licenses": op8_licenses,
    "op9_secrets": op9_secrets,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_site_tree": op11_site_tree,
    "op12_token_alignment": op12_token_alignment,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op5_decontamination": decontaminate.ORACLE,
    "op8_licenses": licenses.ORACLE,
}
