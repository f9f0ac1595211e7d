"""Raw documents to training tokens in five stages; each works on all that the one before it kept.

Defined cases, for every stage: a null text counts as empty, and an empty table gives an empty one.  Columns of the
documents pass through all stages but the last, whatever their names, and none but doc_id and text is read.  A null
doc_id orders behind all others.  By stage:

* quality: every row is judged by its text alone, so repeated rows stay or go together; without labels all stay;
* exact: of rows with equal text that of the smallest id stays, one where ids are equal too;
* near: a document is known by id and text together; texts without words are near to none;
* benchmark: likewise; a text without words holds no item;
* tokens: a row for each row; an empty text has no tokens and one segmentation; equal ids and texts give equal samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm import decontaminate, exact_dedup, ngram_join, quality, sentencepiece_sampling
from telemill.llm.common import read_table, save


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep(docs, read_table(spark, sf_dir, "labels"))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id."""
    return exact_dedup.deduplicate(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of two sampled segmentations."""
    out = sentencepiece_sampling.encode(docs, k=2)
    sample = lambda s: F.struct(F.size(s["ids"]).alias("n"), F.xxhash64(s["ids"]).alias("ids_hash"), *[s[c] for c in ("log_prob", "perturbed", "log_inclusion")])
    return out.select("doc_id", F.size("ids").alias("n_ids"), "ids", "round_trip", F.transform("samples", sample).alias("samples"))


STAGES = [
    ("quality", quality_filter),
    ("exact", exact_deduplication),
    ("near", near_deduplication),
    ("benchmark", decontamination),
    ("tokens", tokens),
]
#: SQL cannot fit the classifier, so the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
