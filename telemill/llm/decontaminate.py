"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

A short item inside a long document has a tiny Jaccard similarity to it, so both are not sketched alike: only
the item is (its K shingles of smallest hash), and documents are probed for these.  Each sketch shingle is in a
document with probability >= THRESHOLD when the item is contained that far.  Items are partitioned by their
number of shingles; each partition has its own K and asks for so many hits that a contained item is missed with
probability <= MISS.  Candidates are verified on full shingle sets: |item and document| / |item| >= THRESHOLD.

Documents are probed shingle by shingle instead of by a sketch of their own: a document of any length then
meets an item exactly as often as it holds shingles of its sketch, and its size needs no partition.

Words are runs of letters, digits and characters beyond ASCII, lower-cased; shingles are five words.  An item of one
to four words is one shingle of all of them, and documents are probed for runs of as many words.  The sketches are broadcast when they hold at most MAX_BROADCAST numbers, else joined by shuffle; so are the candidates
and the items.

Defined cases: null and empty texts have no words and no pairs; an item of one to four words is found wherever these
stand in a row; a pair of ids that stands for several rows counts
once, with the largest containment; null ids pair like others; other columns are never read.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import save, text_of

WORDS, THRESHOLD, MISS = 5, 0.8, 1e-6
#: Up to so many shingles an item gets a sketch of so many; larger items get the last one.
PARTITIONS = ((64, 12), (256, 16), (1 << 62, 24))
MAX_BROADCAST = 2_000_000
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BETWEEN), "")


def runs_of(words: Column, length: int) -> Column:
    """Hashes of the runs of so many words, repeats kept."""
    last = F.size(words) - (length - 1)
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, length)))
    return F.when(last > 0, runs).otherwise(F.array().cast("array<bigint>"))


def shingles_of(words: Column) -> Column:
    """Hashes of an item's runs of five words, or of all its words where there are fewer, repeats kept."""
    short = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(words) >= WORDS, runs_of(words, WORDS)).otherwise(short)


def hits_needed(k: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Most hits of k that a contained item reaches but for a probability of miss."""
    below, need = 0.0, 0
    while need < k and (below := below + comb(k, need) * threshold**need * (1 - threshold) ** (k - need)) <= miss:
        need += 1
    return max(1, need)


def sketches(items: DataFrame) -> DataFrame:
    """(_sh, _ikey, _need): the sketch of each item by its size partition; a sketch of all shingles needs the exact share."""
    k = F.lit(PARTITIONS[-1][1])
    need = F.lit(hits_needed(PARTITIONS[-1][1]))
    for most, size in reversed(PARTITIONS[:-1]):
        k = F.when(F.col("_n") <= most, size).otherwise(k)
        need = F.when(F.col("_n") <= most, hits_needed(size)).otherwise(need)
    need = F.when(F.col("_n") <= k, F.ceil(F.col("_n") * THRESHOLD - 1e-9)).otherwise(need)
    order = F.array_sort(F.transform("_set", lambda s: F.struct(F.xxhash64(s, F.lit(5)).alias("h"), s.alias("s"))))
    return items.select("_ikey", need.alias("_need"), F.explode(F.slice(order, F.lit(1), k)).alias("_o")).select(F.col("_o.s").alias("_sh"), "_ikey", "_need")


def _small(df: DataFrame, held: Column | None = None) -> DataFrame:
    """Broadcast a materialised table where the numbers it holds (its rows, or the sum of ``held``) are few enough; else leave it to a shuffled join."""
    size = df.agg(F.sum(held) if held is not None else F.count("*")).first()[0] or 0
    return F.broadcast(df) if size <= MAX_BROADCAST else df


def contained(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (id, item, n_shared, n_item, containment) of documents and the items they hold."""
    items = benchmark.select(F.col(item_col).alias("_iid"), words_of(text_of(item_text)).alias("_w"))
    items = items.select("_iid", F.xxhash64("_iid", "_w").alias("_ikey"), F.array_distinct(shingles_of(F.col("_w"))).alias("_set"), F.least(F.size("_w"), F.lit(WORDS)).alias("_long")).where("_long > 0")
    items = save(items.dropDuplicates(["_ikey"]).withColumn("_n", F.size("_set")), "items")
    lengths = sorted(r[0] for r in items.select("_long").distinct().collect())  # WORDS numbers at most
    runs = F.concat(F.array().cast("array<bigint>"), *[runs_of(F.col("_w"), n) for n in lengths])
    rows = docs.select(F.col(id_col).alias("_id"), words_of(text_of(text_col)).alias("_w"))

    # search: which documents hold enough of an item's sketch
    index = save(sketches(items), "sketches")
    probes = rows.select("_id", F.explode(runs).alias("_sh"))
    hits = probes.join(_small(index), "_sh").groupBy("_id", "_ikey", "_need").agg(F.count_distinct("_sh").alias("_hits"))
    candidates = save(hits.where("_hits >= _need").groupBy("_id").agg(F.collect_set("_ikey").alias("_ikeys")), "candidates")

    # verify on full shingle sets
    candidates = candidates.select(F.col("_id").alias("_cid"), "_ikeys")
    found = rows.join(_small(candidates, F.size("_ikeys")), F.col("_id").eqNullSafe(F.col("_cid")))
    found = found.select("_id", F.array_distinct(runs).alias("_have"), F.explode("_ikeys").alias("_ikey"))
    shared = F.size(F.array_intersect("_set", "_have")).cast("long")
    found = found.join(_small(items, F.col("_n")), "_ikey").select("_id", "_iid", shared.alias("n_shared"), F.col("_n").cast("long").alias("n_item"))
    found = found.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= THRESHOLD)
    best = found.groupBy("_id", "_iid").agg(F.max(F.struct("containment", "n_shared", "n_item")).alias("_b"))
    return best.select(F.col("_id").alias(id_col), F.col("_iid").alias(item_col), "_b.n_shared", "_b.n_item", "_b.containment")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no item.  A document is known by its id and text together, so rows that share an id, or have none, stand for themselves."""
    known = F.xxhash64(F.col(id_col), text_of(text_col))
    leaks = contained(docs.select(known.alias("_known"), F.col(text_col).alias("_text")), benchmark, "_known", "_text").select(F.col("_known").alias("_leak")).distinct()
    return docs.join(_small(save(leaks, "leaks")), known == F.col("_leak"), "left_anti")


ORACLE = f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{BETWEEN}'), lambda x: x <> '') AS w FROM documents),
     v AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{BETWEEN}'), lambda x: x <> '') AS w FROM benchmark),
     l AS (SELECT DISTINCT least(len(w), {WORDS}) AS n FROM v WHERE len(w) > 0),
     s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS sh FROM w, l WHERE len(w) >= n),
     t AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM v),
     n AS (SELECT item_id, count(*) AS n_item FROM t GROUP BY item_id),
     c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM s JOIN t USING (sh) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM c JOIN n USING (item_id) WHERE n_shared / n_item >= {THRESHOLD}
"""
