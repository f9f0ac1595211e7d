"""Exact duplicates by two-pass Bloom filtering, in DataFrame operations only.

Pass 1 sets each text's bits in a Bloom filter of 64-bit words and keeps those set by two rows or more: the
"seen again" filter.  Pass 2 tests every row against it.  Rows that it clears have no equal anywhere and pass
straight through; only the rest are grouped by their SHA-256.  The filter has BITS_PER_ROW bits for each row
whatever their number, so it never fills up; a false positive costs one shuffled row, never a wrong answer.

What pass 1 shuffles is a word and its bits, 16 bytes, once for all rows of a task that share them, and no text:
that a hash comes again in another task cannot be seen from less.  The words that are left, at most one for two
rows and as a rule far fewer, are broadcast up to ``broadcast_words``; more of them are joined by word, the words
of large groups still broadcast and their rows left where they are.

Defined cases: a null text counts as empty; a null id orders after every other id; of rows with equal text and
equal id one stays; an empty table gives an empty result; other columns are carried or ignored, never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import join_groups, save, text_of

#: Bits of the filter for each row, and words that are broadcast at most.
BITS_PER_ROW, BROADCAST_WORDS = 16, 1 << 20
PROBES = 3


def normalised(text: Column) -> Column:
    """Each run of [\\x20\\x09-\\x0D] as one space; single spaces need no replacing."""
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]{2,}|[\\x09-\\x0D]", " ")


def fingerprint(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


def word_count(rows: int, bits_per_row: int = BITS_PER_ROW) -> int:
    """The next power of two of words that hold the bits of so many rows."""
    return 1 << max(0, -(-rows * bits_per_row // 64) - 1).bit_length()


def _word(sha: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(words))


def _bits(sha: Column) -> Column:
    bit = lambda seed: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(sha, F.lit(seed)), F.lit(64)).cast("int"))
    out = bit(1)
    for seed in range(2, PROBES + 1):
        out = out.bitwiseOR(bit(seed))
    return out


def seen_again(digests: DataFrame, words: int) -> DataFrame:
    """Pass 1: (word, mask, rows) of the bits that at least two rows set."""
    hit = digests.groupBy(_word(F.col("_sha"), words).alias("_word"), _bits(F.col("_sha")).alias("_bits")).agg(F.count("*").alias("_n"))
    return hit.where("_n > 1").groupBy("_word").agg(F.bit_or("_bits").alias("_mask"), F.sum("_n").alias("_rows"))


def probe(rows: DataFrame, again: DataFrame, words: int, total: int, few: bool) -> DataFrame:
    """Pass 2: adds _maybe, false only where no other row has the same text."""
    bits = _bits(F.col("_sha"))
    out = rows.withColumn("_w", _word(F.col("_sha"), words))
    if few:
        out = out.join(F.broadcast(again), F.col("_w") == F.col("_word"), "left")
    else:
        out = join_groups(out, again.withColumnRenamed("_word", "_w"), "_w", "_rows", total, -1 - F.pmod(F.xxhash64("_sha", "_key"), F.lit(1 << 62)))
    return out.withColumn("_maybe", F.coalesce(F.col("_mask").bitwiseAND(bits) == bits, F.lit(False))).drop("_w", "_word", "_mask", "_rows")


def _filter(digests: DataFrame, bits_per_row: int, broadcast_words: int) -> tuple[DataFrame, int, int, bool]:
    """What probe asks for: the filter, its words, the rows, and whether it is broadcast."""
    total = digests.count()
    words = word_count(total, bits_per_row)
    again = save(seen_again(digests, words), "seen-again")
    return again, words, total, again.count() <= broadcast_words


def _groups(maybe: DataFrame) -> DataFrame:
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_key").alias("key")))
    return maybe.groupBy("_sha").agg(first.alias("_first"), F.count("*").alias("_size"))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = BITS_PER_ROW, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    digests = save(docs.select(F.col(id_col).alias("_id"), fingerprint(text_of(text_col)).alias("_sha"), F.monotonically_increasing_id().alias("_key")), "digests")
    again, words, total, few = _filter(digests, bits_per_row, broadcast_words)
    tested = probe(digests, again, words, total, few)
    once = tested.where("not _maybe").select("_id", "_sha", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    maybe = tested.where("_maybe").drop("_maybe")
    joined = join_groups(maybe, _groups(maybe), "_sha", "_size", total, F.unhex(F.sha2(F.col("_key").cast("string"), 256)))
    more = joined.select("_id", "_sha", F.col("_first.id").alias("keep_id"), F.col("_size").alias("group_size"), (F.col("_first.key") == F.col("_key")).alias("kept"))
    return once.union(more).select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("_sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = BITS_PER_ROW, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """The rows that stay, with the columns of docs.  Rows that a broadcast filter clears never leave their task."""
    cols = [F.col(f"_row.{c}").alias(c) for c in docs.columns]
    digests = save(docs.select(F.col(id_col).alias("_id"), fingerprint(text_of(text_col)).alias("_sha"), F.lit(0).cast("long").alias("_key")), "digests")
    again, words, total, few = _filter(digests, bits_per_row, broadcast_words)
    first = _groups(probe(digests, again, words, total, few).where("_maybe")).select("_sha", F.col("_first.id").alias("_keep"), "_size")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), fingerprint(text_of(text_col)).alias("_sha"))
    rows = rows.withColumn("_key", F.xxhash64("_id"))
    tested = probe(rows, again, words, total, few).drop("_key")
    once = tested.where("not _maybe").select(*cols)
    joined = join_groups(tested.where("_maybe").drop("_maybe"), first, "_sha", "_size", total, F.unhex(F.sha2(F.coalesce(F.col("_id").cast("string"), F.lit("")), 256)))
    stay = joined.where(F.col("_id").eqNullSafe(F.col("_keep"))).dropDuplicates(["_sha"])
    return once.union(stay.select(*cols))


ORACLE = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS n FROM documents),
     g AS (SELECT n, min(doc_id) AS keep_id, count(*) AS group_size, sha256(n) AS text_sha256 FROM t GROUP BY n)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, g.text_sha256 FROM t JOIN g ON t.n = g.n
"""
