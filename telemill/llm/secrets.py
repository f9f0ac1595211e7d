"""Secret scan with corpus-wide ownership frequency.

Every text is scanned for three kinds of match, leftmost and not overlapping per kind:

* assign: a credential word, an assignment sign and a value of 12 characters or more;
* access: ``AKIA`` and capitals or digits, 18 characters or more together;
* hex: lower-case hexadecimal, 16 characters or more.

A fourth kind, reuse, is a bare token of 20 characters or more with letters and digits outside these matches,
reported only where its value stands assigned somewhere in the corpus.  The values' hashes are then counted
over distinct repositories and owners: a value that many owners carry is a copied example, a value of one owner
looks live.  Counts are aggregated by (value, owner, repository) first, so a value in a third of all rows is
summed up before it is shuffled.

Defined cases: a null text is empty and has no match; a null owner or repository is no owner at all; repeated
ids stay separate rows; positions are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import join_groups, save, text_of

KINDS = ("assign", "access", "hex", "reuse")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
ASSIGN = re.compile(
    "(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + ")"
    "[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Every access, hex or bare match lies within one such run, so texts are searched once.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
FOUND = "array<struct<start:int,rank:int,end:int,value:string>>"


def matches(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of the kind, end, value), ordered by start and kind; rank 3 are tokens that may be a reuse."""
    out = []
    low = text.lower()
    if any(word in low for word in WORDS):
        out += [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    for run in RUN.finditer(text):
        start, end = run.span()
        inner = [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text, start, end) if m.end() - m.start() >= 18]
        inner += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text, start, end)]
        if not inner and end - start >= 20 and DIGIT.search(text, start, end) and LETTER.search(text, start, end):
            inner = [(start, 3, end, run.group())]
        out += inner
    assigned = [(s, e) for s, rank, e, _ in out if rank == 0]
    return sorted(x for x in out if x[1] < 3 or not any(s < x[2] and x[0] < e for s, e in assigned))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["_text"]:
            found = matches(text)
            base = [x for x in found if x[1] < 3]
            told = ",".join(f"{KINDS[r]}:{s}:{e}" for s, r, e, _ in base)
            rows.append((
                *(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(told.encode()).hexdigest(), told,
                [(s, r, e, hashlib.sha256(v.encode()).hexdigest()) for s, r, e, v in found],
            ))
        out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "base", "_found"], index=batch.index)
        yield pd.concat([batch.drop(columns="_text"), out], axis=1)


def scan(docs: DataFrame, repository: Column, owner: Column, id_col: str = "doc_id", text_col: str = "text", examples_from: int = 3) -> DataFrame:
    """One row per document: id, counts of the base kinds, base_sha256, spans, and the values by verdict.

    n_live: values that one owner alone has; n_example: values of ``examples_from`` owners or more; n_shared: between.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), repository.cast("string").alias("_repo"), owner.cast("string").alias("_owner"), F.monotonically_increasing_id().alias("_key"))
    kept = rows.drop("_text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    scanned = save(rows.select("_text", *kept.columns).mapInPandas(_scan, f"{schema}, n_assign long, n_access long, n_hex long, base_sha256 string, base string, _found {FOUND}"), "secrets")
    total = scanned.agg(F.sum(F.size("_found"))).first()[0] or 0

    found = scanned.where(F.size("_found") > 0).withColumn("_x", F.explode("_found"))
    found = found.select(*[c for c in scanned.columns if c != "_found"], "_x.start", "_x.rank", "_x.end", "_x.value")
    by_place = found.groupBy("value", "_owner", "_repo").agg(F.count("*").alias("n"), F.max(F.col("rank") < 3).alias("assigned"))
    owned = by_place.groupBy("value").agg(F.sum("n").alias("_n"), F.max("assigned").alias("_assigned"), F.count_distinct("_owner").alias("_owners"), F.count_distinct("_repo").alias("_repos"))
    judged = join_groups(found, owned, "value", "_n", total, F.concat(F.lit("row "), F.col("_key").cast("string"), F.lit(" "), F.col("start").cast("string")))
    judged = judged.where("rank < 3 or _assigned")
    count = lambda which: F.count_distinct(F.when(which, F.col("value"))).alias
    example, live = F.col("_owners") >= examples_from, F.col("_owners") <= 1
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["rank"] + 1)
    spans = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "rank", "end"))), lambda x: F.concat_ws(":", kind(x), x["start"], x["end"])), ",")
    same = ["_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    hit = judged.groupBy("_key", *same).agg(spans.alias("spans"), count(live)("n_live"), count(example)("n_example"), count(~example & ~live)("n_shared"), F.max("_repos").alias("most_repositories"))
    hit = hit.select(*same, "spans", "n_live", "n_example", "n_shared", "most_repositories")
    # documents of which nothing is left but tokens that are assigned nowhere have no row in hit
    zero = F.lit(0).cast("long")
    clean = scanned.where("n_assign + n_access + n_hex = 0")
    bare = found.where("n_assign + n_access + n_hex = 0").select("_key").join(judged.select(F.col("_key").alias("_k")), F.col("_key") == F.col("_k"), "left_semi").distinct()
    clean = clean.join(bare.select(F.col("_key").alias("_k")), F.col("_key") == F.col("_k"), "left_anti")
    clean = clean.select(*same, F.lit("").alias("spans"), *[zero.alias(c) for c in ("n_live", "n_example", "n_shared", "most_repositories")])
    return hit.union(clean).withColumnRenamed("_id", id_col)
