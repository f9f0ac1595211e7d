"""Periodic runs of words, by a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that holds at least two
periods and ``shortest`` words and that no neighbouring word extends keeping the period.

The words of a text are named by equality, then all factors of 2, 4, 8, ... words by the pair of names of their
halves.  Only factors that occur again in the same text are kept, so a level is as large as what repeats and the last
is empty.  At the level of 2^k words, 2^k <= q < 2^(k+1), a factor of the run comes again q words later:

* occurrences at most 2^(k-1) apart form an arithmetic progression, as the factor then has that difference as period;
* where the root of the run is itself such a progression, its first factor and the first member of the next
  progression are q apart; else some factor of the root has occurrences more than 2^(k-1) apart only, and q is a
  distance to one of its next three.

Distances from an occurrence to the first members of the next three progressions therefore propose every period.  One
proposal of each stretch of neighbouring ones is extended to both sides over the levels from the largest down, and of
equal stretches that of the smallest period stays.

Many short texts are worked at once in numpy; a task holds one chunk of texts, or one long text, at a time.

Defined cases: a null or empty text has no words, no runs and the empty text left; words are what stands between runs
of [\\x20\\x09-\\x0D], so other space is part of a word; repeated ids stay separate rows; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import text_of
from telemill.llm.shingles import chunks

SHORTEST = 12
#: Progressions after an occurrence whose first members propose a period.
NEXT = 3
RUNS = "array<struct<start:long,length:long,period:long>>"


class Factors:
    """Names of the factors of 2^k words that occur again in their text, for each k, over several texts in a row."""

    def __init__(self, names: np.ndarray, ends: np.ndarray):
        """names: by word, different between texts; ends: by word the end of its text."""
        self.names, self.ends, self.levels = names, ends, []
        counts = np.bincount(names)
        at = np.flatnonzero(counts[names] > 1)
        name, width = names[at], 1
        while len(at):
            self.levels.append((at, name))
            other = np.searchsorted(at, at + width)
            found = other < len(at)
            found[found] = at[other[found]] == at[found] + width
            found &= at + 2 * width <= ends[at]
            pair = name[found] * (np.int64(len(names)) + 1) + name[other[found]]
            _, back, counts = np.unique(pair, return_inverse=True, return_counts=True)
            again = counts[back] > 1
            at, name, width = at[found][again], back[again], 2 * width

    def _name(self, level: int, at: np.ndarray) -> np.ndarray:
        """Names at places of a level, -1 where the factor does not occur again."""
        places, name = self.levels[level]
        k = np.minimum(np.searchsorted(places, at), len(places) - 1)
        return np.where(places[k] == at, name[k], -1)

    def proposals(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, period) such that the factor at the place comes again a period later, 2^level <= period < 2^(level+1)."""
        places, name = self.levels[level]
        width = 1 << level
        order = np.argsort(name, kind="stable")
        p, g = places[order], name[order]
        new = np.ones(len(p), bool)
        new[1:] = (g[1:] != g[:-1]) | (2 * (p[1:] - p[:-1]) > width)
        member = np.cumsum(new) - 1
        first, group = p[new], g[new]
        out_p, out_q = [], []
        for t in range(1, NEXT + 1):
            k = np.minimum(member + t, len(first) - 1)
            q = first[k] - p
            ok = (member + t < len(first)) & (group[k] == g) & (q >= width) & (q < 2 * width)
            out_p.append(p[ok])
            out_q.append(q[ok])
        p, q = np.concatenate(out_p), np.concatenate(out_q)
        order = np.lexsort((p, q))
        p, q = p[order], q[order]
        alone = np.ones(len(p), bool)
        alone[1:] = (q[1:] != q[:-1]) | (p[1:] > p[:-1] + 1)
        return p[alone], q[alone]

    def extend(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the longest stretch of period q around the words p and p + q."""
        right, left = p.copy(), p.copy()
        for level in range(len(self.levels) - 1, -1, -1):
            a = self._name(level, right)
            right += np.where((a >= 0) & (a == self._name(level, right + q)), 1 << level, 0)
            a = self._name(level, left - (1 << level))
            left -= np.where((a >= 0) & (a == self._name(level, left + q - (1 << level))), 1 << level, 0)
        return left, right + q

    def runs(self, shortest: int = SHORTEST) -> np.ndarray:
        """Rows of start, end and period, in that order."""
        found = [np.zeros((0, 3), np.int64)]
        for level in range(len(self.levels)):
            p, q = self.proposals(level)
            start, end = self.extend(p, q)
            long = end - start >= np.maximum(shortest, 2 * q)
            found.append(np.stack([start[long], end[long], q[long]], axis=1))
        out = np.concatenate(found)
        out = out[np.lexsort((out[:, 2], out[:, 1], out[:, 0]))]
        new = np.ones(len(out), bool)
        new[1:] = (out[1:, :2] != out[:-1, :2]).any(axis=1)
        out = out[new]
        return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs_of(texts: list[str], shortest: int = SHORTEST) -> list[tuple[list[dict], str]]:
    """Of each text its runs, by start and period, and the words that are left, joined by a space.

    A word is dropped where a run holds it after the run's first period.
    """
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    sizes = np.array([len(s) for s in split], np.int64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    codes: list[int] = []
    base = 0
    for words in split:  # names differ between texts
        own: dict[bytes, int] = {}
        codes += [own.setdefault(w, base + len(own)) for w in words]
        base += len(own)
    ends = np.repeat(edges[1:], sizes)
    found = Factors(np.array(codes, np.int64), ends).runs(shortest) if codes else np.zeros((0, 3), np.int64)
    drop = np.zeros(edges[-1] + 1, np.int64)
    np.add.at(drop, found[:, 0] + found[:, 2], 1)
    np.add.at(drop, found[:, 1], -1)
    keep = np.cumsum(drop)[:-1] == 0
    cut = np.searchsorted(found[:, 0], edges)
    out = []
    for k, words in enumerate(split):
        at = edges[k]
        rows = found[cut[k] : cut[k + 1]]
        if len(rows):
            words = [w for w, stays in zip(words, keep[at : edges[k + 1]].tolist(), strict=True) if stays]
        told = [{"start": s - at, "length": e - s, "period": q} for s, e, q in rows.tolist()]
        out.append((told, b" ".join(words).decode("utf-8", "surrogatepass")))
    return out


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """One row per document: id, runs (start and length in words, period), and collapsed, the text without the
    words that repeat a period."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = 0
            for part in chunks(batch["_text"].tolist()):
                found = runs_of(part, shortest)
                out = pd.DataFrame({"_id": batch["_id"].iloc[at : at + len(part)].array, "runs": [r for r, _ in found], "collapsed": [c for _, c in found]})
                at += len(part)
                yield out

    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInPandas(work, f"_id {kind}, runs {RUNS}, collapsed string").withColumnRenamed("_id", id_col)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): texts whose crc32 of the id is a multiple of ten get a period from some word on.

    With g the tenth of that hash, n words, a = g mod n and p = 1 + (n - a) div (3 + g mod 8), each word i >= a becomes
    the word a + (i - a) mod p.  A null id has no hash and leaves its text as it is.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    n = F.size("_w")
    x = docs.select(F.col(id_col), text_of(text_col).alias("_text"), (F.coalesce(h % 10, F.lit(1)) == 0).alias("_plant"), g.alias("_g"))
    x = x.withColumn("_w", F.when(F.col("_plant"), words_of(F.col("_text"))))
    a = F.pmod(F.col("_g"), n).cast("int")
    x = x.withColumn("_a", F.when(n > 0, a))
    p = (F.lit(1) + F.floor((n - F.col("_a")) / (F.lit(3) + F.pmod(F.col("_g"), F.lit(8))))).cast("int")
    x = x.withColumn("_p", p)
    again: Column = F.transform("_w", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_w", F.col("_a") + F.pmod(i - F.col("_a"), F.col("_p")))))
    return x.select(id_col, F.when(F.col("_plant") & (n > 0), F.array_join(again, " ")).otherwise(F.col("_text")).alias(text_col))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The longest run (ties: smallest start, then period) and hashes of all runs and of what is left."""
    key = lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))
    top = F.array_min(F.transform("runs", key))
    length, start, period = -top["shorter"], top["start"], top["period"]
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    told = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(F.lit(1000) * length / period).cast("long").alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
