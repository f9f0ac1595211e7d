"""Alignment of the tokens of two tokenizers, with corpus-wide counts of aligned pairs by external spill counting.

A, a byte-level BPE, reads a space and the text; B, a SentencePiece BPE with byte fallback, adds that space itself.
Byte offsets where a token of both ends cut the tokens into groups; a link is a pair of occurrences that end together.

* Spill: each task encodes its texts and gathers (pair, document) records.  When a buffer is full it is sorted,
  radix-partitioned by the low bits of the B id, and written to the shared folder: a spill has for every part a zstd
  run of (pair, count) and one of the documents behind each pair, both in B-major order.  A pair of a third of all
  links is one entry of a run of counts.
* Merge: the runs of counts of a part are merged by a heap, at most about FAN_IN at a time, in as many rounds as it
  takes.  In the last one all pairs of a B id come in a row, so its highest count is known when they have passed.
* Stream back: every spill is read once more, by itself, and adds each pair's count to its own documents.  No record
  is shuffled for that.

What all tasks get of the counts is bounded by the two vocabularies, whatever the corpus: of two tokens that end
together the shorter's bytes end the longer's, see ``most_pairs`` (under a million for the files here).

Texts are cut where a space, tab or line end follows another character; no token of A or B spans such a place
(``vocabularies`` refuses a B model with one), so each unit is encoded once and kept.  Texts with other white space are
encoded whole.

Defined cases: a text that is null, empty, or whose joined tokens are not its bytes again has no tokens: zeros and
groups ''; special tokens' strings are plain text; repeated and null ids stay separate rows; an empty table gives an
empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import save, text_of
from telemill.llm.shingles import chunks

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Parts by the low bits of the B id, characters of text of a spill, runs that a heap merges at a time.
PARTS, SPILL, FAN_IN = 16, 1 << 21, 64
#: Units that a worker keeps, and characters of their groups.
KEPT_UNITS, KEPT_CHARS = 200_000, 1 << 25
_A_BITS, _DOC_BITS = 17, 26
#: A unit is space with what follows it; texts with other white space are one unit.
_UNIT = re.compile("[ \\n\\t]*[^ \\n\\t]+|[ \\n\\t]+")
_OTHER_SPACE = re.compile("[^\\S \\n\\t]")


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def vocabularies(a_file: str = A_FILE, b_file: str = B_FILE):
    """Both tokenizers and the bytes of their tokens by id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(a_file)
    a.encode_special_tokens = True
    table = byte_of()
    a_bytes = [b""] * a.get_vocab_size()
    for token, k in a.get_vocab().items():
        a_bytes[k] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
    b = sentencepiece.SentencePieceProcessor(model_file=b_file)
    pieces = [b.id_to_piece(k) for k in range(b.get_piece_size())]
    if any("▁" in p.lstrip("▁") or set(p) & set("\n\t") for k, p in enumerate(pieces) if not b.is_control(k) and not b.is_byte(k)):
        raise ValueError("a piece of B spans the end of a word or line")
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
    return a, a_bytes, b, b_bytes


def most_pairs(a_bytes: list[bytes], b_bytes: list[bytes]) -> int:
    """How many pairs of tokens can end together at all: those of which one's bytes end the other's."""
    a, b = set(a_bytes) - {b""}, set(b_bytes) - {b""}
    ends = lambda longer, shorter: sum(x[k:] in shorter for x in longer for k in range(len(x)))
    return ends(a, b) + ends(b, a)


class Units:
    """Encoded units of texts with their alignment, kept between texts."""

    def __init__(self, a_file: str, b_file: str):
        self.a, self.a_bytes, self.b, self.b_bytes = vocabularies(a_file, b_file)
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")
        ids = np.arange(max(len(self.a_bytes), len(self.b_bytes))).astype(str).astype(object)
        #: A and B ids with what follows them: within a group, at the end of its part of A, of it, and of the unit
        self.shown = np.concatenate([ids + ",", ids + "|", ids + ";", ids])
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.told: list[str] = []
        self.chars = 0
        self.numbers = np.zeros((1024, 5), np.int64)  # tokens of A, of B, groups, 1 if bytes differ, end of the pairs
        self.pairs = np.zeros(4096, np.int64)

    def _encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Tokens of A and B of units that start a text or with white space; B's own space stands before each."""
        a = [e.ids for e in self.a.encode_batch(units, add_special_tokens=False)]
        b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for k, unit in enumerate(units):
            if unit[0] != " ":
                if b[k][:1] != [self.space]:
                    raise ValueError("B joins its space to what follows a line")
                b[k] = b[k][1:]
            elif unit == " ":
                b[k] = [self.space]
        return a, b

    def _together(self, units: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(tokens of A and B by unit, all A ids, all B ids), encoded as one text; None where bytes differ."""
        (a,), (b,) = self._encode(["".join(units)])
        want = b"".join(raw)
        if b"".join([self.a_bytes[t] for t in a]) != want or b"".join([self.b_bytes[t] for t in b]) != want:
            return None
        a_ids, b_ids, ends = np.array(a, np.int64), np.array(b, np.int64), np.cumsum(list(map(len, raw)))
        cut = [np.diff(np.searchsorted(np.cumsum(sizes[ids]), ends, side="right"), prepend=0) for sizes, ids in ((self.a_sizes, a_ids), (self.b_sizes, b_ids))]
        return np.stack(cut, axis=1), a_ids, b_ids

    def _apart(self, units: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As _together, unit by unit; those whose bytes differ have no tokens."""
        a, b = self._encode(units)
        same = [b"".join([self.a_bytes[t] for t in x]) == r == b"".join([self.b_bytes[t] for t in y]) for r, x, y in zip(raw, a, b, strict=True)]
        a, b = ([x if ok else [] for x, ok in zip(of, same, strict=True)] for of in (a, b))
        numbers = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
        return numbers, np.array([t for x in a for t in x], np.int64), np.array([t for y in b for t in y], np.int64)

    def add(self, units: list[str]) -> None:
        """Encode new units, those that end with white space by themselves: it would join the next one's."""
        open_, closed = [u for u in units if u[-1].isspace()], [u for u in units if not u[-1].isspace()]
        for part, together in ((closed, True), (open_, False)):
            if part:
                raw = [u.encode("utf-8", "surrogatepass") for u in part]
                self._keep(part, *(together and self._together(part, raw) or self._apart(part, raw)))

    def _keep(self, units: list[str], numbers: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray) -> None:
        differs = numbers[:, 0] == 0
        a_ends, b_ends = np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids])
        last_a, last_b = np.isin(a_ends, b_ends, assume_unique=True), np.isin(b_ends, a_ends, assume_unique=True)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        # place of each token where groups stand in a row, A before B
        of_a, of_b = np.bincount(group_a), np.bincount(group_b)
        at_a = np.arange(len(a_ids)) + (np.cumsum(of_b) - of_b)[group_a]
        at_b = np.arange(len(b_ids)) + np.cumsum(of_a)[group_b]
        unit_of_b = np.repeat(np.arange(len(units)), numbers[:, 1])
        closes = last_b & np.append(unit_of_b[1:] != unit_of_b[:-1], [True] * min(1, len(b_ids)))
        step = len(self.shown) // 4
        shown = np.empty(len(a_ids) + len(b_ids), object)
        shown[at_a] = self.shown[a_ids + step * last_a]
        shown[at_b] = self.shown[b_ids + step * (2 * last_b + closes)]
        groups = np.bincount(unit_of_b[last_b], minlength=len(units))
        pieces, edges = shown.tolist(), np.cumsum(numbers.sum(axis=1)).tolist()
        at, start = len(self.told), 0
        for k, (unit, end) in enumerate(zip(units, edges, strict=True), at):
            told = "".join(pieces[start:end])
            self.told.append(told)
            self.ids[unit] = k
            self.chars += len(told) + len(unit)
            start = end
        flat = b_ids[last_b] << _A_BITS | a_ids[last_a]
        before = int(self.numbers[at - 1, 4]) if at else 0
        while at + len(units) > len(self.numbers):
            self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)])
        while before + len(flat) > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
        self.pairs[before : before + len(flat)] = flat
        self.numbers[at : at + len(units)] = np.column_stack([numbers, groups, differs, before + np.cumsum(groups)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Of each text its numbers (tokens of A, of B, links) and groups; all links as pairs, and the text of each."""
        cut = [[] if not text else [f" {text}"] if _OTHER_SPACE.search(text) else _UNIT.findall(f" {text}") for text in texts]
        new = list({u: None for units in cut for u in units if u not in self.ids})
        if new:
            self.add(new)
        sizes = np.array([len(units) for units in cut], np.int64)
        known = [self.ids[u] for units in cut for u in units]
        flat, ends = np.array(known, np.int64), np.cumsum(sizes).tolist()
        doc = np.repeat(np.arange(len(texts)), sizes)
        numbers = np.zeros((len(texts), 4), np.int64)
        np.add.at(numbers, doc, self.numbers[flat, :4])
        whole = numbers[:, 3] == 0
        numbers[~whole] = 0
        told = [";".join([self.told[u] for u in known[end - len(units) : end]]) if ok else "" for units, end, ok in zip(cut, ends, whole.tolist(), strict=True)]
        stays = whole[doc]
        flat, doc = flat[stays], doc[stays]
        count = self.numbers[flat, 2]
        start = self.numbers[flat, 4] - count
        at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        links, owner = self.pairs[at], np.repeat(doc, count)
        if len(self.told) > KEPT_UNITS or self.chars > KEPT_CHARS:
            self.clear()
        return numbers[:, :3], told, links, owner


# ---- runs: columns of whole numbers, byte by byte, under zstd


def _pack(*columns: np.ndarray) -> bytes:
    size = np.array([len(columns[0]), len(columns)], np.int64).tobytes()
    planes = [np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=3).compress(size + b"".join(planes))


def _unpack(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, columns = np.frombuffer(raw, np.int64, 2)
    planes = np.frombuffer(raw, np.uint8, offset=16).reshape(columns, 8, n)
    return [np.ascontiguousarray(p.T).view("<u8").reshape(-1).astype(np.int64) for p in planes]


def _runs(links: np.ndarray, owner: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """By part the run of (pair, count) and that of the documents behind the pairs, in B-major order."""
    part = (links >> _A_BITS) & (PARTS - 1)
    counts, records = [], []
    for p in range(PARTS):
        mine = part == p
        both = np.sort(links[mine] << _DOC_BITS | owner[mine])
        first = np.flatnonzero(np.diff(both, prepend=-1))
        times = np.diff(first, append=len(both))
        pair, doc = both[first] >> _DOC_BITS, both[first] & ((1 << _DOC_BITS) - 1)
        head = np.flatnonzero(np.diff(pair, prepend=-1))
        docs = np.diff(head, append=len(pair))
        total = np.add.reduceat(times, head) if len(head) else times
        step = np.diff(doc, prepend=0)
        step[head] = doc[head]
        counts.append(_pack(np.diff(pair[head], prepend=0), total))
        heads = _pack(docs)
        records.append(len(heads).to_bytes(8, "little") + heads + _pack(step, times))
    return counts, records


def _records(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents behind each pair; the document and the times of each record."""
    cut = 8 + int.from_bytes(block[:8], "little")
    (docs,), (step, times) = _unpack(block[8:cut]), _unpack(block[cut:])
    total = np.cumsum(step)
    head = np.cumsum(docs) - docs
    before = (total[head] - step[head]) if len(head) else total
    return docs, total - np.repeat(before, docs), times


def _spiller(a_file: str, b_file: str, spill: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = Units(a_file, b_file)
        ids: list = []
        numbers, told, links, owner = [], [], [], []

        def flush() -> pd.DataFrame:
            counts, records = _runs(np.concatenate(links), np.concatenate(owner))
            n = np.concatenate(numbers)
            groups = zstandard.ZstdCompressor(level=3).compress("\n".join(told).encode())
            out = pd.DataFrame({"ids": [list(ids)], "n_a": [n[:, 0]], "n_b": [n[:, 1]], "n_links": [n[:, 2]], "groups": [groups], "counts": [counts], "records": [records]})
            for x in (ids, numbers, told, links, owner):
                x.clear()
            return out

        size = 0
        for batch in batches:
            at = 0
            for part in chunks(batch["_text"].tolist(), 1 << 18):
                n, groups, pairs, docs = units.encode(part)
                numbers.append(n)
                told += groups
                links.append(pairs)
                owner.append(docs + len(ids))
                ids += batch["_id"].iloc[at : at + len(part)].tolist()
                at += len(part)
                size += sum(map(len, part))
                if size >= spill or len(ids) >= 1 << (_DOC_BITS - 8):
                    yield flush()
                    size = 0
        if ids:
            yield flush()

    return work, "ids array<string>, n_a array<long>, n_b array<long>, n_links array<long>, groups binary, counts array<binary>, records array<binary>"


def spills(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE, spill: int = SPILL) -> DataFrame:
    """A row per spill, written to the shared folder: its documents, and its runs by part.  Ids travel as text."""
    rows = docs.select(F.col(id_col).cast("string").alias("_id"), text_of(text_col).alias("_text"))
    work, schema = _spiller(a_file, b_file, spill)
    return save(rows.mapInPandas(work, schema), "spills")


# ---- merging


def _stream(block: bytes) -> Iterator[tuple[int, int]]:
    steps, counts = _unpack(block)
    return zip(np.cumsum(steps).tolist(), counts.tolist(), strict=True)


def merged(blocks: list[bytes]) -> Iterator[tuple[int, int]]:
    """(pair, count) of all runs in B-major order, by a heap over their heads."""
    for pair, same in groupby(heapq.merge(*map(_stream, blocks)), key=itemgetter(0)):
        yield pair, sum(n for _, n in same)


def with_best(pairs: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int, bool]]:
    """(pair, count, whether no pair of its B id counts more): a B id's pairs come in a row."""
    for _, of_b in groupby(pairs, key=lambda x: x[0] >> _A_BITS):
        held = list(of_b)
        most = max(n for _, n in held)
        for pair, n in held:
            yield pair, n, n == most


def _merge(final: bool):
    def work(group: pd.DataFrame) -> pd.DataFrame:
        found = merged(group["block"].tolist())
        rows = np.array(list(with_best(found) if final else found), np.int64).reshape(-1, 3 if final else 2)
        pair = np.diff(rows[:, 0], prepend=0)
        return pd.DataFrame({"part": group["part"].iloc[:1].array, "block": [_pack(pair, *rows.T[1:])]})

    return work


def merge(spilled: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """A row per part: its block of pairs, counts and flags of the highest of a B id."""
    runs = spilled.select(F.monotonically_increasing_id().alias("_run"), F.posexplode("counts").alias("part", "block"))
    left = spilled.count()
    while left > fan_in:
        left = -(-left // fan_in)
        at = F.pmod(F.xxhash64("_run"), F.lit(left))
        runs = save(runs.groupBy("part", at.alias("_g")).applyInPandas(_merge(False), "part int, block binary"), "merged")
        runs = runs.withColumn("_run", F.monotonically_increasing_id())
    return save(runs.drop("_run").groupBy("part").applyInPandas(_merge(True), "part int, block binary"), "merged")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(b, a, n, is_best) of every pair that is linked anywhere."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch["block"]:
                step, n, best = _unpack(block)
                pair = np.cumsum(step)
                yield pd.DataFrame({"b": pair >> _A_BITS, "a": pair & ((1 << _A_BITS) - 1), "n": n, "is_best": best == 1})

    return blocks.select("block").mapInPandas(work, "b long, a long, n long, is_best boolean")


# ---- streaming back


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE, spill: int = SPILL, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, and groups, `a1,a2|b1;a3|b2,b3` by ids."""
    spark = docs.sparkSession
    spilled = spills(docs, id_col, text_col, a_file, b_file, spill)
    counts = spark.sparkContext.broadcast([bytes(r.block) for r in merge(spilled, fan_in).orderBy("part").collect()])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {}
        for block in counts.value:
            step, n, best = _unpack(block)
            pair = np.cumsum(step)
            if len(pair):
                known[int(pair[0] >> _A_BITS) & (PARTS - 1)] = pair, n, best
        for batch in batches:
            for row in batch.itertuples(index=False):
                best_links, count_sum = np.zeros(len(row.n_a), np.int64), np.zeros(len(row.n_a), np.int64)
                for part, (run, block) in enumerate(zip(row.counts, row.records, strict=True)):
                    pair = np.cumsum(_unpack(run)[0])
                    if not len(pair):
                        continue
                    at = np.searchsorted(known[part][0], pair)
                    documents, doc, times = _records(block)
                    np.add.at(count_sum, doc, times * np.repeat(known[part][1][at], documents))
                    np.add.at(best_links, doc, times * np.repeat(known[part][2][at], documents))
                told = zstandard.ZstdDecompressor().decompress(row.groups).decode().split("\n")
                yield pd.DataFrame({"_id": list(row.ids), "n_a": row.n_a, "n_b": row.n_b, "n_groups": row.n_links, "n_links": row.n_links, "n_best": best_links, "count_sum": count_sum, "groups": told})

    numbers = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long"
    out = spilled.mapInPandas(work, f"_id string, {numbers}, groups string")
    return out.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), *[c for c in out.columns if c != "_id"])


def digest(aligned: DataFrame) -> DataFrame:
    """groups as a hash; '' where there are no tokens."""
    return aligned.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
