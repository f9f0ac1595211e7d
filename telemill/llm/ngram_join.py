"""Near duplicates: Jaccard similarity of word shingle sets of THRESHOLD or more, by MinHash banding.

1. Documents of the same shingle set form a copy class, represented by its smallest id; only representatives
   go on, so copies never multiply pairs.
2. Each representative has HASHES minima in bands; the rows per band are as many as the target recall at the
   threshold allows.  Band hashes are shuffled; each member of a bucket gets an edge to the bucket's smallest
   member, and the components of these edges hold every pair that shares a band.
3. All pairs are verified on full shingle sets, within a component or, where that takes fewer copies of sets, within
   each of its buckets: a component that chains many unlike texts is larger than any bucket, one of near copies has
   the same members in many buckets.  A pair that shares several buckets counts in that of its first common band, so
   both ways find the same.  Members are dealt into blocks of bounded size and pairs of blocks go to tasks, each of
   which returns the number of links and one edge per member: no pair is ever a row.
4. The components of the verified edges are the classes.

Defined cases: a text without words (null, empty) is a class of its own without links; repeated rows are copies;
null ids are larger than others; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.common import join_groups, save, text_of
from telemill.llm.components import components
from telemill.llm.shingles import chunks, mix, shingle_sets

THRESHOLD, RECALL, HASHES = 0.8, 0.997, 256
#: Members of a block; candidates that are broadcast at most; bytes of sets that are verified together.
BLOCK, MAX_BROADCAST, PART_BYTES = 256, 200_000, 1 << 19
_rng = np.random.default_rng(7)
_A = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band whose recall at the threshold reaches the target."""
    fits = [(hashes // r, r) for r in range(1, hashes + 1) if 1 - (1 - threshold**r) ** (hashes // r) >= recall]
    return fits[-1]


BANDS, ROWS = choose_bands()
_C = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_SEED = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def band_hashes(shingles: np.ndarray) -> np.ndarray:
    """One hash per band, different between bands."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(least, (low[at : at + 512, None] * _A + _B).min(0), out=least)
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    return mix((rows * _C).sum(1, dtype=np.uint64) + _SEED).view(np.int64)


def set_hash(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set."""
    both = mix(shingles).sum(dtype=np.uint64), mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(both[0].view(np.int64)), int(both[1].view(np.int64))


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in _parts(batch):
            sets = shingle_sets(part["_text"].tolist())
            hashes = [set_hash(s) if len(s) else (0, 0) for s in sets]
            out = part.drop(columns="_text").assign(_h1=[h[0] for h in hashes], _h2=[h[1] for h in hashes], _n=[len(s) for s in sets])
            yield out.assign(_bands=[band_hashes(s) if len(s) else None for s in sets])


def _parts(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    at = 0
    for texts in chunks(batch["_text"].tolist()):
        yield batch.iloc[at : at + len(texts)]
        at += len(texts)


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shingle sets of the candidates; a row of another text under the same id is dropped."""
    for batch in batches:
        for part in _parts(batch):
            sets = shingle_sets(part["_text"].tolist())
            same = [len(s) > 0 and set_hash(s) == (a, b) for s, a, b in zip(sets, part["_h1"], part["_h2"], strict=True)]
            out = part[["_rep", "_split", "_groups", "_blocks", "_bands"]].assign(_set=[s.view(np.int64) for s in sets])
            yield out[same]


def shared(sets: list[np.ndarray], cut: int) -> np.ndarray:
    """Sizes of intersections of the first ``cut`` sets with the rest (all with all where cut is 0)."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    code, owner = (np.cumsum(often) - 1)[code[often[code]]], owner[often[code]]
    left, right = (slice(0, cut), slice(cut, None)) if cut else (slice(None), slice(None))
    out = 0
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    width = 4096
    for at in range(0, int(often.sum()) or 1, width):
        a, b = np.searchsorted(code, [at, at + width])
        has = np.zeros((len(sets), width), np.float32)
        has[owner[a:b], code[a:b] - at] = 1
        out = out + has[left] @ has[right].T
    return out


def _linked(rep: np.ndarray, sets: list[np.ndarray], cut: int, bands: list | None, band: int) -> tuple[np.ndarray, ...]:
    """(member, links, to): of the first ``cut`` members with the rest (of all with all where cut is 0) how many links
    each has, and the smallest member linked directly or through others; with ``bands`` only links whose first common band is ``band``."""
    size = np.array([len(s) for s in sets])
    both = shared(sets, cut)
    if cut:
        linked = np.zeros((len(rep), len(rep)), bool)
        linked[:cut, cut:] = both >= THRESHOLD * (size[:cut, None] + size[cut:] - both) - 1e-6
        linked |= linked.T
    else:
        linked = both >= THRESHOLD * (size[:, None] + size - both) - 1e-6
        np.fill_diagonal(linked, False)
    if bands is not None:
        a, b = np.nonzero(linked)
        bands = np.stack(bands).astype(np.int64)
        for at in range(0, len(a), 1 << 15):
            x, y = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
            first = (bands[x] == bands[y]).argmax(1)
            linked[x, y] = bands[x, first] == band
    label, before = rep.copy(), None
    while before is None or (label != before).any():
        before = label
        label = np.minimum(label, np.where(linked, label, np.iinfo(np.int64).max).min(1))
    hit = linked.any(1)
    return rep[hit], linked.sum(1)[hit], label[hit]


def _verify(part: pd.DataFrame) -> pd.DataFrame:
    """Links of some pairs of blocks, one pair after the other."""
    part = part.sort_values(["_split", "_g", "_i", "_j", "_block", "_rep"])
    rep, block, split, g, i, j = (part[c].to_numpy() for c in ("_rep", "_block", "_split", "_g", "_i", "_j"))
    sets, bands = [np.asarray(s, np.int64) for s in part["_set"]], part["_bands"].tolist()
    new = np.ones(len(part), bool)
    new[1:] = (split[1:] != split[:-1]) | (g[1:] != g[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    starts = np.flatnonzero(new)
    found = [(rep[:0], rep[:0], rep[:0])]
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True):
        cut = 0 if i[a] == j[a] else int((block[a:b] == i[a]).sum())
        if b - a > 1 and (i[a] == j[a] or 0 < cut < b - a):
            found.append(_linked(rep[a:b], sets[a:b], cut, bands[a:b] if split[a] else None, g[a]))
    return pd.DataFrame({c: np.concatenate([f[k] for f in found]) for k, c in enumerate(("_rep", "_links", "_to"))})


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, rep_id (smallest id of the same shingle set), class_id (smallest id of the
    component), n_links (other shingle sets within the threshold) and n_copies (documents of the same set)."""
    return _classify(docs, id_col, text_col).drop("_th")


def _classify(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """As classify, with a hash of the text."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    signed = rows.select("*", F.monotonically_increasing_id().alias("_key"), F.xxhash64("_text").alias("_th"))
    signed = save(signed.mapInPandas(_sign, f"_id {kind}, _key long, _th long, _h1 long, _h2 long, _n int, _bands array<long>"), "signatures")
    total = signed.count()
    worded = signed.where("_n > 0").withColumn("_set_id", F.struct("_h1", "_h2"))
    reps = worded.groupBy("_set_id").agg(F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_key", "_th")).alias("_first"), F.count("*").alias("_copies"), F.min("_bands").alias("_bands"), F.min("_n").alias("_size"))
    reps = save(reps.select("_set_id", "_size", F.col("_first._id").alias("_rid"), F.col("_first._key").alias("_rep"), F.col("_first._th").alias("_th"), "_copies", "_bands"), "reps")

    # candidates: components of the edges from each member of a bucket to its smallest member
    banded = reps.select("_rep", F.explode("_bands").alias("_band"))
    buckets = banded.groupBy("_band").agg(F.min("_rep").alias("_least"), F.count("*").alias("_m")).where("_m > 1")
    within = join_groups(banded, buckets, "_band", "_m", reps.count() * BANDS, F.xxhash64("_rep", F.lit(2))).where("_m is not null")
    within = save(within, "buckets")
    near = components(within.where("_rep != _least").select("_rep", "_least"), "_rep", "_least")

    # verification on full sets, by pairs of blocks of a component or of its buckets, whichever copies less
    blocks = lambda m: F.ceil(F.col(m) / BLOCK).cast("int")
    mine = within.groupBy("_rep").agg(F.collect_list(F.struct(F.col("_band").alias("g"), blocks("_m").alias("n"))).alias("_in"), F.sum(blocks("_m")).alias("_copies_in"))
    near = save(near.join(mine, F.col("node") == F.col("_rep")), "members")
    members = near.groupBy("root").agg(F.count("*").alias("_m"), F.sum("_copies_in").alias("_by_bucket"))
    near = join_groups(near, members, "root", "_m", max(1, near.count()), F.xxhash64("node", F.lit(3)))
    near = near.withColumn("_split", F.col("_by_bucket") < F.col("_m") * blocks("_m"))
    near = near.withColumn("_in", F.when(F.col("_split"), F.col("_in")).otherwise(F.array(F.struct(F.col("root").alias("g"), blocks("_m").alias("n")))))
    asked = near.drop("_rep").join(reps, F.col("node") == F.col("_rep")).select("_rep", "_rid", "_split", "_in.g", "_in.n", F.when(F.col("_split"), F.col("_bands")).alias("_bands"), F.col("_set_id._h1").alias("_h1"), F.col("_set_id._h2").alias("_h2"), "_th", "_size")
    asked = save(asked.withColumnsRenamed({"g": "_groups", "n": "_blocks", "_th": "_rth"}), "candidates")
    held = asked.agg(F.sum(F.aggregate("_blocks", F.lit(0).cast("long"), lambda out, n: out + n) * F.col("_size") * 8)).first()[0] or 0
    parts = held // PART_BYTES + 1  # many small pairs of blocks go to one call, dealt by hash
    asked = asked.drop("_size")
    asked = F.broadcast(asked) if asked.count() <= MAX_BROADCAST else asked
    sets = rows.withColumn("_th", F.xxhash64("_text")).join(asked, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_th") == F.col("_rth")))
    sets = sets.select("_text", "_rep", "_split", "_groups", "_blocks", "_bands", "_h1", "_h2")
    sets = sets.mapInPandas(_sets, "_rep long, _split boolean, _groups array<long>, _blocks array<int>, _bands array<long>, _set array<long>")
    sets = sets.withColumn("_in", F.explode(F.arrays_zip("_groups", "_blocks"))).select("_rep", "_split", F.col("_in._groups").alias("_g"), F.col("_in._blocks").alias("_n"), "_bands", "_set")
    sets = sets.withColumn("_block", F.pmod(F.xxhash64("_rep", "_g"), F.col("_n")).cast("int"))
    sets = sets.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    sets = sets.select("_rep", "_split", "_g", "_bands", "_block", "_set", F.least("_block", "_other").alias("_i"), F.greatest("_block", "_other").alias("_j"))
    pair = ["_split", "_g", "_i", "_j"]
    sets = sets.dropDuplicates(["_rep", *pair]).withColumn("_part", F.pmod(F.xxhash64(*pair), F.lit(parts)))
    verified = sets.groupBy("_part").applyInPandas(_verify, "_rep long, _links long, _to long")
    verified = save(verified, "links")

    # classes
    links = verified.groupBy("_rep").agg(F.sum("_links").alias("_links"))
    classes = components(verified, "_rep", "_to")
    named = reps.join(links, "_rep", "left").join(classes, F.col("_rep") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_rep"))
    named = save(named.select("_set_id", "_rid", "_root", "_copies", F.coalesce("_links", F.lit(0)).alias("_links")), "classes")
    least = named.groupBy("_root").agg(F.min("_rid").alias("_class"), F.count("*").alias("_in"))
    named = join_groups(named, least, "_root", "_in", max(1, named.count()), F.xxhash64("_rid", "_root", F.lit(4)))
    named = named.select("_set_id", "_rid", "_class", "_copies", "_links")
    spread = F.struct(F.col("_key").alias("_h1"), F.xxhash64("_key", F.lit(5)).alias("_h2"))
    out = join_groups(worded, named, "_set_id", "_copies", total, spread)
    out = out.select("_id", "_th", F.col("_rid").alias("rep_id"), F.col("_class").alias("class_id"), F.col("_links").alias("n_links"), F.col("_copies").alias("n_copies"))
    bare = signed.where("_n = 0").select("_id", "_th", F.col("_id").alias("rep_id"), F.col("_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return out.union(bare).withColumnRenamed("_id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those whose class has a smaller id.

    A document is known by its id and text together; rows equal in both count as one and stay or go together.
    """
    found = _classify(docs, id_col, text_col)
    gone = found.where(~F.col(id_col).eqNullSafe(F.col("class_id"))).select(F.col(id_col).alias("_gone"), F.col("_th").alias("_gone_text")).distinct()
    gone = save(gone, "dropped")
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST else gone
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("_gone")) & (F.xxhash64(text_of(text_col)) == F.col("_gone_text")), "left_anti")
