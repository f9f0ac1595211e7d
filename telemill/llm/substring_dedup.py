"""Exact substring deduplication: every byte covered by a REACH-byte string that also starts earlier is removed.

One index over the whole corpus would need one machine, so strings are routed to many small run-length indexes.
Of the GRAM-byte strings within a REACH-byte string the one with the smallest hash is its anchor; equal strings
have equal anchors, so the index that holds all strings of an anchor answers exactly for them.

1. Each text is cut into segments: runs of neighbouring string starts with the same anchor, at most WIDTH starts.
   Segments that repeat within a batch are decided there; of the others the first two of each anchor are shuffled
   by anchor, which tells all batches whether it has several contents, and the rest are dealt out.
2. Of equal segments the first stays and the others are wholly repeated.  A segment whose anchor has no other
   content, and stands in it once, is unique.  What is left are different segments around one anchor, and loops.
3. These go, as text, to run-length indexes by anchor, each over about INDEX_BYTES (llm/run_index.py), through
   which they are streamed for matching statistics: a match of REACH bytes or more that starts earlier is removed.
   An anchor with more than HOT segments (counted by batches) goes into none: its strings are known by 128 bits of
   hash, the first of each is found by aggregation, and the others are marked by a join that deals out the rows of
   frequent strings, so that no task grows with anchor or string.
4. The marks of a text are joined into runs, and its remaining bytes hashed.  Texts without marks never move.

Exact copies of a whole text are settled beforehand: all but the first lose every byte where there are REACH.

Defined cases: ids are whole numbers, others raise a TypeError at once; a null text is empty; null ids are smaller
than others; rows of equal id are ordered by a hash of their text, and of equal id and text one row counts as the
first; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from telemill.llm.common import join_groups, save, text_of
from telemill.llm.run_index import RunIndex
from telemill.llm.shingles import chunks, mix

REACH, GRAM = 100, 24
WIDTH = REACH - GRAM + 1
HOT, INDEX_BYTES, MAX_BROADCAST, CHUNK = 5_000, 1 << 20, 200_000, 1 << 20
_BYTE = np.random.default_rng(99).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
NONE = -(1 << 63)  # order of a null id


def _least(a: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    k = 1
    while 2 * k <= width:
        a = np.minimum(a[: len(a) - k], a[k:])
        k *= 2
    return np.minimum(a[: len(a) - (width - k)], a[width - k :]) if k < width else a


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums that give the hash of any substring."""
    place = np.cumprod(np.full(len(data), _BASE, np.uint64))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * place)]), np.cumprod(np.full(len(data) + 1, _BASE_INV, np.uint64))


def segments(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, start, starts, anchor, content, loops) of the segments of some texts of REACH bytes or more.

    A segment loops when its anchor is in it twice; only then can a string repeat within the segment.
    """
    length = np.array([len(r) for r in raws], np.int64)
    data = np.frombuffer(b"".join(raws) + bytes(8), np.uint8)
    n = int(length.sum())
    words = np.ndarray((n,), "<u8", data, 0, (1,))
    m = n - GRAM + 1
    gram = mix(words[:m] * np.uint64(3) ^ mix(words[8 : 8 + m] * np.uint64(5) ^ mix(words[16 : 16 + m])))
    least = _least(gram, WIDTH)
    first = np.cumsum(length) - length
    count = length - REACH + 1
    text = np.repeat(np.arange(len(raws)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    anchor = least[first[text] + start]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])
    run = np.flatnonzero(new)
    long = np.diff(np.append(run, len(text)))
    pieces = -(-long // WIDTH)
    at = np.repeat(run, pieces) + WIDTH * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    starts = np.diff(np.append(at, len(text)))
    begin = first[text[at]] + start[at]
    total, back = _sums(data[:n])
    content = mix((total[begin + starts + REACH - 1] - total[begin]) * back[begin] + starts.astype(np.uint64))
    # places that are the anchor of a string: their hash is the largest of the least hashes around them
    around = np.concatenate([np.zeros(WIDTH - 1, np.uint64), least, np.zeros(WIDTH - 1, np.uint64)])
    places = np.flatnonzero(gram == ~_least(~around, WIDTH)[:m]) if len(least) else np.zeros(0, np.int64)
    lo, hi = np.searchsorted(places, begin), np.searchsorted(places, begin + starts + WIDTH - 1)
    owner = np.repeat(np.arange(len(at)), hi - lo)
    near = places[np.arange(len(owner)) + np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo)]
    loops = np.bincount(owner[gram[near] == anchor[at][owner]], minlength=len(at)) > 1
    return text[at], start[at], starts, anchor[at], content, loops


def _columns(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(order of the id, hash of the text, bytes) of some texts at a time."""
    texts = batch.column("_text").to_pylist()
    oid, h = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("_oid", "_h"))
    at = 0
    for part in chunks(texts, CHUNK):
        raws = [t.encode("utf-8", "surrogatepass") for t in part]
        keep = np.array([k for k, r in enumerate(raws) if len(r) >= REACH], np.int64)
        if len(keep):
            yield oid[at + keep], h[at + keep], [raws[k] for k in keep]
        at += len(part)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for oid, h, raws in _columns(batch):
            text, start, starts, anchor, content, loops = segments(raws)
            o, t, pos = oid[text], h[text], start * 128 + starts
            order = np.lexsort((pos, t, o, content, anchor))
            same = np.zeros(len(order), bool)  # rows of equal id and text give the same segments; one will do
            a, b = order[1:], order[:-1]
            same[1:] = (o[a] == o[b]) & (t[a] == t[b]) & (pos[a] == pos[b]) & (anchor[a] == anchor[b]) & (content[a] == content[b])
            order = order[~same]
            anchor, content, o, t, pos, loops = (x[order] for x in (anchor, content, o, t, pos, loops))
            first = np.ones(len(order), bool)  # of its anchor
            first[1:] = anchor[1:] != anchor[:-1]
            again = np.zeros(len(order), bool)  # an equal segment comes before it
            again[1:] = ~first[1:] & (content[1:] == content[:-1])
            begin = np.flatnonzero(first)
            size = np.diff(np.append(begin, len(order)))
            nth = np.cumsum(~again) - 1  # which content of its anchor
            nth = nth - np.repeat(nth[begin], size)
            kinds = np.repeat(np.maximum.reduceat(nth, begin), size) if len(begin) else nth
            mates = np.where(first, np.repeat(np.add.reduceat((~again).astype(np.int64), begin), size), 0) if len(begin) else nth
            yield pa.RecordBatch.from_pydict({"anchor": anchor.view(np.int64), "content": content.view(np.int64), "_oid": o, "_h": t, "pos": pos, "again": again, "apart": again | (nth > 1), "several": kinds > 0, "mates": mates, "loops": loops})


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """The bytes of the segments asked for."""
    for batch in batches:
        wanted = batch.column("_asked").to_pylist()
        anchors, oids, hashes, places, contents = [], [], [], [], []
        rows = zip(batch.column("_text").to_pylist(), batch.column("_oid").to_pylist(), batch.column("_h").to_pylist(), wanted, strict=True)
        for text, oid, h, asked in rows:
            raw = text.encode("utf-8", "surrogatepass")
            for one in asked:
                start, starts = divmod(one["pos"], 128)
                anchors.append(one["anchor"])
                oids.append(oid)
                hashes.append(h)
                places.append(start)
                contents.append(raw[start : start + starts + REACH - 1])
        yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchors, pa.int64()), "_oid": pa.array(oids, pa.int64()), "_h": pa.array(hashes, pa.int64()), "start": pa.array(places, pa.int64()), "bytes": pa.array(contents, pa.binary())})


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and place of each string of the segments asked for."""
    for batch in batches:
        rows = zip(batch.column("_text").to_pylist(), batch.column("_oid").to_pylist(), batch.column("_h").to_pylist(), batch.column("_asked").to_pylist(), strict=True)
        for text, oid, h, asked in rows:
            raw = text.encode("utf-8", "surrogatepass")
            places = [s for one in asked for s in range(one["pos"] // 128, one["pos"] // 128 + one["pos"] % 128)]
            digests = [hashlib.blake2b(raw[s : s + REACH], digest_size=16).digest() for s in places]
            yield pa.RecordBatch.from_pydict({"string": pa.array(digests, pa.binary()), "_oid": pa.array([oid] * len(places), pa.int64()), "_h": pa.array([h] * len(places), pa.int64()), "start": pa.array(places, pa.int64())})


def _stream(group: pd.DataFrame) -> pd.DataFrame:
    """Marks of the segments of one index: runs of bytes that are repeated."""
    group = group.sort_values(["_oid", "_h", "start"], kind="stable").drop_duplicates(["_oid", "_h", "start"])
    text, place = RunIndex(group["bytes"].tolist()).repeated(REACH)
    order = np.lexsort((place, text))
    text, place = text[order], place[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(text))[: len(at)] - 1
    rows = group.iloc[text[at]]
    start = rows["start"].to_numpy()
    return pd.DataFrame({"_oid": rows["_oid"].to_numpy(), "_h": rows["_h"].to_numpy(), "a": start + place[at], "b": start + place[last] + REACH})


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, marks in zip(batch.column("_text").to_pylist(), batch.column("_marks").to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            kept, spans, removed, end = [], 0, 0, -1
            for m in sorted((m["a"], m["b"]) for m in marks):
                if m[0] > end:
                    kept.append(raw[max(end, 0) : m[0]])
                    spans += 1
                    removed += m[1] - m[0]
                    end = m[1]
                elif m[1] > end:
                    removed += m[1] - end
                    end = m[1]
            kept.append(raw[max(end, 0) :])
            out.append((removed, spans, b"".join(kept)))
        yield pa.RecordBatch.from_pydict({
            "_oid": batch.column("_oid"), "_h": batch.column("_h"),
            "n_removed": pa.array([x[0] for x in out], pa.int64()), "n_spans": pa.array([x[1] for x in out], pa.int64()), "kept": pa.array([x[2] for x in out], pa.binary()),
        })


def _small(df: DataFrame) -> DataFrame | None:
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else None


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, with ``keep_bytes``, for texts that lost bytes)."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} orders the texts and must be a whole number, not {docs.schema[id_col].dataType.simpleString()}")
    identity = lambda: (F.coalesce(F.col(id_col).cast("long"), F.lit(NONE)).alias("_oid"), F.xxhash64(text_of(text_col)).alias("_h"))
    rows = docs.select(*identity(), text_of(text_col).alias("_text"))
    digests = save(docs.select(F.col(id_col).alias("_id"), *identity(), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), F.unhex(F.sha2(text_of(text_col), 256)).alias("_sha"), F.monotonically_increasing_id().alias("_key")), "digests")
    total = digests.count()

    # exact copies
    groups = digests.groupBy("_sha").agg(F.min(F.struct("_oid", "_key")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    digests = save(join_groups(digests, groups, "_sha", "_n", total, F.unhex(F.sha2(F.col("_key").cast("string"), 256))).withColumn("_copy", F.coalesce(F.col("_first._key") != F.col("_key"), F.lit(False))).drop("_first", "_n"), "copies")
    copies = digests.where("_copy").select("_oid", "_h").join(digests.where("not _copy").select("_oid", "_h"), ["_oid", "_h"], "left_anti").distinct()
    few = _small(save(copies, "copy-keys"))
    rows = rows.join(few, ["_oid", "_h"], "left_anti") if few is not None else rows

    # segments by anchor
    cut = rows.mapInArrow(_cut, "anchor long, content long, _oid long, _h long, pos long, again boolean, apart boolean, several boolean, mates long, loops boolean")
    cut = cut.withColumn("_k", F.when(F.col("apart"), F.xxhash64("_oid", "_h", "pos")).otherwise(F.col("anchor")))
    by_anchor = W.partitionBy("_k", "anchor")  # two rows a batch at most
    by_content = W.partitionBy("_k", "anchor").orderBy("content", "_oid", "_h", "pos")
    cut = cut.withColumn("_before", F.lag(F.struct("content", "_oid", "_h", "pos")).over(by_content)).withColumn("_one", F.min("content").over(by_anchor)).withColumn("_other", F.max("content").over(by_anchor))
    cut = cut.withColumn("_mates", F.sum("mates").over(by_anchor))
    whole = F.col("again") | F.coalesce((F.col("_before.content") == F.col("content")) & (F.col("_before") != F.struct("content", "_oid", "_h", "pos")), F.lit(False))
    found = cut.where(whole | F.col("loops") | F.col("several") | (F.col("_one") != F.col("_other"))).select("_oid", "_h", "pos", "anchor", whole.alias("whole"), (~F.col("apart") & (F.col("_mates") > HOT)).alias("hot"))
    found = save(found, "segments")
    crowds = save(found.where("hot").select(F.col("anchor").alias("_crowd")).distinct(), "crowds")

    # segments that share an anchor, through run-length indexes
    def asked_of(some: DataFrame) -> DataFrame:
        asked = some.groupBy("_oid", "_h").agg(F.collect_list(F.struct("pos", "anchor")).alias("_asked"))
        touched = _small(save(some.select("_oid", "_h").distinct(), "asked-keys"))
        texts = rows.join(touched, ["_oid", "_h"], "left_semi") if touched is not None else rows
        return texts.join(asked, ["_oid", "_h"])

    open_ = found.where("not whole")
    few = _small(crowds)
    light, hot = (open_.join(crowds if few is None else few, F.col("anchor") == F.col("_crowd"), kind) for kind in ("left_anti", "left_semi"))
    indexes = max(1, light.count() * (REACH + WIDTH // 2) // INDEX_BYTES)
    parts = asked_of(light).mapInArrow(_extract, "anchor long, _oid long, _h long, start long, bytes binary")
    parts = parts.withColumn("_index", F.pmod(F.xxhash64("anchor"), F.lit(indexes)))
    streamed = save(parts.groupBy("_index").applyInPandas(_stream, "_oid long, _h long, a long, b long"), "marks")

    # segments of hot anchors, string by string
    if not hot.isEmpty():
        strings = save(asked_of(hot).mapInArrow(_strings, "string binary, _oid long, _h long, start long"), "strings")
        firsts = strings.groupBy("string").agg(F.min(F.struct("_oid", "_h", "start")).alias("_first"), F.count("*").alias("_times")).where("_times > 1")
        spread = F.unhex(F.sha2(F.concat_ws(":", "_oid", "_h", "start"), 256))
        later = join_groups(strings, firsts, "string", "_times", strings.count(), spread).where(F.col("_first") != F.struct("_oid", "_h", "start"))
        streamed = streamed.union(save(later.select("_oid", "_h", F.col("start").alias("a"), (F.col("start") + REACH).alias("b")), "string-marks"))

    # the bytes that stay
    begin = F.expr("pos div 128")
    marks = found.where("whole").select("_oid", "_h", begin.alias("a"), (begin + F.col("pos") % 128 + (REACH - 1)).alias("b")).union(streamed)
    touched = _small(save(marks.select("_oid", "_h").distinct(), "marked-keys"))
    some = rows.join(touched, ["_oid", "_h"], "left_semi") if touched is not None else rows
    marked = some.join(marks.groupBy("_oid", "_h").agg(F.collect_list(F.struct("a", "b")).alias("_marks")), ["_oid", "_h"])
    cleaned = marked.mapInArrow(_remove, "_oid long, _h long, n_removed long, n_spans long, kept binary")
    cleaned = cleaned.withColumn("_kept_sha", F.sha2("kept", 256))
    more = ["kept"] if keep_bytes else []
    cleaned = cleaned.select("_oid", "_h", "n_removed", "n_spans", "_kept_sha", *more).dropDuplicates(["_oid", "_h"])
    zero = F.lit(0).cast("long")
    first = digests.where("not _copy").join(cleaned, ["_oid", "_h"], "left").select(
        F.col("_id").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("_kept_sha", F.lower(F.hex("_sha"))).alias("kept_sha256"), *more
    )
    gone = F.col("n_bytes") >= REACH
    rest = digests.where("_copy").select(
        F.col("_id").alias(id_col), "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.lower(F.hex("_sha"))).alias("kept_sha256"), *[F.when(gone, F.lit(b"")).alias("kept")] * len(more),
    )
    return first.union(rest)
