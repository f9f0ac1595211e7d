"""Exact substring deduplication and its index against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from telemill.llm import substring_dedup
from telemill.llm.run_index import RunIndex

R = substring_dedup.REACH


def brute(rows):
    """rows: (order, text); by order: n_bytes, n_removed, n_spans, hash of what stays."""
    seen, out = set(), {}
    for order, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - R + 1):
            s = raw[p : p + R]
            if s in seen:
                gone[p : p + R] = b"\1" * R
            seen.add(s)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[order] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def told(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_run_index():
    random.seed(0)
    for trial in range(120):
        reach = random.choice([10, 12, 20, 100])
        texts = [bytes(random.choice(b"ab\0") for _ in range(random.randint(0, reach + 70))) for _ in range(random.randint(1, 12))]
        if trial % 3 == 0:
            texts = [texts[0] + t for t in texts] + texts
        if trial % 5 == 0:
            texts = [b"a" * random.randint(0, 2 * reach) for _ in range(6)]
        seen, want = set(), set()
        for i, t in enumerate(texts):
            for p in range(len(t) - reach + 1):
                if t[p : p + reach] in seen:
                    want.add((i, p))
                seen.add(t[p : p + reach])
        got = RunIndex(texts).repeated(reach)
        assert set(zip(got[0].tolist(), got[1].tolist(), strict=True)) == want


def test_samples_of_runs():
    """The neighbour before each suffix and the length of the match, from the samples alone; few runs where texts repeat."""
    random.seed(3)
    for trial in range(60):
        texts = [bytes(random.choice(b"ab\0") for _ in range(random.randint(0, 60))) for _ in range(random.randint(1, 8))]
        texts += texts[: trial % 4]
        index = RunIndex(texts)
        places = [(i, p) for i, t in enumerate(texts) for p in range(len(t) + 1)]
        rows = sorted(range(len(places)), key=lambda k: ([*(c + 1 for c in texts[places[k][0]][places[k][1] :]), 0], places[k][0]))
        source, length = index.matching_statistics()
        for above, row in zip(rows, rows[1:]):
            a, b = (texts[places[k][0]][places[k][1] :] for k in (above, row))
            common = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert length[row] == common and (not common or source[row] == above)
    text = bytes(random.choice(b"acgt") for _ in range(2000))
    once, often = RunIndex([text]), RunIndex([text] * 50)
    assert len(often.head) < len(once.head) + 50 * 3 and len(often.end) == len(often.common) == len(often.head)


@pytest.mark.parametrize("hot", [5_000, 1])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    random.seed(1)
    passage = " ".join(random.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60))
    more = [(1000 + k, " ".join(str(random.random()) for _ in range(random.randint(0, 9))) + passage + str(k) * k) for k in range(20)]
    more += [(2000, "a" * 5000), (2001, "b" + "a" * 300 + "é" * 100), (2002, None), (2003, ""), (2004, "x" * 99), (2005, "x" * 99), (2006, passage), (2007, passage), (2008, passage[:150] + "!" + passage[151:])]
    more += [(3000 + k, rows[5][1][: 400 + 31 * k] + "edit" + rows[5][1][400 + 31 * k :]) for k in range(8)]
    frame = docs.union(spark.createDataFrame(more, "doc_id long, text string")).repartition(5).withColumn("anchor", F.lit("clash")).withColumn("_h", F.lit(1))
    assert told(substring_dedup.remove_repeats(frame)) == brute(rows + more)


def test_ties_and_nulls(spark):
    text = "".join(chr(97 + k % 26) + str(k) for k in range(100))
    frame = spark.createDataFrame([(5, text), (5, text), (None, text[:200]), (None, None), (7, "q" + text)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in substring_dedup.remove_repeats(frame).collect()), key=str)
    n = len(text)
    assert got == sorted([(None, 200, 0), (None, 0, 0), (5, n, 200), (5, n, n), (7, n + 1, n)], key=str)
    assert substring_dedup.remove_repeats(frame.where("doc_id = 0")).count() == 0
    assert {bytes(r.kept) for r in substring_dedup.remove_repeats(frame, keep_bytes=True).where("doc_id = 7").collect()} == {b"q"}


def test_ids_are_whole_numbers(spark):
    with pytest.raises(TypeError, match="doc_id"):
        substring_dedup.remove_repeats(spark.createDataFrame([("a", "text")], "doc_id string, text string"))


def test_no_index_grows_with_a_string(spark, monkeypatch):
    """A passage in many different surroundings: none of its strings meets in one index more than HOT times."""
    monkeypatch.setattr(substring_dedup, "HOT", 20)
    plain = substring_dedup._stream

    def guarded(group):
        strings = [b[k : k + R] for b in group["bytes"] for k in range(len(b) - R + 1)]
        assert max(map(strings.count, set(strings)), default=0) <= 20
        return plain(group)

    monkeypatch.setattr(substring_dedup, "_stream", guarded)
    random.seed(4)
    noise = lambda n: "".join(random.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = noise(130)
    rows = [(k, noise(150) + passage + noise(150)) for k in range(60)] + [(99, noise(20) + passage * 3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert told(substring_dedup.remove_repeats(frame)) == brute(rows)


def test_a_line_in_every_row(spark, monkeypatch):
    """One line of 120 bytes in all rows: two rows a batch at most meet at its anchor."""
    plain = substring_dedup._cut

    def counted(batches):
        for batch in plain(batches):
            table = batch.to_pandas()
            near = table[~table["apart"]].groupby("anchor").size()
            assert near.max() <= 2 and (table.groupby("anchor")["mates"].sum() == (~table["again"]).groupby(table["anchor"]).sum()).all()
            yield batch

    random.seed(8)
    noise = lambda n: "".join(random.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    line = noise(120)
    rows = [(k, noise(130) + line + noise(110)) for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert told(substring_dedup.remove_repeats(frame)) == want
    monkeypatch.setattr(substring_dedup, "_cut", counted)
    monkeypatch.setattr(substring_dedup, "HOT", 50)
    assert told(substring_dedup.remove_repeats(frame)) == want


def test_a_text_of_megabytes(spark):
    random.seed(9)
    noise = "".join(random.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(700_000))
    rows = [(1, noise + noise[100_000:400_000]), (2, "é" * 200_000), (3, noise[650_000:])]
    assert told(substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
