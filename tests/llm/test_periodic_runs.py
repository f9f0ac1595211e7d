"""Periodic runs against a search of every period."""

import hashlib
import random
import re
import zlib

import __spark_entry__ as entry
from telemill.llm import periodic_runs

SF = "/root/testdata/sf0.001"


def brute(words, shortest=12):
    best = {}
    for q in range(1, len(words)):
        at = 0
        while at + q < len(words):
            start = at
            while at + q < len(words) and words[at] == words[at + q]:
                at += 1
            if at + q - start >= max(shortest, 2 * q):
                best.setdefault((start, at + q), q)
            at += 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapsed(words, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def told(runs):
    return [(r["start"], r["length"], r["period"]) for r in runs]


def test_against_every_period():
    rng = random.Random(7)
    for _ in range(400):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            words = [rng.choice("abcde"[: rng.choice([1, 2, 2, 3, 5])]) for _ in range(rng.randrange(80))]
            if words and rng.random() < 0.6:
                p, a = rng.randrange(1, len(words) + 1), rng.randrange(len(words))
                words = [w if i < a else words[a + (i - a) % p] if a + (i - a) % p < len(words) else w for i, w in enumerate(words)]
            if rng.random() < 0.3:  # progressions that meet at a broken step
                x = ["a", "b"] * rng.randrange(1, 30)
                words += x + x[::-1]
            texts.append(words)
        shortest = rng.choice([2, 5, 12])
        for words, (runs, left) in zip(texts, periodic_runs.runs_of([" ".join(t) for t in texts], shortest), strict=True):
            want = brute(words, shortest)
            assert told(runs) == sorted(want, key=lambda r: (r[0], r[2]))
            assert left == collapsed(words, want)


def test_nested_and_long():
    words = (["x"] * 3 + ["y"]) * 5000 + ["z"] + ["q"] * 40000
    (runs, left), = periodic_runs.runs_of([" ".join(words)])
    assert told(runs) == [(0, 20000, 4), (20001, 40000, 1)]
    assert left == "x x x y z q"


def test_odd_rows(spark):
    rows = [(None, "a b " * 12), (1, None), (1, ""), (2, " \t\n"), (2, " \t\n"), (3, "p q " * 6), (4, "\x0b".join(["w"] * 13))]
    docs = spark.createDataFrame([(*r, i, "r", "p") for i, r in enumerate(rows)], "doc_id long, text string, _text int, runs string, period string")
    got = sorted((r.doc_id or 0, told(r.runs), r.collapsed) for r in periodic_runs.runs(docs).collect())
    assert got == [(0, [(0, 24, 2)], "a b"), (1, [], ""), (1, [], ""), (2, [], ""), (2, [], ""), (3, [], " ".join(["p q"] * 6)), (4, [(0, 13, 1)], "w")]
    assert periodic_runs.digest(periodic_runs.runs(periodic_runs.planted(docs))).count() == len(rows)
    assert periodic_runs.digest(periodic_runs.runs(periodic_runs.planted(docs.limit(0)))).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in entry.queries()["op13_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    seen = 0
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 3000 and h % 10:
            continue  # the brute search is quadratic
        runs = sorted(brute(words), key=lambda r: (r[0], r[2]))
        seen += bool(runs)
        r = got[d.doc_id]
        top = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{length},{q}\n" for s, length, q in runs))
        assert r.collapsed_sha256 == sha(collapsed(words, runs))
    assert seen > 5
