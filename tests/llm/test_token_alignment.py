"""Token alignment against whole texts encoded one by one and counted in a dictionary."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
from telemill.llm import token_alignment as ta

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizers():
    return ta.vocabularies()


def brute(tokenizers, texts):
    a_tok, a_bytes, b_tok, b_bytes = tokenizers
    out, pairs = [], Counter()
    for text in texts:
        a = a_tok.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        want = f" {text}".encode()
        if not text or b"".join(a_bytes[x] for x in a) != want or b"".join(b_bytes[x] for x in b) != want:
            out.append((0, 0, "", []))
            continue
        ends_a, ends_b = {}, {}
        for ends, ids, sizes in ((ends_a, a, a_bytes), (ends_b, b, b_bytes)):
            at = 0
            for k, x in enumerate(ids):
                at += len(sizes[x])
                ends[at] = k
        groups, links, i, j = [], [], 0, 0
        for end in sorted(ends_a.keys() & ends_b.keys()):
            k, m = ends_a[end] + 1, ends_b[end] + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            links.append((a[k - 1], b[m - 1]))
            i, j = k, m
        pairs.update(links)
        out.append((len(a), len(b), ";".join(groups), links))
    best = defaultdict(int)
    for (_, b), n in pairs.items():
        best[b] = max(best[b], n)
    return [(na, nb, len(ls), len(ls), sum(pairs[x] == best[x[1]] for x in ls), sum(pairs[x] for x in ls), told) for na, nb, told, ls in out], pairs


def shown(r):
    return (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups)


ODD = [
    "", " ", "  ", "a ", " a", "a  b", "a \n b", "\n\n  x", "x\t\ty z", "<|endoftext|> a <s></s> <0x41>", "▁", "a▁b c", "né é  x", "\U0001f600 ok", "it's 'll we'd", "x\x00y", "\x1c a\x1d b",
    "tail   ", "1234567 89.5%", "日本語 テキスト", "a\r\nb", "word" * 3000, "ﬁ ｶﾞ ①", "a　b   c", "'s 's", " 's",
]


def test_units_are_the_whole(tokenizers):
    """Encoding unit by unit is encoding the whole text."""
    rng = random.Random(3)
    parts = [*ODD, "the", "then", " ", "  ", "\n", ".", "'s", "Über"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    units = ta.Units(ta.A_FILE, ta.B_FILE)
    numbers, told, links, owner = units.encode(texts)
    want, _ = brute(tokenizers, texts)
    assert [(*n[:2], t) for n, t in zip(numbers.tolist(), told, strict=True)] == [(w[0], w[1], w[6]) for w in want]
    assert Counter(owner.tolist()) == Counter({k: w[3] for k, w in enumerate(want) if w[3]})


def test_bound_by_vocabularies(tokenizers):
    assert ta.most_pairs(tokenizers[1], tokenizers[3]) < 1_000_000


def test_many_small_spills_and_rounds(spark, tokenizers):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "naïve", "x1", "the", "unbelievable", "don't", "\n", "ß"]
    texts = ODD + [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(200)]
    docs = spark.createDataFrame([(k, t, "g", 1) for k, t in enumerate(texts)], "doc_id long, text string, groups string, n_a int").repartition(6)
    want, pairs = brute(tokenizers, texts)
    got = {r.doc_id: shown(r) for r in ta.align(docs, spill=300, fan_in=3).collect()}
    assert [got[k] for k in range(len(texts))] == want
    counted = ta.pair_counts(ta.merge(ta.spills(docs, spill=300), fan_in=4)).collect()
    assert {(r.a, r.b): r.n for r in counted} == dict(pairs)
    assert {(r.a, r.b) for r in counted if r.is_best} == {x for x, n in pairs.items() if n == max(m for y, m in pairs.items() if y[1] == x[1])}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (1, ""), (2, "a b"), (2, "a b"), (3, "▁")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, *shown(r)) for r in ta.align(docs).collect())
    zero = (0, 0, 0, 0, 0, 0, "")
    assert [g[0] for g in got] == [0, 1, 1, 2, 2, 3] and got[1][1:] == got[2][1:] == got[5][1:] == zero
    assert got[0][1:] == got[3][1:] == got[4][1:] and got[0][1:7] == (2, 2, 2, 2, 2, 6)
    assert [r.groups_sha256 for r in ta.digest(ta.align(docs)).where("doc_id = 1").collect()] == ["", ""]
    assert ta.align(docs.limit(0)).count() == 0


def test_query(spark, tokenizers):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want, _ = brute(tokenizers, [d.text or "" for d in docs])
    got = {r.doc_id: r for r in entry.queries()["op12_token_alignment"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d, w in zip(docs, want, strict=True):
        r = got[d.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == w[:6]
        assert r.groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")
