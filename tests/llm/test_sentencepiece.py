"""Encoding against the library, decoding as a round trip, and the sampler against exact probabilities."""

import collections

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from telemill.llm import sentencepiece_sampling as sps
from telemill.llm.shingles import mix


@pytest.fixture(scope="module")
def codec():
    with open(sps.MODEL, "rb") as file:
        return sps.Codec(file.read())


def draw(codec, texts, seeds, k):
    places, counts = codec.units(texts)
    out = codec.sample(places, counts, np.asarray(seeds, np.uint64), k)
    rounds = []
    for s in out:
        at = np.concatenate([[0], np.cumsum(s["n"])])
        rounds.append([tuple(s["ids"][a:b].tolist()) if f else None for a, b, f in zip(at[:-1], at[1:], s["found"], strict=True)])
    return out, rounds


def test_frame(spark):
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (None, "  two  spaces ", "x"), (5, "naïve café\n漢字 \U0001f600\x00", "x"), (5, "a" * 30_000 + " b" * 20_000, "x"), (7, "the the", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sps.encode(docs, k=3).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=sps.MODEL)
    want = collections.Counter((i, tuple(sp.encode(t or ""))) for i, t, _ in rows)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want and all(r.round_trip for r in got)
    for r in got:
        drawn = [tuple(s.ids) for s in r.samples]
        assert len(set(drawn)) == len(drawn) >= 1
        assert all(s.perturbed >= t.perturbed for s, t in zip(r.samples, r.samples[1:]))
        assert all(s.log_inclusion <= 0 for s in r.samples)
        assert {sp.decode(list(d)) for d in drawn} == {sp.decode(list(r.ids))}
    assert sps.encode(docs.where("doc_id = 99"), k=2).count() == 0
    again = {(r.doc_id, tuple(r.ids)): r.samples for r in sps.encode(docs.repartition(5), k=3).collect()}
    for r in got:
        other = again[r.doc_id, tuple(r.ids)]
        assert [s.ids for s in other] == [s.ids for s in r.samples]
        assert np.allclose([(s.log_prob, s.perturbed) for s in other], [(s.log_prob, s.perturbed) for s in r.samples], atol=1e-5)


def test_order_probabilities(codec):
    n = 20_000
    out, rounds = draw(codec, ["the the"] * n, mix(np.arange(n, dtype=np.uint64)), 3)
    p = {}
    for s, drawn in zip(out, rounds, strict=True):
        p |= {x: float(np.exp(lp)) for x, lp in zip(drawn, s["log_prob"], strict=True) if x}
    assert abs(sum(p.values()) - 1) < 1e-3
    for (a, b), count in collections.Counter(zip(rounds[0], rounds[1], strict=True)).most_common(4):
        assert a != b
        want = p[a] * p[b] / (1 - p[a])
        assert abs(count / n - want) < 4 * (want / n) ** 0.5 + 1e-3
    weight = sum(np.where(s["found"], np.exp(s["log_prob"] - s["log_inclusion"]), 0) for s in out)
    assert abs(weight.mean() - 1) < 0.01


def plain_pieces(codec):
    sp = codec.sp
    return {sp.id_to_piece(k): k for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k) or sp.is_unused(k))}


def segmentations(codec, pieces, text):
    """Ids of every way to spell the text, byte pieces for characters that are no piece."""
    text = sps.SPACE + text

    def rest(at):
        if at == len(text):
            return [()]
        out = [(pieces[text[at:end]], *r) for end in range(at + 1, len(text) + 1) if text[at:end] in pieces and sps.SPACE not in text[at + 1 : end] for r in rest(end)]
        if text[at] not in pieces:
            out += [(*(int(codec.byte_id[b]) for b in text[at].encode()), *r) for r in rest(at + 1)]
        return out

    return rest(0)


def test_all_segmentations_come_once(codec):
    """With k above their number exactly all come, however unlikely, and nothing is left; their weights are those of their pieces."""
    pieces, spelt = plain_pieces(codec), set(codec.byte_id.tolist())
    words = [codec.sp.id_to_piece(k).replace(sps.SPACE, "") for k in range(300, codec.sp.get_piece_size(), 17)]
    words = [w for w in words if w and w.isascii() and 2 <= len(segmentations(codec, pieces, w)) <= 40][:50] + ["in", "z", "a\u4e00\U0001f600b"]
    assert len(words) == 53
    want = [set(segmentations(codec, pieces, w)) for w in words]
    k = max(map(len, want)) + 3
    out, rounds = draw(codec, words, mix(np.arange(len(words), dtype=np.uint64)), k)
    for i, w in enumerate(want):
        drawn = [r[i] for r in rounds if r[i]]
        assert len(drawn) == len(w) and set(drawn) == w
        assert abs(sum(np.exp(s["log_prob"][i]) for s in out if s["found"][i]) - 1) < 1e-9
        assert all(s["log_inclusion"][i] == 0 for s in out if s["found"][i])
        weigh = lambda ids: sum(codec.weight[codec.byte_id[0]] if x in spelt else codec.weight[x] for x in ids)
        gap = [s["log_prob"][i] - weigh(r[i]) for s, r in zip(out, rounds, strict=True) if s["found"][i]]
        assert np.ptp(gap) < 1e-8


def test_the_table_of_units_only_saves_work(codec):
    """Little room, no room and much: the same samples."""
    texts = [f"word{k} common things and word{k % 7} again" for k in range(60)]
    with open(sps.MODEL, "rb") as file:
        model = file.read()
    seen = []
    for keep in (0, 300, 1 << 20):
        other, got = sps.Codec(model, keep), []
        for at in range(0, 60, 10):
            _, rounds = draw(other, texts[at : at + 10], range(at, at + 10), 3)
            got += [rounds, other.decode(*other.encode(*other.units(texts[at : at + 10])))]
        seen.append(got)
    assert seen[0] == seen[1] == seen[2] and seen[0][1] == texts[:10]


def test_documents(spark, codec):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("text")).collect()]
    ids, n = codec.encode(*codec.units(texts))
    at = np.concatenate([[0], np.cumsum(n)])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == codec.sp.encode(texts)
    assert codec.decode(ids, n) == texts
