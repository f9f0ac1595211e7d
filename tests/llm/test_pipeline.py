"""The pipeline's stages against plain Python on the smallest data."""

import re

import pytest

import corpus_pipeline
from telemill.llm import quality
from telemill.llm.common import read_table, save

SF = "/root/testdata/sf0.001"


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def sets(text):
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_stages(spark):
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "benchmark", "tokens"]

    good = {r.doc_id for r in quality.classify(docs, read_table(spark, SF, "labels")).where("predicted = 1").collect()}
    docs = save(stages["quality"](spark, docs, SF), "t")
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert kept.keys() == good and docs.columns == columns

    docs = save(stages["exact"](spark, docs, SF), "t")
    first = {}
    for k in sorted(kept):
        first.setdefault(normal(kept[k]), k)
    kept = {k: kept[k] for k in first.values()}
    assert {r.doc_id for r in docs.collect()} == kept.keys() and docs.columns == columns

    docs = save(stages["near"](spark, docs, SF), "t")
    sh = {k: sets(t) for k, t in kept.items()}
    group = {k: k for k in kept}
    changed = True
    near = [(a, b) for a in kept for b in kept if a < b and sh[a] and len(sh[a] & sh[b]) >= 0.8 * len(sh[a] | sh[b])]
    while changed:
        changed = False
        for a, b in near:
            low = min(group[a], group[b])
            changed |= group[a] != low or group[b] != low
            group[a] = group[b] = low
    kept = {k: t for k, t in kept.items() if group[k] == k}
    assert {r.doc_id for r in docs.collect()} == kept.keys() and docs.columns == columns

    docs = save(stages["benchmark"](spark, docs, SF), "t")
    items = [sets(r.text) for r in read_table(spark, SF, "benchmark").collect()]
    kept = {k: t for k, t in kept.items() if not any(i and len(i & sh[k]) >= 0.8 * len(i) for i in items)}
    assert {r.doc_id for r in docs.collect()} == kept.keys() and docs.columns == columns

    out = stages["tokens"](spark, docs, SF).collect()
    assert {r.doc_id for r in out} == kept.keys() and all(r.round_trip and r.n_ids == len(r.ids) for r in out)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, _row string, _sha string, _id long, root string, _bands string"


def odd(spark, rows):
    """Documents with columns whose names the stages use themselves."""
    return spark.createDataFrame([(i, t, None, None, None, "a", "b", 7, "c", None) for i, t in rows], ODD)


@pytest.fixture
def tables(spark, tmp_path):
    """labels and benchmark of a folder of their own."""
    read_table(spark, SF, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


ITEM = " ".join(f"item{k}" for k in range(30))
LONG = " ".join(f"long{k}" for k in range(60_000))
NEAR = " ".join(f"near{k}" for k in range(80))
ROWS = [(1, None), (2, ""), (None, None), (3, NEAR), (4, NEAR + " end"), (None, NEAR + " close"), (5, NEAR), (5, NEAR), (6, "a  b"), (7, "a b"), (8, LONG), (9, " ".join(f"x{k}" for k in range(50)) + " " + ITEM + " y"), (9, "another text under this id"), (None, ITEM)]


def test_stages_on_odd_rows(spark, tables):
    """Nulls, empty and very long texts, repeated rows and ids, and clashing columns, stage by stage."""
    docs, stages = odd(spark, ROWS), dict(corpus_pipeline.STAGES)
    key = lambda r: (str(r.doc_id), (r.text or "")[:12])
    told = lambda df: sorted(map(key, df.collect()))

    judged = quality.classify(docs.limit(0).union(odd(spark, [(k, t) for k, (_, t) in enumerate(ROWS)])), read_table(spark, tables, "labels"))
    good = {r.doc_id for r in judged.where("predicted = 1").collect()}
    got = stages["quality"](spark, docs, tables)
    assert got.columns == docs.columns and got.count() == len(good)

    got = stages["exact"](spark, docs, tables)
    assert got.columns == docs.columns
    assert told(got) == sorted([("1", ""), ("3", NEAR[:12]), ("4", NEAR[:12]), ("None", NEAR[:12]), ("6", "a  b"), ("8", LONG[:12]), ("9", "x0 x1 x2 x3 "), ("9", "another text"), ("None", ITEM[:12])])

    got = stages["near"](spark, docs, tables)
    assert got.columns == docs.columns
    gone = [("4", NEAR[:12]), ("None", NEAR[:12]), ("5", NEAR[:12]), ("5", NEAR[:12]), ("7", "a b")]
    left = [(str(i), (t or "")[:12]) for i, t in ROWS]
    for x in gone:
        left.remove(x)
    assert told(got) == sorted(left)

    got = stages["benchmark"](spark, docs, tables)
    assert got.columns == docs.columns
    left = [(str(i), (t or "")[:12]) for i, t in ROWS]
    for x in [("9", "x0 x1 x2 x3 "), ("None", ITEM[:12])]:
        left.remove(x)
    assert told(got) == sorted(left)

    got = stages["tokens"](spark, docs, tables).collect()
    assert len(got) == len(ROWS) and all(r.round_trip and r.n_ids == len(r.ids) for r in got)
    assert sorted(r.n_ids for r in got)[:3] == [0, 0, 0] and len({tuple(r.samples[0]) for r in got if r.doc_id == 5}) == 1


def test_stages_on_empty_tables(spark, tables):
    docs = odd(spark, ROWS).where("doc_id = 99")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, tables)
        assert got.count() == 0 and (name == "tokens" or got.columns == docs.columns)
