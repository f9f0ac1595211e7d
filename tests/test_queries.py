"""Every registered query runs on the smallest data and gives the rows of its SQL."""

import math
import os

import duckdb
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = sorted(k for k in entry.queries() if not k.startswith("op") and k != "pipeline")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(columns, found):
    tidy = lambda v: None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}") if isinstance(v, float) else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(tidy(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    want = entry.oracle_sql().get(name)
    if want:
        found = sql.execute(want)
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, got) == rows(columns, found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_what_sql_cannot_tell(spark):
    """Footers as another reader sees them."""
    meta = pq.ParquetFile(f"{SF}/events.parquet").metadata
    weights = {}
    for g in range(meta.num_row_groups):
        for c in range(meta.num_columns):
            chunk = meta.row_group(g).column(c)
            packed, raw, rows_ = weights.get(chunk.path_in_schema, (0, 0, 0))
            weights[chunk.path_in_schema] = (packed + chunk.total_compressed_size, raw + chunk.total_uncompressed_size, rows_ + meta.row_group(g).num_rows)
    run = lambda name: entry.queries()[name](spark, SF)
    assert {r["column"]: (r.packed, r.raw, r.rows) for r in run("src_10_column_weights").collect()} == weights
