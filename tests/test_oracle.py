"""Every registered query against its DuckDB oracle on the sf0.001 tables."""
import math

import duckdb
import pytest

import __spark_entry__ as entry
from siftkit.sources.tables import TABLES

from .conftest import SF_SMALL

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_oracle_or_is_listed():
    missing = sorted(set(QUERIES) - set(ORACLE))
    no_sql = ("k2_", "op3_", "op5_", "op6_", "op7_", "op9_", "op10_", "op11_", "op12_", "pipeline")  # models, packing plans, random orders
    assert all(m.startswith(no_sql) for m in missing), missing


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(ORACLE[name])
    want = _rows(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == want


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["doc_id", "has_aml", "split_cnt", "n_ner_names", "ner_names", "names"]
