"""Driver contract: entry() runs; every query has an oracle that agrees at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "n_barge_in" in df.columns


OWN = sorted(k for k in E.queries() if not k.startswith("op") and k != "pipeline")   # the others: tests/llm


def test_every_query_has_oracle():
    assert set(OWN) <= set(E.oracle_sql())


BATCH_KEYS = [k for k in OWN if not k.startswith("stream_")]


@pytest.mark.parametrize("key", BATCH_KEYS)
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(E.oracle_sql()[key])
    ocols = rel.columns
    assert sorted(ocols) == cols
    want = sorted(tuple(_norm(dict(zip(ocols, r))[c]) for c in cols) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("key", [k for k in OWN if k.startswith("stream_")])
def test_stream_twin_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    rel = duck.sql(E.oracle_sql()[key])
    want = sorted(tuple(_norm(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall())
    assert got == want
