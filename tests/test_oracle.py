"""Every query that has SQL against DuckDB over the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from quillspark import queries_data, queries_sources, queries_tables, queries_text

PARTS = [queries_tables, queries_text, queries_data, queries_sources]
NAMES = [(m, k) for m in PARTS for k in m.SQL]


def norm(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return str(v)


#: On the smallest tables 15 rows are left, whose columns depend on each other.
LARGER = {"ols_ladder_basic": "sf0.01"}


@pytest.fixture(scope="module")
def duck(data):
    cons = {}
    for sf in ("sf0.001", "sf0.01"):
        cons[sf] = duckdb.connect()
        for p in glob.glob(f"{data}/{sf}/*.parquet"):
            cons[sf].execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return cons


@pytest.mark.parametrize("module,name", NAMES, ids=[k for _, k in NAMES])
def test_query_equals_sql(spark, data, duck, module, name):
    sf = LARGER.get(name, "sf0.001")
    df = module.QUERIES[name](spark, f"{data}/{sf}")
    cols = sorted(df.columns)
    mine = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    got = duck[sf].execute(module.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert mine == sorted(repr(tuple(norm(r[i]) for i in at)) for r in got.fetchall())


@pytest.mark.parametrize("name", ["sentiment_rules", "mediation_bootstrap", "ols_ladder", "ols_table", "joint_model", "effort_paths"])
def test_queries_without_sql_run(spark, data, name):
    assert queries_text.QUERIES[name](spark, f"{data}/sf0.001").count() > 0
