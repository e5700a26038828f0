"""Driver contract: entry() on sf0.001 and every oracle query against DuckDB."""

import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _canon(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{round(v, 6):.6f}"
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_canon(r[i]) for i in order) for r in rows)
    return [cols[i] for i in order], hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["label", "n", "pct", "bar", "n_labelled", "n_total"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    from evalspark.plans import queries as base  # the training-data queries have tests of their own
    assert set(base.ORACLE) == set(base.QUERIES)


TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
FORBIDDEN_IN_PLAN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def _assert_plan_ok(sdf):
    """No cross joins and no row-at-a-time Python UDFs in the executed plan."""
    plan = sdf._jdf.queryExecution().executedPlan().toString()
    for bad in FORBIDDEN_IN_PLAN:
        assert bad not in plan, bad


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    _assert_plan_ok(sdf)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [c[0] for c in res.description]
    drows = res.fetchall()
    assert len(srows) == len(drows)
    assert _digest(sdf.columns, srows) == _digest(dcols, drows)
    # column types agree as well (bigint/int/double/string/boolean)
    dtypes = dict(zip(dcols, [str(t) for t in duck.sql(E.oracle_sql()[name]).types]))
    stypes = {f.name: TYPE_NAMES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    assert stypes == dtypes
