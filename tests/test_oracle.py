"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate)."""

import decimal
import math

import pytest

import __spark_entry__ as E
from tests.conftest import SF_ORACLE

QUERIES = E.queries()
ORACLE = E.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return v


def _key(r):
    return tuple((x is None, str(x)) for x in r)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_ORACLE)
    cols = df.columns
    got = sorted((tuple(_norm(x) for x in r) for r in df.collect()), key=_key)
    res = duck.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(dcols)
    idx = [dcols.index(c) for c in cols]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=_key)
    assert len(got) == len(want)
    assert got == want


def test_every_query_has_a_docstring_or_oracle():
    for name in QUERIES:
        assert name in ORACLE or QUERIES[name].__doc__, name


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 7
    assert df.columns == ["period", "total_income", "total_expense", "total_profit", "label"]
