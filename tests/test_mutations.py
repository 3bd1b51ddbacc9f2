"""Batch write operators: sequential semantics on small fixtures and brute force."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_ORACLE, SF_SMALL
from tillpoint.operators import mutations as M
from tillpoint.plans import mutations_catalog as MC
from tillpoint.sources import bindings as B

KEYS = ["email", "phone", "bank_account_number"]
LABEL = {"email": "Email", "phone": "Phone", "bank_account_number": "Bank Account Number"}


def brute_first_wins(requests: pd.DataFrame, existing: pd.DataFrame):
    """Insert requests one by one in request_id order; refuse when a key value is taken."""
    taken = {k: set(existing[k].dropna()) for k in KEYS}
    out = {}
    for _, r in requests.sort_values("request_id").iterrows():
        hits = [LABEL[k] for k in KEYS if r[k] in taken[k]]
        if hits:
            out[r.request_id] = ", ".join(hits)
        else:
            out[r.request_id] = None
            for k in KEYS:
                taken[k].add(r[k])
    return out


@pytest.mark.parametrize("sf_dir", [SF_SMALL, SF_ORACLE])
def test_employee_conflicts_match_sequential_inserts(spark, sf_dir):
    c = B.commerce_binding(spark, sf_dir)
    req = MC.employee_add_requests(c)
    got = {r.request_id: r.conflict for r in
           M.first_wins_unique(req, c.employees, KEYS).collect()}
    want = brute_first_wins(req.toPandas(), c.employees.toPandas())
    assert got == want
    assert any(v is None for v in want.values()) and any(v for v in want.values())


def test_first_wins_chain(spark):
    # r1 takes a/x; r2 shares x with r1 -> refused; r3 shares b only with refused r2 -> accepted
    req = spark.createDataFrame([(1, "a", "x", "k1"), (2, "b", "x", "k2"), (3, "b", "y", "k3")],
                                "request_id long, email string, phone string, bank_account_number string")
    existing = spark.createDataFrame([("z", "z", "k3")], "email string, phone string, bank_account_number string")
    got = {r.request_id: r.conflict for r in M.first_wins_unique(req, existing, KEYS).collect()}
    assert got == {1: None, 2: "Phone", 3: "Bank Account Number"}


def test_update_rows_last_write_wins_and_404(spark):
    table = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id long, name string, v int")
    req = spark.createDataFrame([(10, 1, "x", 1), (11, 1, "y", 2), (12, 9, "z", 3)],
                                "request_id long, id long, name string, v int")
    out = M.update_rows(table, req, "id", ["name", "v"])
    assert sorted(tuple(r) for r in out.table.collect()) == [(1, "y", 2), (2, "b", 20)]
    assert {r.request_id: r.http_code for r in out.outcome.collect()} == {10: 200, 11: 200, 12: 404}


def test_delete_twice_second_is_404(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    req = spark.createDataFrame([(5, 1), (6, 1), (7, 3)], "request_id long, id long")
    out = M.delete_returning(table, req, "id")
    assert [tuple(r) for r in out.table.collect()] == [(2, "b")]
    assert {r.request_id: r.http_code for r in out.outcome.collect()} == {5: 200, 6: 404, 7: 404}
    assert [r.request_id for r in out.returned.collect()] == [5]


def test_patch_absent_vs_null(spark):
    table = spark.createDataFrame([(1, "a@x", "p1", "Clerk")], "id long, email string, phone string, position string")
    patches = spark.createDataFrame([(1, 1, ["position"], None, None, None)],
                                    "request_id long, id long, provided array<string>, email string, phone string, "
                                    "position string")
    out = M.patch_rows(table, patches, "id", ["email", "phone", "position"], touch_col=None)
    assert [tuple(r) for r in out.table.collect()] == [(1, "a@x", "p1", None)]


def test_falsy_rules(spark):
    df = spark.createDataFrame([(0, "", None), (1, "a", 2.5)], "a int, b string, c double")
    got = [r[0] for r in df.select(M.any_falsy(df, ["a", "b"])).collect()]
    assert got == [True, False]
