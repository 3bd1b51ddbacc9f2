"""Checkout allocation (M1/M2) against a sequential replay of the reference's loop."""

import decimal

import pandas as pd
import pytest

from tests.conftest import SF_ORACLE, SF_SMALL
from tillpoint.operators.checkout import checkout
from tillpoint.sources import bindings as B


def replay(sf_dir, web=False):
    """One cart at a time, one item at a time, as the reference's handler does."""
    orders = pd.read_parquet(f"{sf_dir}/orders.parquet")
    li = pd.read_parquet(f"{sf_dir}/lineitem.parquet")
    part = pd.read_parquet(f"{sf_dir}/part.parquet")
    cust = set(pd.read_parquet(f"{sf_dir}/customer.parquet").c_custkey)
    stock = dict(zip(part.p_partkey, part.p_size))
    li = li.sort_values(["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"])
    items = {k: g for k, g in li.groupby("l_orderkey")}
    out = {}
    for _, o in orders.sort_values(["o_orderdate", "o_orderkey"]).iterrows():
        k = o.o_orderkey
        if web and o.o_custkey not in cust:
            out[k] = (404, "User not found")
            continue
        if k not in items:
            out[k] = (400, "Missing required fields")
            continue
        used, fail = {}, None
        for _, it in items[k].iterrows():
            pid, q = it.l_partkey, int(it.l_quantity)
            if pid not in stock:
                fail = (404, f"Product ID {pid} not found")
                break
            if stock[pid] - used.get(pid, 0) < q:
                fail = (400, f"Insufficient stock for product ID {pid}")
                break
            if q <= 0 or it.l_extendedprice < 0:
                fail = (500, "Checkout failed")
                break
            used[pid] = used.get(pid, 0) + q
        if fail:
            out[k] = fail
        else:
            for pid, q in used.items():
                stock[pid] -= q
            out[k] = (201, None)
    return out, stock


@pytest.mark.parametrize("sf_dir,web,ranges", [(SF_SMALL, False, None), (SF_ORACLE, False, None), (SF_SMALL, True, 1),
                                               (SF_SMALL, False, 60)])
def test_checkout_matches_sequential_replay(spark, sf_dir, web, ranges):
    """60 ranges over 200 products cut many products: ranges must not change the result."""
    c = B.commerce_binding(spark, sf_dir)
    req, items = B.checkout_requests(c)
    r = checkout(req, items, c.products, users=c.users, web=web, ranges=ranges)
    idc = "order_id" if web else "cart_id"
    got = {row[idc]: (row.http_code, row.reason) for row in r.decisions.collect()}
    want, stock = replay(sf_dir, web)
    assert got == want
    after = {row.id: row.quantity for row in r.stock.collect()}
    assert after == stock
    n_acc = sum(1 for v in want.values() if v[0] == 201)
    assert r.carts.count() == n_acc == r.bills.count() == r.incomes.count()
    assert r.rounds >= 1


def test_checkout_two_carts_compete_and_refusal_frees_stock(spark):
    from pyspark.sql import functions as F
    reqs = spark.createDataFrame(
        [(1, "2024-01-01 10:00:00"), (2, "2024-01-01 11:00:00"), (3, "2024-01-01 12:00:00"),
         (4, "2024-01-01 13:00:00")], "cart_id long, requested_at string") \
        .select("cart_id", F.to_timestamp_ntz("requested_at").alias("requested_at"),
                F.lit("pending").alias("status"), F.lit("paid").alias("payment_status"),
                F.lit("cash").alias("payment_method"))
    D = decimal.Decimal
    items = spark.createDataFrame(
        [(1, 1, 10, 3, D("1.00")),              # takes 3 of 5
         (2, 1, 10, 2, D("1.00")), (2, 2, 99, 1, D("1.00")),   # unknown product 99 after a fitting item -> 404
         (3, 1, 10, 1, D("1.00")), (3, 2, 10, 2, D("1.00")),   # same product twice: 3 > 2 left -> 400
         (4, 1, 10, 2, D("1.50"))],             # cart 3 refused, so 2 are still there -> accepted
        "cart_id long, pos int, product_id long, quantity int, unit_price decimal(10,2)")
    products = spark.createDataFrame([(10, 5)], "id long, quantity int")
    r = checkout(reqs, items, products)
    got = {row.cart_id: (row.decision, row.http_code, row.reason) for row in r.decisions.collect()}
    assert got == {1: ("accepted", 201, None), 2: ("rejected", 404, "Product ID 99 not found"),
                   3: ("rejected", 400, "Insufficient stock for product ID 10"), 4: ("accepted", 201, None)}
    assert {row.id: row.quantity for row in r.stock.collect()} == {10: 0}
    assert sorted(x.amount for x in r.incomes.collect()) == [3.0, 3.0]


def test_carts_that_cannot_fit_are_not_dealt(spark, monkeypatch):
    """A line above the whole stock refuses its cart before lines are dealt by range; the cart's answer stays."""
    from pyspark.sql import functions as F
    from tillpoint.operators import checkout as module
    reqs = spark.range(1, 7).select(F.col("id").alias("cart_id"), F.to_timestamp_ntz(F.lit("2024-01-01 10:00:00")).alias("requested_at"),
                                    F.lit("pending").alias("status"), F.lit("paid").alias("payment_status"), F.lit("cash").alias("payment_method"))
    one = decimal.Decimal("1.00")
    items = spark.createDataFrame([(1, 1, 10, 4, one), (2, 1, 10, 1, one), (2, 2, 11, 9, one), (3, 1, 10, 3, one), (3, 2, 10, 3, one),
                                   (4, 1, 11, 2, one), (5, 1, 10, 2, one), (6, 1, 10, 1, one)],
                                  "cart_id long, pos int, product_id long, quantity int, unit_price decimal(10,2)")
    dealt, in_ranges = [], module.in_ranges
    monkeypatch.setattr(module, "in_ranges", lambda df, *a: dealt.append(df.count()) or in_ranges(df, *a))
    r = module.checkout(reqs, items, spark.createDataFrame([(10, 5), (11, 5)], "id long, quantity int"))
    no = "Insufficient stock for product ID "
    assert {x.cart_id: (x.http_code, x.reason) for x in r.decisions.collect()} == {
        1: (201, None), 2: (400, f"{no}11"), 3: (400, f"{no}10"), 4: (201, None), 5: (400, f"{no}10"), 6: (201, None)}
    assert {x.id: x.quantity for x in r.stock.collect()} == {10: 0, 11: 3}
    assert dealt[0] == 4                                  # carts 1, 4, 5 and 6
