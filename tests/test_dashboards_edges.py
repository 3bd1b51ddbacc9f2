"""Dashboards at the edge as-of dates of FIXTURES.md vs the DuckDB oracle, plus identities."""

import pytest

from tests.conftest import SF_ORACLE
from tests.test_oracle import _key, _norm
from tillpoint.functions.timefn import GROUP_BY_VALUES
from tillpoint.operators import dashboards as D
from tillpoint.plans import oracle as O
from tillpoint.sources.bindings import ledger_binding

# no rows today; only last week; a first week without a predecessor
EDGE_AS_OF = ["2024-03-01 12:00:00", "2024-02-05 09:00:00", "2024-01-03 08:15:00"]

CASES = [
    ("income_today", D.income_today, O.income_today_sql, {}),
    ("expense_today", D.expense_today, O.expense_today_sql, {}),
    ("orders_today", D.orders_today, O.orders_today_sql, {}),
    ("income_pct_change", D.income_pct_change, O.income_pct_change_sql, {}),
    ("expense_weekly_change", D.expense_weekly_change, O.expense_weekly_change_sql, {}),
    ("orders_weekly_change", D.orders_weekly_change, O.orders_weekly_change_sql, {}),
    ("profit_pct_change", D.profit_pct_change, O.profit_pct_change_sql, {}),
    ("summary", D.summary, O.summary_sql, {}),
] + [(f"profit_by_period_{g}", D.profit_by_period, O.profit_by_period_sql, {"group_by": g})
     for g in GROUP_BY_VALUES] + [(f"orders_by_period_{g}", D.orders_by_period, O.orders_by_period_sql,
                                   {"group_by": g}) for g in GROUP_BY_VALUES]


@pytest.mark.parametrize("as_of", EDGE_AS_OF)
@pytest.mark.parametrize("name,op,sql,kw", CASES, ids=[c[0] for c in CASES])
def test_dashboard_edges(spark, duck, as_of, name, op, sql, kw):
    led = ledger_binding(spark, SF_ORACLE, as_of=as_of)
    df = op(led, **kw)
    got = sorted((tuple(_norm(x) for x in r) for r in df.collect()), key=_key)
    q = sql(kw["group_by"], as_of) if "group_by" in kw else sql(as_of)
    res = duck.execute(q)
    dcols = [c[0] for c in res.description]
    idx = [dcols.index(c) for c in df.columns]
    want = sorted((tuple(_norm(r[i]) for i in idx) for r in res.fetchall()), key=_key)
    assert got == want


def test_profit_series_sums_to_income_minus_expense(spark):
    led = ledger_binding(spark, SF_ORACLE)
    for g in GROUP_BY_VALUES:
        rows = D.profit_by_period(led, g).collect()
        assert abs(sum(r.total_profit for r in rows)
                   - (sum(r.total_income for r in rows) - sum(r.total_expense for r in rows))) < 1e-6


def test_tenant_totals_add_up_to_global(spark):
    led = ledger_binding(spark, SF_ORACLE)
    g = D.summary(led).collect()[0]
    t = D.summary(led, by_tenant=True).collect()
    assert abs(sum(r.income_total for r in t) - g.income_total) < 1e-6
    assert abs(sum(r.expense_total for r in t) - g.expense_total) < 1e-6
    assert sum(r.orders_total for r in t) == g.orders_total
    w = D.profit_by_period(led, "week", by_tenant=True).collect()
    assert len(w) == 7 * len({r.client_id for r in w})


def test_week_gap_positional_vs_calendar(spark):
    """D3 pairs the newest week with the next *existing* week; D12a with the calendar week."""
    import datetime as dt
    import decimal
    from pyspark.sql import functions as F
    from tillpoint.sources.bindings import Ledger
    mk = lambda rows, schema: spark.createDataFrame(rows, schema)
    bills = mk([(1, 1, decimal.Decimal("100.00"), "paid", "cash", dt.datetime(2024, 1, 22, 9), 0),
                (2, 2, decimal.Decimal("50.00"), "paid", "cash", dt.datetime(2024, 1, 10, 18), 0)],
               "bill_id long, cart_id long, total_amount decimal(10,2), payment_status string, "
               "payment_method string, generated_at timestamp_ntz, client_id int")
    empty_web = bills.limit(0).withColumnRenamed("bill_id", "web_bill_id").withColumnRenamed("cart_id", "order_id")
    inc = mk([], "id long, type string, description string, amount decimal(10,2), payment_method string, "
                 "income_date date, created_at timestamp_ntz, client_id int")
    exp = inc.withColumnRenamed("income_date", "expense_date")
    orders = mk([], "order_id long, user_id long, total_price decimal(10,2), status string, "
                    "created_at timestamp_ntz, client_id int")
    led = Ledger(bills, empty_web, inc, exp, orders, "2024-01-24 15:30:00")
    assert D.income_pct_change(led).collect()[0].percent_change == 100.0   # 100 vs 50 two weeks ago
    assert D.summary(led).collect()[0].income_percent_change == 100.0       # last calendar week = 0 -> 100 rule
    assert D.expense_weekly_change(led).collect()[0].percent_change == 0.0  # no expense row this week
    _ = F
