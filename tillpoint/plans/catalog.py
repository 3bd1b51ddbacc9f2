"""The registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each entry reads the driver's test tables through a binding (FIXTURES.md) and
runs one library operator over the whole tables.  ``ORACLE`` holds the DuckDB
SQL for the same names where the result is SQL-expressible.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillpoint.functions.timefn import GROUP_BY_VALUES
from tillpoint.operators import dashboards as D
from tillpoint.plans import oracle as O
from tillpoint.session import ensure_session_defaults
from tillpoint.sources.bindings import ledger_binding
from tillpoint.plans.reports_catalog import REPORT_QUERIES
from tillpoint.plans.quality_catalog import QUALITY_QUERIES
from tillpoint.plans.identity_catalog import IDENTITY_QUERIES
from tillpoint.plans.audit_catalog import AUDIT_QUERIES
from tillpoint.plans.checkout_catalog import CHECKOUT_QUERIES
from tillpoint.plans.mutations_catalog import MUTATION_QUERIES
from tillpoint.plans.sequential_catalog import SEQUENTIAL_QUERIES
from tillpoint.plans.sequential_oracle import sequential_sql
from tillpoint.plans.checkout_oracle import checkout_sql
from tillpoint.plans.streaming_catalog import STREAMING_QUERIES
from tillpoint.plans.extras_catalog import EXTRA_QUERIES

Query = Callable[[SparkSession, str], DataFrame]


def _ledger_query(op, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_session_defaults(spark)
        return op(ledger_binding(spark, sf_dir), **kw)
    run.__doc__ = op.__doc__
    return run


def _ledger_queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    for g in GROUP_BY_VALUES:
        q[f"profit_by_period_{g}"] = _ledger_query(D.profit_by_period, group_by=g)
    q["income_today"] = _ledger_query(D.income_today)
    q["expense_today"] = _ledger_query(D.expense_today)
    q["orders_today"] = _ledger_query(D.orders_today)
    for g in GROUP_BY_VALUES:
        q[f"income_by_period_{g}"] = _ledger_query(D.income_by_period, group_by=g)
        q[f"expense_by_period_{g}"] = _ledger_query(D.expense_by_period, group_by=g)
    q["income_pct_change"] = _ledger_query(D.income_pct_change)
    q["expense_weekly_change"] = _ledger_query(D.expense_weekly_change)
    q["orders_weekly_change"] = _ledger_query(D.orders_weekly_change)
    q["profit_pct_change"] = _ledger_query(D.profit_pct_change)
    q["summary"] = _ledger_query(D.summary)
    for g in GROUP_BY_VALUES:
        q[f"orders_by_period_{g}"] = _ledger_query(D.orders_by_period, group_by=g)
    return q


def _ledger_oracle() -> dict[str, str]:
    o: dict[str, str] = {}
    for g in GROUP_BY_VALUES:
        o[f"profit_by_period_{g}"] = O.profit_by_period_sql(g)
        o[f"income_by_period_{g}"] = O.income_by_period_sql(g)
        o[f"expense_by_period_{g}"] = O.expense_by_period_sql(g)
        o[f"orders_by_period_{g}"] = O.orders_by_period_sql(g)
    o["income_today"] = O.income_today_sql()
    o["expense_today"] = O.expense_today_sql()
    o["orders_today"] = O.orders_today_sql()
    o["income_pct_change"] = O.income_pct_change_sql()
    o["expense_weekly_change"] = O.expense_weekly_change_sql()
    o["orders_weekly_change"] = O.orders_weekly_change_sql()
    o["profit_pct_change"] = O.profit_pct_change_sql()
    o["summary"] = O.summary_sql()
    return o


def queries() -> dict[str, Query]:
    q = {}
    q.update(_ledger_queries())
    q.update(REPORT_QUERIES)
    q.update(QUALITY_QUERIES)
    q.update(IDENTITY_QUERIES)
    q.update(AUDIT_QUERIES)
    q.update(CHECKOUT_QUERIES)
    q.update(MUTATION_QUERIES)
    q.update(SEQUENTIAL_QUERIES)
    q.update(STREAMING_QUERIES)
    q.update(EXTRA_QUERIES)
    return q


def oracle_sql() -> dict[str, str]:
    o = {}
    o.update(_ledger_oracle())
    o.update(O.report_sql())
    o.update(O.quality_sql())
    o.update(O.identity_sql())
    o.update(O.audit_sql())
    o.update(O.mutation_sql())
    o.update(sequential_sql())
    o.update(checkout_sql())
    o.update(O.streaming_sql())
    o.update(O.extras_sql())
    return o
