"""Registered data-quality jobs (Q1-Q7) over the commerce tables and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillpoint.operators import quality as Q
from tillpoint.session import ensure_session_defaults
from tillpoint.sources.bindings import commerce_binding, ledger_binding


def domain_tables(spark, sf_dir) -> dict:
    """The tenant schema's tables from binding C plus the manual ledger from binding E."""
    ensure_session_defaults(spark)
    c = commerce_binding(spark, sf_dir)
    led = ledger_binding(spark, sf_dir)
    return {
        "users": c.users, "products": c.products, "category": c.category, "employees": c.employees,
        "salaries": c.salaries, "cart": c.cart, "cart_item": c.cart_item, "bills": c.bills, "orders": c.orders,
        "order_item": c.order_item, "web_bills": c.web_bills, "documents": c.documents,
        "accounts_payable": c.accounts_payable, "accounts_receivable": c.accounts_receivable,
        "clients": c.clients, "man_expenses": led.man_expenses, "man_incomes": led.man_incomes,
    }


def _rows(kind):
    def run(spark, sf_dir):
        return Q.check_rows(domain_tables(spark, sf_dir), (kind,))
    run.__doc__ = f"Row-level {kind} violations over every table."
    return run


def q_unique(spark, sf_dir):
    return Q.unique_violations(domain_tables(spark, sf_dir))


def q_fk(spark, sf_dir):
    return Q.fk_violations(domain_tables(spark, sf_dir))


def q_report(spark, sf_dir):
    return Q.quality_report(domain_tables(spark, sf_dir))


def q_cascade(spark, sf_dir):
    """Soft-deleted products hard-deleted: the cart and order items that cascade."""
    t = domain_tables(spark, sf_dir)
    deleted = t["products"].filter(F.col("deleted")).select("id")
    return Q.cascade_delete(t, "products", deleted)


QUALITY_QUERIES = {
    "quality_nulls": _rows("not_null"),
    "quality_checks": _rows("check"),
    "quality_enum": _rows("enum"),
    "quality_length": _rows("length"),
    "quality_unique": q_unique,
    "quality_fk": q_fk,
    "quality_report": q_report,
    "cascade_delete": q_cascade,
}
