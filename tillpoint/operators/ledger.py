"""Ledger unions: U1 (revenue union) and U2 (tagged manual transactions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillpoint.sources.bindings import Ledger


def is_paid(status_col: str = "payment_status"):
    """Paid bill test.  The reference compares with 'paid' while web bills
    store 'Paid' (defect B1); the comparison is case-insensitive here."""
    return F.lower(F.col(status_col)) == F.lit("paid")


def income_ledger(led: Ledger, exclude_sale_rows: bool = False) -> DataFrame:
    """Paid bills + paid web bills + manual incomes as (client_id, period, total_amount).

    ``income_date`` is a DATE and is widened to a timestamp at midnight, as in
    the reference's UNION ALL.  Sales are written both as bills and as manual
    'Sale' incomes (defect B2); ``exclude_sale_rows`` drops the manual copies.
    Filters placed above the union are pushed into every branch by Catalyst.
    """
    bills = led.bills.filter(is_paid()).select(
        "client_id", F.col("generated_at").alias("period"), "total_amount")
    web = led.web_bills.filter(is_paid()).select(
        "client_id", F.col("generated_at").alias("period"), "total_amount")
    inc = led.man_incomes
    if exclude_sale_rows:
        inc = inc.filter(F.col("type") != F.lit("Sale"))
    inc = inc.select("client_id", F.col("income_date").cast("timestamp_ntz").alias("period"),
                     F.col("amount").alias("total_amount"))
    return bills.unionByName(web).unionByName(inc)


def manual_transactions(led: Ledger) -> DataFrame:
    """Manual incomes and expenses as one list, newest date first."""
    inc = led.man_incomes.select("client_id", "id", "description", "amount",
                                 F.col("income_date").alias("date"), F.lit("income").alias("type"))
    exp = led.man_expenses.select("client_id", "id", "description", "amount",
                                  F.col("expense_date").alias("date"), F.lit("expense").alias("type"))
    return inc.unionByName(exp).select(
        "client_id", "id", "description", F.col("amount").cast("double").alias("amount"), "date", "type"
    ).orderBy(F.col("date").desc_nulls_first(), F.col("type"), F.col("id"))
