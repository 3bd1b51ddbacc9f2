"""Registered checkout queries (M1-M3); the SQL is a fold over all carts in order (``checkout_oracle``)."""

from __future__ import annotations

from tillpoint.operators.checkout import checkout
from tillpoint.session import ensure_session_defaults
from tillpoint.sources.bindings import checkout_requests, commerce_binding


def _run(spark, sf_dir, web):
    ensure_session_defaults(spark)
    c = commerce_binding(spark, sf_dir)
    req, items = checkout_requests(c)
    return checkout(req, items, c.products, users=c.users, web=web)


def q_checkout_pos(spark, sf_dir):
    """M1: decision per POS cart (accepted / 404 / 400 / 500) with reason and total."""
    return _run(spark, sf_dir, False).decisions


def q_checkout_web(spark, sf_dir):
    """M2: decision per web order; the buyer is looked up by e-mail first."""
    return _run(spark, sf_dir, True).decisions


def q_sale_ledger_rows(spark, sf_dir):
    """M3: the 'Sale' manual-income rows written for accepted POS carts."""
    return _run(spark, sf_dir, False).incomes


def q_stock_after_checkout(spark, sf_dir):
    """Product stock after every accepted POS cart."""
    return _run(spark, sf_dir, False).stock


def q_cart_totals(spark, sf_dir):
    """The cart total of every checkout request, folded over its item array in decimal.

    The request arrays are rebuilt from the item rows with ``nest`` (a cart
    with very many items arrives as several arrays; their totals are added).
    """
    from pyspark.sql import functions as F
    from tillpoint.functions.money import items_total, money_out
    from tillpoint.functions.nesting import nest_parts
    ensure_session_defaults(spark)
    c = commerce_binding(spark, sf_dir)
    _, items = checkout_requests(c)
    arrays = nest_parts(items.select("cart_id", "product_id", "quantity", "unit_price"), ["cart_id"],
                        ["product_id", "quantity", "unit_price"], "items")
    return (arrays.groupBy("cart_id").agg(F.sum(items_total("items")).alias("_t"), F.sum(F.size("items")).alias("n_items"))
            .select("cart_id", money_out("_t").alias("total_price"), F.col("n_items").cast("long").alias("n_items")))


CHECKOUT_QUERIES = {
    "cart_totals": q_cart_totals,
    "checkout_pos": q_checkout_pos,
    "checkout_web": q_checkout_web,
    "sale_ledger_rows": q_sale_ledger_rows,
    "stock_after_checkout": q_stock_after_checkout,
}
