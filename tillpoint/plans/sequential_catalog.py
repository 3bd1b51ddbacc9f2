"""Registered queries of batches whose requests hand values over to one another.

Shops are the customers and requests the orders, so that both grow with the
data; names are freed, swapped, saved again and asked for by many.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillpoint.functions.money import to_money
from tillpoint.functions.timefn import ntz
from tillpoint.operators import mutations as M
from tillpoint.plans.mutations_catalog import _c

AS_OF = "2024-01-24 15:30:00"


def _text(prefix: str, c) -> "F.Column":
    return F.concat(F.lit(prefix), c.cast("string"))


def shop_requests(c) -> tuple[DataFrame, DataFrame]:
    """Shops, and requests: a neighbour's name, the first own name, a name of a few, the hot name, none."""
    shops = c._t("customer", ["c_custkey"]).select(F.col("c_custkey").alias("client_id"),
                                                   _text("shop-", F.col("c_custkey")).alias("subdomain"))
    k, o = F.col("o_custkey"), F.col("o_orderkey")
    name = (F.when(o % 6 == 0, _text("shop-", k + 1)).when(o % 6 == 1, _text("shop-", k))
             .when(o % 6 == 2, _text("new-", F.floor(o / 50))).when(o % 6 == 3, F.lit("sale"))
             .when(o % 6 == 4, _text("shop-", k - 1)))
    req = c._t("orders", ["o_orderkey", "o_custkey"]).select(
        o.alias("request_id"), F.when(o % 97 == 0, -k).otherwise(k).alias("client_id"), name.alias("subdomain"))
    return shops, req


def _shops(spark, sf_dir):
    return M.set_subdomains(*shop_requests(_c(spark, sf_dir)))


def q_subdomain_handover(spark, sf_dir):
    """Subdomain changes in order; a name is free again when its client has taken another."""
    return _shops(spark, sf_dir).outcome


def q_subdomain_handover_shops(spark, sf_dir):
    return _shops(spark, sf_dir).table


def employee_requests(c) -> DataFrame:
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    rows = c._t("orders", ["o_orderkey", "o_custkey", "o_totalprice"]).withColumn("id", F.floor(k / 15) + 1)
    fields = F.expr("""CASE o_orderkey % 5 WHEN 0 THEN array('email') WHEN 1 THEN array('phone', 'position')
        WHEN 2 THEN array('email', 'bank_account_number') WHEN 3 THEN array('phone', 'bank_account_number', 'salary')
        ELSE cast(array() as array<string>) END""")
    email = F.when(o % 5 == 0, F.concat(F.lit("emp"), (F.col("id") + o % 3).cast("string"), F.lit("@staff.example")))
    return rows.select(o.alias("request_id"), "id", fields.alias("provided"), email.alias("email"),
                       _text("ph-", F.col("id") + o % 2).alias("phone"),
                       _text("AC", F.col("id") + F.floor(o / 7) % 4).alias("bank_account_number"),
                       F.lit("Lead").alias("position"), to_money("o_totalprice").alias("salary"))


def _employees(spark, sf_dir):
    c = _c(spark, sf_dir)
    table = c.employees.select("id", "email", "phone", "bank_account_number", "position", "salary", "updated_at")
    return M.patch_rows(table, employee_requests(c), "id", ["email", "phone", "bank_account_number", "position", "salary"],
                        conflict_keys=["email", "phone", "bank_account_number"], touch_value=ntz(AS_OF))


def q_employee_handover(spark, sf_dir):
    """Partial updates in order, unique over e-mail, phone and bank account at once."""
    return _employees(spark, sf_dir).outcome


def q_employee_handover_rows(spark, sf_dir):
    """M9: employees after the same updates, updated_at stamped."""
    from tillpoint.functions.money import money_out
    return _employees(spark, sf_dir).table.withColumn("salary", money_out("salary"))


def _products(spark, sf_dir):
    c = _c(spark, sf_dir)
    o, k = F.col("o_orderkey"), F.col("o_custkey")
    req = c._t("orders", ["o_orderkey", "o_custkey", "o_totalprice"]).select(
        o.alias("request_id"), k.alias("id"), _text("Product ", k).alias("name"), F.lit("STANDARD").alias("category"),
        F.when(o % 29 == 0, F.lit("many")).otherwise((o % 100).cast("string")).alias("quantity_text"),
        _text("BC", k + F.floor(o / 8) % 3).alias("barcode"), F.lit("12.50").alias("price_text"),
        F.lit("Hybrid").alias("type"), F.lit("Active").alias("status"))
    products = c.products.select("id", "name", "category", "quantity", "barcode", "price", "type", "status", "updated_at")
    return M.update_products(products, req, ntz(AS_OF))


def q_product_handover(spark, sf_dir):
    """Product updates in order; a barcode that another product holds is refused."""
    return _products(spark, sf_dir).outcome


def q_product_handover_rows(spark, sf_dir):
    return _products(spark, sf_dir).table.select("id", "barcode", "quantity", "updated_at")


SEQUENTIAL_QUERIES = {
    "subdomain_handover": q_subdomain_handover,
    "subdomain_handover_shops": q_subdomain_handover_shops,
    "employee_handover": q_employee_handover,
    "employee_handover_rows": q_employee_handover_rows,
    "product_handover": q_product_handover,
    "product_handover_rows": q_product_handover_rows,
}
