"""Registered batch-write queries (M4-M19, M25) over binding C.

Request tables are derived from the star schema (rules below, mirrored in
``oracle.mutation_sql``): every request table grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillpoint.functions.money import money_out, to_money
from tillpoint.functions.timefn import date_lit
from tillpoint.operators import identity as I
from tillpoint.operators import mutations as M
from tillpoint.session import ensure_session_defaults
from tillpoint.sources.bindings import (ACCOUNT_METHODS, SALARY_METHODS, _case_mod, commerce_binding)

# Fixed value: the as-of date of binding C's write requests.
COMMERCE_AS_OF_DATE = "2024-01-24"


def _c(spark, sf_dir):
    ensure_session_defaults(spark)
    return commerce_binding(spark, sf_dir)


def _orders(c) -> DataFrame:
    return c._t("orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"])


# ---------------------------------------------------------------- accounts

def account_add_requests(c) -> DataFrame:
    o = _orders(c).filter(F.col("o_orderkey") % 3 == 0)
    k = F.col("o_orderkey")
    return o.select(k.alias("request_id"),
                    F.when(k % 27 == 0, F.lit("")).otherwise(F.concat(F.lit("acct-"), F.col("o_custkey").cast("string")))
                    .alias("account_name"),
                    F.when(k % 9 == 0, F.lit(0).cast("decimal(10,2)")).otherwise(to_money("o_totalprice")).alias("amount"),
                    F.to_date("o_orderdate").alias("payment_date"),
                    _case_mod(k, 4, ACCOUNT_METHODS).alias("payment_method"), F.lit("Pending").alias("status"),
                    F.col("o_orderdate").alias("requested_at"))


def q_add_accounts(spark, sf_dir):
    return M.add_accounts(account_add_requests(_c(spark, sf_dir))).outcome


def _account_updates(c) -> DataFrame:
    r = account_add_requests(c)
    return r.select("request_id", F.col("request_id").alias("id"), "account_name", "amount",
                    F.date_add("payment_date", 30).alias("payment_date"), F.lit("Other").alias("payment_method"),
                    F.lit("Paid").alias("status"))


def _merge(spark, sf_dir):
    c = _c(spark, sf_dir)
    table = c.accounts_payable.drop("created_at")
    return M.update_rows(table, _account_updates(c), "id",
                         ["account_name", "amount", "payment_date", "payment_method", "status"],
                         required_cols=["id", "account_name", "payment_date", "payment_method", "status"],
                         not_found="Payable account not found")


def q_merge_accounts(spark, sf_dir):
    """M6: the payable table after full-row updates by id."""
    return _merge(spark, sf_dir).table.withColumn("amount", money_out("amount"))


def q_merge_accounts_outcome(spark, sf_dir):
    return _merge(spark, sf_dir).outcome


def _delete(spark, sf_dir):
    c = _c(spark, sf_dir)
    req = _orders(c).filter(F.col("o_orderkey") % 7 == 0).select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderkey").alias("id"))
    return M.delete_returning(c.accounts_payable.drop("created_at"), req, "id")


def q_delete_returning(spark, sf_dir):
    """M7: rows returned by DELETE ... RETURNING."""
    return _delete(spark, sf_dir).returned.withColumn("amount", money_out("amount"))


def q_delete_outcome(spark, sf_dir):
    return _delete(spark, sf_dir).outcome


# ---------------------------------------------------------------- manual transactions, salaries

def q_manual_tx_routing(spark, sf_dir):
    """M8: inserted manual transactions with their target table."""
    c = _c(spark, sf_dir)
    k = F.col("o_orderkey")
    req = _orders(c).select(
        k.alias("request_id"), _case_mod(k, 3, ["income", "expense", "other"]).alias("type"),
        F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("tx "), k.cast("string"))).alias("description"),
        to_money("o_totalprice").alias("amount"), F.to_date("o_orderdate").alias("date"))
    out = M.route_manual_transactions(req)
    return out.returned.withColumn("amount", money_out("amount"))


def _salaries(spark, sf_dir):
    c = _c(spark, sf_dir)
    k = F.col("o_orderkey")
    req = _orders(c).select(
        k.alias("request_id"),
        F.when(k % 13 == 0, F.lit(-1).cast("long")).otherwise(F.col("o_custkey") % 100).alias("employee_id"),
        to_money("o_totalprice").alias("salary_amount"),
        F.when(k % 17 == 0, F.lit("bad")).otherwise(F.date_format("o_orderdate", "yyyy-MM")).alias("salary_month"),
        _case_mod(k, 4, SALARY_METHODS).alias("payment_method"),
        F.when(k % 2 == 0, F.to_date("o_orderdate")).alias("payment_date"))
    return M.add_salaries(req, c.employees, date_lit(COMMERCE_AS_OF_DATE))


def q_salary_postings(spark, sf_dir):
    """M4: salary rows inserted by add-salary requests."""
    return _salaries(spark, sf_dir).returned.withColumn("salary_amount", money_out("salary_amount"))


def q_salary_expense_rows(spark, sf_dir):
    """M3/M4: the 'Salary to <name>' expense rows written with each salary."""
    return _salaries(spark, sf_dir).table.withColumn("amount", money_out("amount"))


def q_salary_outcome(spark, sf_dir):
    return _salaries(spark, sf_dir).outcome


# ---------------------------------------------------------------- employees and products

def employee_patches(c) -> DataFrame:
    s = c._t("supplier", ["s_suppkey", "s_acctbal"]).filter(F.col("s_suppkey") % 3 == 0)
    k = F.col("s_suppkey")
    provided = (F.when(k % 4 == 0, F.array(F.lit("position"), F.lit("salary")))
                 .when(k % 4 == 1, F.array(F.lit("email")))
                 .when(k % 4 == 2, F.array().cast("array<string>"))
                 .otherwise(F.array(F.lit("phone"), F.lit("position"))))
    return s.select(k.alias("request_id"), F.when(k % 21 == 0, -k - 1).otherwise(k).alias("id"),
                    provided.alias("provided"), F.lit("Lead").alias("position"),
                    F.abs(to_money("s_acctbal")).alias("salary"),
                    F.concat(F.lit("emp"), (k + 1).cast("string"), F.lit("@staff.example")).alias("email"),
                    F.concat(F.lit("ph-"), (k + 1).cast("string")).alias("phone"))


def _patch(spark, sf_dir):
    c = _c(spark, sf_dir)
    emp = c.employees.select("id", "first_name", "last_name", "email", "phone", "position", "salary",
                             "bank_account_number")
    return M.patch_rows(emp, employee_patches(c), "id", ["position", "salary", "email", "phone"],
                        conflict_keys=["email", "phone"], touch_col=None)


def q_patch_employees(spark, sf_dir):
    """M9: the employee table after partial updates (only provided fields change)."""
    return _patch(spark, sf_dir).table.withColumn("salary", money_out("salary"))


def q_patch_employees_outcome(spark, sf_dir):
    return _patch(spark, sf_dir).outcome


def employee_add_requests(c) -> DataFrame:
    cu = c._t("customer", ["c_custkey", "c_name"])
    k = F.col("c_custkey")
    return cu.select(k.alias("request_id"), F.lit("New").alias("first_name"), F.col("c_name").alias("last_name"),
                     F.concat(F.lit("emp"), (k % 150).cast("string"), F.lit("@staff.example")).alias("email"),
                     F.concat(F.lit("ph-"), (k % 170 + 1000).cast("string")).alias("phone"),
                     F.lit("Clerk").alias("position"), F.lit(1000).cast("decimal(10,2)").alias("salary"),
                     F.lit("Bank 1").alias("bank_name"),
                     F.concat(F.lit("AC"), (k % 40).cast("string")).alias("bank_account_number"),
                     F.lit("IFSC0000001").alias("ifsc_code"), F.to_date(F.lit("2024-01-02")).alias("joining_date"))


def q_employee_conflicts(spark, sf_dir):
    """Add-employee decisions with conflict labels (first insert wins in the batch)."""
    c = _c(spark, sf_dir)
    return M.add_employees(employee_add_requests(c), c.employees).outcome


def product_add_requests(c) -> DataFrame:
    p = c._t("part", ["p_partkey", "p_name", "p_type", "p_size", "p_retailprice"])
    k = F.col("p_partkey")
    return p.select(k.alias("request_id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"),
                    F.when(k % 19 == 0, F.lit("x")).otherwise(F.col("p_size").cast("string")).alias("quantity_text"),
                    F.concat(F.lit("BC"), (k % 1000 + 1500).cast("string")).alias("barcode"),
                    to_money("p_retailprice").cast("string").alias("price_text"),
                    _case_mod(k, 4, ["Online", "Offline", "Hybrid", "Digital"]).alias("type"),
                    F.lit("Active").alias("status"))


def q_add_products(spark, sf_dir):
    """Add-product decisions (barcode unique; first request wins)."""
    c = _c(spark, sf_dir)
    return M.add_products(product_add_requests(c), c.products).outcome


def _soft(spark, sf_dir):
    c = _c(spark, sf_dir)
    k = F.col("p_partkey")
    req = c._t("part", ["p_partkey"]).filter(k % 13 == 0).select(
        k.alias("request_id"), F.when(k % 39 == 0, -k - 1).otherwise(k).alias("id"))
    return M.soft_delete_products(c.products.select("id", "name", "status", "deleted"), req)


def q_soft_delete(spark, sf_dir):
    """Products after soft-delete requests."""
    return _soft(spark, sf_dir).table


def q_soft_delete_outcome(spark, sf_dir):
    return _soft(spark, sf_dir).outcome


# ---------------------------------------------------------------- categories

def q_guarded_category_delete(spark, sf_dir):
    """Delete requests for every category id and one unknown id."""
    c = _c(spark, sf_dir)
    cat = c.category
    req = (cat.select(F.col("category_id").alias("request_id"), "category_id")
           .unionByName(cat.agg((F.max("category_id") + 1).alias("category_id"))
                        .select(F.col("category_id").alias("request_id"), "category_id")))
    return M.guarded_delete_category(cat, c.products, req).outcome


def q_add_categories(spark, sf_dir):
    """One add request per brand; brands ending in 0 arrive empty."""
    c = _c(spark, sf_dir)
    p = c._t("part", ["p_partkey", "p_brand", "p_retailprice"])
    req = p.select(F.col("p_partkey").alias("request_id"),
                   F.when(F.col("p_brand").endswith("0"), F.lit("")).otherwise(F.col("p_brand")).alias("category"),
                   F.lit(None).cast("timestamp_ntz").alias("requested_at"))
    return M.add_categories(req).outcome


# ---------------------------------------------------------------- job board

def q_apply_jobs(spark, sf_dir):
    """One application request per order (user = buyer, job = order key mod 2500)."""
    c = _c(spark, sf_dir)
    o = _orders(c)
    req = o.select(F.col("o_orderkey").alias("request_id"), (F.col("o_orderkey") % 2500).alias("job_id"),
                   F.col("o_custkey").alias("job_user_id"),
                   F.concat(F.lit("cv/"), F.col("o_custkey").cast("string")).alias("fileurl"),
                   F.col("o_orderdate").alias("requested_at"))
    return M.apply_jobs(req, c.job_list, c.job_apply).outcome


def q_close_jobs(spark, sf_dir):
    """Close requests for every fifth job; every third names the wrong client."""
    c = _c(spark, sf_dir)
    k = F.col("p_partkey")
    req = c._t("part", ["p_partkey"]).filter(k % 5 == 0).select(
        k.alias("request_id"), k.alias("job_id"),
        F.when(k % 3 == 0, (k + 1) % 25).otherwise(k % 25).cast("int").alias("client_id"))
    return M.close_jobs(c.job_list, req).outcome


def _app_status(spark, sf_dir):
    c = _c(spark, sf_dir)
    ja = c.job_apply
    k = F.col("job_apply_id")
    req = ja.filter(F.col("job_id") % 7 == 0).select(
        (F.col("job_apply_id")).alias("request_id"),
        F.when(F.col("job_id") % 49 == 0, -k).otherwise(k).alias("job_apply_id"),
        _case_mod(F.col("job_user_id"), 3, ["reviewed", "accepted", "hired"]).alias("status"))
    return M.update_application_status(ja.select("job_apply_id", "job_id", "job_user_id", "status"), c.job_list, req)


def q_application_status(spark, sf_dir):
    """Job applications after status updates."""
    return _app_status(spark, sf_dir).table


def q_application_status_outcome(spark, sf_dir):
    return _app_status(spark, sf_dir).outcome


def _order_status(spark, sf_dir):
    c = _c(spark, sf_dir)
    k = F.col("o_orderkey")
    req = _orders(c).filter(k % 4 == 0).select(
        k.alias("request_id"), F.when(k % 16 == 0, -k).otherwise(k).alias("order_id"),
        F.lit("Paid").alias("payment_status"), F.lit("completed").alias("order_status"))
    return M.update_order_status(c.orders.select("order_id", "user_id", "status"),
                                 c.web_bills.select("web_bill_id", "order_id", "payment_status"), req)


def q_order_status(spark, sf_dir):
    """Orders after status updates."""
    return _order_status(spark, sf_dir).table


def q_order_status_bills(spark, sf_dir):
    """Web bills after the same updates."""
    return _order_status(spark, sf_dir).returned


def _subdomains(spark, sf_dir):
    c = _c(spark, sf_dir)
    n = c._t("nation", ["n_nationkey", "n_name"])
    k = F.col("n_nationkey")
    sub = (F.when(k % 3 == 0, F.concat(F.lower("n_name"), F.lit("-shop")))
            .when(k % 3 == 1, F.concat(F.lit("nation_"), ((k + 1) % 25).cast("string")))
            .otherwise(F.lit("shared")))
    req = n.select(k.alias("request_id"), k.alias("client_id"), sub.alias("subdomain"))
    return M.set_subdomains(c.clients.select("client_id", "client_name", "subdomain"), req)


def q_set_subdomain(spark, sf_dir):
    """Subdomain changes with the unique rule."""
    return _subdomains(spark, sf_dir).outcome


def q_set_subdomain_clients(spark, sf_dir):
    return _subdomains(spark, sf_dir).table


def q_register_customers(spark, sf_dir):
    """One shop sign-up per order: the store must exist, the e-mail be new in it."""
    c = _c(spark, sf_dir)
    o = _orders(c)
    req = o.select(F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 30).cast("int").alias("client_id"),
                   F.concat(F.lit("customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"),
                            F.lit("@example.com")).alias("email"))
    return I.register_customers(req, c.clients, c.users)


def _update_products(spark, sf_dir):
    c = _c(spark, sf_dir)
    k = F.col("p_partkey")
    req = c._t("part", ["p_partkey", "p_name", "p_type", "p_size", "p_retailprice"]).filter(k % 11 == 0).select(
        k.alias("request_id"), F.when(k % 33 == 0, -k - 1).otherwise(k).alias("id"),
        F.upper("p_name").alias("name"), F.col("p_type").alias("category"),
        (F.col("p_size") + 10).cast("string").alias("quantity_text"),
        F.concat(F.lit("BC"), k.cast("string")).alias("barcode"),
        (to_money("p_retailprice") + F.lit(1)).cast("decimal(10,2)").cast("string").alias("price_text"),
        F.lit("Hybrid").alias("type"),
        F.when(k % 22 == 0, F.lit("Retired")).otherwise(F.lit("Active")).alias("status"))
    products = c.products.select("id", "name", "category", "quantity", "barcode", "price", "type", "status",
                                 "updated_at")
    from tillpoint.functions.timefn import ntz
    return M.update_products(products, req, ntz("2024-01-24 15:30:00"))


def q_update_products(spark, sf_dir):
    """Products after full updates (updated_at stamped with the as-of time)."""
    return _update_products(spark, sf_dir).table.withColumn("price", money_out("price"))


def q_update_products_outcome(spark, sf_dir):
    return _update_products(spark, sf_dir).outcome


def q_manual_tx_update(spark, sf_dir):
    """M8 (update): manual income / expense updates routed by type (binding E rows, order requests)."""
    from tillpoint.sources.bindings import ledger_binding
    ensure_session_defaults(spark)
    led = ledger_binding(spark, sf_dir)
    c = _c(spark, sf_dir)
    k = F.col("o_orderkey")
    req = _orders(c).filter(k % 7 == 0).select(
        k.alias("request_id"), (k % 10000).alias("id"), _case_mod("o_orderkey", 3, ["income", "expense", "other"])
        .alias("type"), F.concat(F.lit("fix "), k.cast("string")).alias("description"),
        to_money("o_totalprice").alias("amount"), F.to_date("o_orderdate").alias("date"))
    inc = led.man_incomes.select("id", "type", "description", "amount", "income_date")
    exp = led.man_expenses.select("id", "type", "description", "amount", "expense_date")
    return M.update_manual_transactions(inc, exp, req).outcome


MUTATION_QUERIES = {
    "update_products": q_update_products,
    "update_products_outcome": q_update_products_outcome,
    "manual_tx_update": q_manual_tx_update,
    "add_accounts": q_add_accounts,
    "merge_accounts": q_merge_accounts,
    "merge_accounts_outcome": q_merge_accounts_outcome,
    "delete_returning": q_delete_returning,
    "delete_outcome": q_delete_outcome,
    "manual_tx_routing": q_manual_tx_routing,
    "salary_postings": q_salary_postings,
    "salary_expense_rows": q_salary_expense_rows,
    "salary_outcome": q_salary_outcome,
    "patch_employees": q_patch_employees,
    "patch_employees_outcome": q_patch_employees_outcome,
    "employee_conflicts": q_employee_conflicts,
    "add_products": q_add_products,
    "soft_delete": q_soft_delete,
    "soft_delete_outcome": q_soft_delete_outcome,
    "guarded_category_delete": q_guarded_category_delete,
    "add_categories": q_add_categories,
    "apply_jobs": q_apply_jobs,
    "close_jobs": q_close_jobs,
    "application_status": q_application_status,
    "application_status_outcome": q_application_status_outcome,
    "order_status": q_order_status,
    "order_status_bills": q_order_status_bills,
    "set_subdomain": q_set_subdomain,
    "set_subdomain_clients": q_set_subdomain_clients,
    "register_customers": q_register_customers,
}
