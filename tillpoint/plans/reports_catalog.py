"""Registered report queries over binding C (and binding E for manual transactions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillpoint.functions.nesting import nested_text
from tillpoint.operators import jobboard as JB
from tillpoint.operators import ledger as L
from tillpoint.operators import reports as R
from tillpoint.session import ensure_session_defaults
from tillpoint.sources.bindings import commerce_binding, host_requests, ledger_binding


def _c(spark: SparkSession, sf_dir: str):
    ensure_session_defaults(spark)
    return commerce_binding(spark, sf_dir)


def _products_out(df: DataFrame) -> DataFrame:
    return df.withColumn("price", F.col("price").cast("double"))


def q_products_pos(spark, sf_dir):
    return _products_out(R.products_pos(_c(spark, sf_dir).products))


def q_products_web(spark, sf_dir):
    return _products_out(R.products_web(_c(spark, sf_dir).products))


def q_products_ecom(spark, sf_dir):
    return _products_out(R.products_ecom(_c(spark, sf_dir).products))


def q_products_live(spark, sf_dir):
    return _products_out(R.products_live(_c(spark, sf_dir).products))


def q_category_counts(spark, sf_dir):
    c = _c(spark, sf_dir)
    return R.category_counts(c.category, c.products)


def _text(df: DataFrame, col: str, fields: list[str], count_name: str) -> DataFrame:
    """Registered form of a nested report: the list as canonical text plus its length."""
    return df.withColumn(count_name, F.size(col).cast("long")).withColumn(col, nested_text(col, fields))


def q_pos_bills_nested(spark, sf_dir):
    c = _c(spark, sf_dir)
    return _text(R.pos_bills_nested(c.bills, c.cart_item, c.products), "products", R.PRODUCT_FIELDS, "n_products")


def q_web_bills_nested(spark, sf_dir):
    c = _c(spark, sf_dir)
    return _text(R.web_bills_nested(c.web_bills, c.order_item, c.products), "products", R.PRODUCT_FIELDS,
                 "n_products")


def q_orders_nested(spark, sf_dir):
    c = _c(spark, sf_dir)
    out = R.orders_nested(c.orders, c.users, c.web_bills, c.order_item, c.products)
    return _text(out, "items", R.ORDER_ITEM_FIELDS, "n_items")


def q_accounts(spark, sf_dir):
    c = _c(spark, sf_dir)
    return R.accounts_tagged(c.accounts_payable, c.accounts_receivable)


def q_salary_register(spark, sf_dir):
    c = _c(spark, sf_dir)
    return R.salary_register(c.salaries, c.employees)


def q_employee_register(spark, sf_dir):
    return R.employee_register(_c(spark, sf_dir).employees)


def q_documents_list(spark, sf_dir):
    return R.documents_list(_c(spark, sf_dir).documents)


def q_manual_transactions(spark, sf_dir):
    ensure_session_defaults(spark)
    return L.manual_transactions(ledger_binding(spark, sf_dir))


def q_open_jobs_for_users(spark, sf_dir):
    c = _c(spark, sf_dir)
    return R.open_jobs_for(c.job_user, c.job_list, c.job_apply)


def applications_with_gaps(c):
    """Applications; those to every 499th job have lost their job (NULL)."""
    return c.job_apply.select("job_user_id", F.when(F.col("job_id") % 499 != 0, F.col("job_id")).alias("job_id"))


def q_open_job_bits(spark, sf_dir):
    """Every user's open jobs, as bitmaps by chunk beside the shared one."""
    c = _c(spark, sf_dir)
    found = JB.open_job_bits(c.job_list, applications_with_gaps(c))
    return found.select("job_user_id", "chunk", F.coalesce(JB.n_jobs(F.col("words")), F.lit(0)).alias("n_open"),
                        F.coalesce(JB.hex_words(F.col("words")), F.lit("")).alias("open_jobs"))


def q_applied_jobs(spark, sf_dir):
    c = _c(spark, sf_dir)
    return R.applied_jobs(c.job_apply, c.job_user, c.job_list)


APPLICANT_TEXT = ["job_apply_id", "job_user_id", "status", "job_user_name", "email"]


def q_jobs_with_applicants(spark, sf_dir):
    c = _c(spark, sf_dir)
    out = R.jobs_with_applicants(c.job_list, c.job_apply, c.job_user)
    return _text(out, "applicants", APPLICANT_TEXT, "n_applicants")


def q_tenant_resolution(spark, sf_dir):
    c = _c(spark, sf_dir)
    return R.resolve_tenant(host_requests(c).select("request_id", "host"), c.clients)


def q_store_info(spark, sf_dir):
    c = _c(spark, sf_dir)
    return R.store_info(host_requests(c).select("request_id", "subdomain"), c.clients)


REPORT_QUERIES = {
    "products_pos": q_products_pos,
    "products_web": q_products_web,
    "products_ecom": q_products_ecom,
    "products_live": q_products_live,
    "category_counts": q_category_counts,
    "pos_bills_nested": q_pos_bills_nested,
    "web_bills_nested": q_web_bills_nested,
    "orders_nested": q_orders_nested,
    "manual_transactions": q_manual_transactions,
    "accounts": q_accounts,
    "salary_register": q_salary_register,
    "employee_register": q_employee_register,
    "documents_list": q_documents_list,
    "open_jobs_for_users": q_open_jobs_for_users,
    "open_job_bits": q_open_job_bits,
    "applied_jobs": q_applied_jobs,
    "jobs_with_applicants": q_jobs_with_applicants,
    "tenant_resolution": q_tenant_resolution,
    "store_info": q_store_info,
}
