"""Registered per-tenant dashboards (A13), profile / lookup reads (P14, P16, P17),
phone patch (M26), job posting (M16) and the document register (S7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillpoint.functions.timefn import ntz
from tillpoint.operators import dashboards as D
from tillpoint.operators import identity as I
from tillpoint.operators import mutations as M
from tillpoint.operators import reports as R
from tillpoint.session import ensure_session_defaults
from tillpoint.sources import bindings as B


def _led(spark, sf_dir):
    ensure_session_defaults(spark)
    return B.ledger_binding(spark, sf_dir)


def _c(spark, sf_dir):
    ensure_session_defaults(spark)
    return B.commerce_binding(spark, sf_dir)


def q_tenant_income(spark, sf_dir):
    """A13 / D1 per tenant: today's income of every tenant with income today."""
    return D.income_today(_led(spark, sf_dir), by_tenant=True)


def q_income_pct_change_by_tenant(spark, sf_dir):
    """A13 / D3 per tenant (positional pairing inside each tenant)."""
    return D.income_pct_change(_led(spark, sf_dir), by_tenant=True)


def q_profit_by_period_week_by_tenant(spark, sf_dir):
    """A13 / D10 per tenant: a gap-free 7-day calendar for every tenant."""
    return D.profit_by_period(_led(spark, sf_dir), "week", by_tenant=True)


def q_orders_by_period_day_by_tenant(spark, sf_dir):
    """A13 / D9 per tenant: 25 hourly buckets for every tenant."""
    return D.orders_by_period(_led(spark, sf_dir), "day", by_tenant=True)


def q_client_profile(spark, sf_dir):
    """P16 + P14: client profiles without the password hash."""
    return R.client_profile(_c(spark, sf_dir).clients)


def q_email_lookup(spark, sf_dir):
    """Is the e-mail of each request a registered user?  (a third are unknown)"""
    c = _c(spark, sf_dir)
    o = c._t("orders", ["o_orderkey", "o_custkey"])
    k = F.col("o_custkey") + (F.col("o_orderkey") % 3) * 100000
    req = o.select(F.col("o_orderkey").alias("request_id"),
                   F.concat(F.lit("customer#"), F.lpad(k.cast("string"), 9, "0"), F.lit("@example.com")).alias("email"))
    return R.lookup_by_email(req, c.users)


def q_phone_patch(spark, sf_dir):
    """M26 (job-user form): phone patches keep an existing phone (COALESCE) and reset the flag."""
    ensure_session_defaults(spark)
    issues = B.code_issues(spark, sf_dir)
    rows = I.keep_latest(issues, "email", ["created_at", "issue_id"]).select(
        "email", "issue_id", F.when(F.col("issue_id") % 2 == 1, F.concat(F.lit("p-"), F.col("issue_id").cast("string")))
        .alias("phone"), F.lit(True).alias("is_phone_verified"))
    ev = (B.read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
          .filter((F.col("ts") <= ntz(B.LEDGER_AS_OF)) & (F.col("event_type") == "view")))
    patches = ev.select(F.col("event_id").alias("request_id"),
                        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("email"),
                        F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("phone"))
    return I.phone_patch(rows, patches, mode="coalesce")


def q_list_jobs(spark, sf_dir):
    """One job posting per part; postings with an empty brand are refused."""
    c = _c(spark, sf_dir)
    p = c._t("part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    k = F.col("p_partkey")
    req = p.select(k.alias("request_id"), (k % 25).cast("int").alias("client_id"), F.col("p_name").alias("jobtitle"),
                   F.concat(F.lit("Work on "), F.col("p_type")).alias("description"),
                   F.concat(F.lit("City "), (F.col("p_size") % 10).cast("string")).alias("location"),
                   F.concat(F.col("p_size").cast("string"), F.lit("00/month")).alias("salary"),
                   F.lit("Acme").alias("company_name"),
                   F.when(F.col("p_brand").endswith("3"), F.lit("")).otherwise(F.col("p_brand")).alias("quali_1"),
                   F.col("p_type").alias("quali_2"), F.lit("Full-time").alias("type"), F.lit("Onsite").alias("work_type"))
    return M.list_jobs(req).outcome


def q_documents_register(spark, sf_dir):
    """Every tenth document is uploaded again at as_of; the full list, newest first."""
    c = _c(spark, sf_dir)
    d = c._t("documents", ["doc_id", "lang", "source"]).filter(F.col("doc_id") % 10 == 0)
    up = d.select((F.col("doc_id") + 10_000_000).alias("request_id"),
                  F.concat(F.lit("upload/"), F.col("doc_id").cast("string")).alias("file_url"),
                  F.col("lang").alias("description"))
    return R.register_documents(c.documents, up, ntz("2024-01-24 15:30:00"))


EXTRA_QUERIES = {
    "tenant_income": q_tenant_income,
    "income_pct_change_by_tenant": q_income_pct_change_by_tenant,
    "profit_by_period_week_by_tenant": q_profit_by_period_week_by_tenant,
    "orders_by_period_day_by_tenant": q_orders_by_period_day_by_tenant,
    "client_profile": q_client_profile,
    "email_lookup": q_email_lookup,
    "phone_patch": q_phone_patch,
    "list_jobs": q_list_jobs,
    "documents_register": q_documents_register,
}
