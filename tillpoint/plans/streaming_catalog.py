"""Registered batch equivalents of the streaming jobs X1-X3 (same builders, static input)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillpoint.session import ensure_session_defaults
from tillpoint.sources import bindings as B
from tillpoint.streaming import audit_log_stream, code_match, revenue_hourly


def q_revenue_stream_hourly(spark, sf_dir):
    """Paid bills and web bills per event-time hour (binding E)."""
    ensure_session_defaults(spark)
    led = B.ledger_binding(spark, sf_dir)
    cols = ["generated_at", "total_amount", "payment_status"]
    bills = led.bills.select(*cols).unionByName(led.web_bills.select(*cols))
    return revenue_hourly(bills)


def q_code_match_stream(spark, sf_dir):
    """Code attempts matched to an issue of the same e-mail and code within the binding's lifetime."""
    ensure_session_defaults(spark)
    issues = B.code_issues(spark, sf_dir)
    attempts = B.code_attempts(spark, sf_dir)
    return code_match(issues, attempts, lifetime=B.CODE_LIFETIME_E, watermark=B.CODE_LIFETIME_E)


def q_audit_stream(spark, sf_dir):
    """Payable log rows from change records (INSERT / UPDATE log new, DELETE logs old values)."""
    ensure_session_defaults(spark)
    ch = B.payable_changes(B.commerce_binding(spark, sf_dir))
    return audit_log_stream(ch).withColumn("amount", F.col("amount").cast("double"))


STREAMING_QUERIES = {
    "revenue_stream_hourly": q_revenue_stream_hourly,
    "code_match_stream": q_code_match_stream,
    "audit_stream": q_audit_stream,
}
