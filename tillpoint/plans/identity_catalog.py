"""Registered sign-up / verification queries over binding E."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tillpoint.functions.timefn import ntz, parse_ts, py_trunc
from tillpoint.operators import identity as I
from tillpoint.session import ensure_session_defaults
from tillpoint.sources import bindings as B


def _outcomes(spark, sf_dir):
    return I.verification_outcome(B.code_issues(spark, sf_dir), B.code_attempts(spark, sf_dir))


def q_verification_outcome(spark, sf_dir):
    ensure_session_defaults(spark)
    return _outcomes(spark, sf_dir)


def q_verification_rows(spark, sf_dir):
    """The verification row written for every issued code."""
    ensure_session_defaults(spark)
    return I.verification_rows(B.code_issues(spark, sf_dir))


def q_ttl_purge(spark, sf_dir):
    """Codes the purge trigger keeps at as_of with the binding's one-day lifetime."""
    ensure_session_defaults(spark)
    return I.ttl_purge(B.code_issues(spark, sf_dir), B.LEDGER_AS_OF, dt.timedelta(days=1))


def q_upsert_latest(spark, sf_dir):
    """Verification rows of last week, overwritten by this week's codes (flag reset)."""
    ensure_session_defaults(spark)
    ws = py_trunc("week", parse_ts(B.LEDGER_AS_OF))
    issues = B.code_issues(spark, sf_dir)
    current = issues.filter(F.col("created_at") < ntz(ws)).withColumn("is_email_verified", F.lit(True))
    incoming = issues.filter(F.col("created_at") >= ntz(ws))
    return I.upsert_latest(current, incoming, "email", ["created_at", "issue_id"],
                           reset={"is_email_verified": False})


def q_account_gate(spark, sf_dir):
    ensure_session_defaults(spark)
    return I.account_gate(B.account_requests(spark, sf_dir), B.code_issues(spark, sf_dir),
                          _outcomes(spark, sf_dir), B.registered_emails(spark, sf_dir))


IDENTITY_QUERIES = {
    "verification_outcome": q_verification_outcome,
    "verification_rows": q_verification_rows,
    "ttl_purge": q_ttl_purge,
    "upsert_latest": q_upsert_latest,
    "account_gate": q_account_gate,
}
