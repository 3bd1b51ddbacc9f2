"""Registered audit-log queries over binding C account snapshots."""

from __future__ import annotations

from tillpoint.operators import audit as A
from tillpoint.session import ensure_session_defaults
from tillpoint.sources.bindings import commerce_binding


def _snaps(spark, sf_dir, kind):
    ensure_session_defaults(spark)
    return commerce_binding(spark, sf_dir).account_snapshots(kind)


def q_audit_payable(spark, sf_dir):
    return A.audit_payable(*_snaps(spark, sf_dir, "payable"))


def q_audit_receivable(spark, sf_dir):
    return A.audit_receivable(*_snaps(spark, sf_dir, "receivable"))


AUDIT_QUERIES = {"audit_payable": q_audit_payable, "audit_receivable": q_audit_receivable}
