"""Regression guard on the physical plans of the registered queries."""

from tillpoint.plans import catalog
from tillpoint.plans.sequential_catalog import SEQUENTIAL_QUERIES
from tests.conftest import SF_SMALL
from tools.plan_audit import audit

# these run their allocation rounds, or find the groups of requests that they replay, while the DataFrame is built
EXECUTE_ON_BUILD = {"checkout_pos", "checkout_web", "sale_ledger_rows", "stock_after_checkout",
                    "employee_conflicts", "set_subdomain", "set_subdomain_clients", "patch_employees",
                    "patch_employees_outcome", "update_products", "update_products_outcome",
                    *SEQUENTIAL_QUERIES}


def test_no_cartesian_nested_loop_or_python_in_any_plan(spark):
    bad = {}
    for name, fn in catalog.queries().items():
        if name in EXECUTE_ON_BUILD:
            continue
        plan = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        flags = {f for f in audit(plan)["flags"] if f in ("cartesian", "nested-loop", "python-udf", "pandas-udf")}
        if flags:
            bad[name] = flags
    assert bad == {}
