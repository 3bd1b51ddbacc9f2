"""Data-quality jobs on a fixture with every kind of violation."""

import decimal

from tillpoint.operators import quality as Q
from tillpoint.session import ensure_session_defaults

D = decimal.Decimal


def test_row_checks_unique_fk_cascade(spark):
    products = spark.createDataFrame(
        [(1, "a", D("1.00"), 1, "B1", "c", "Active", "Online"),
         (2, None, D("-1.00"), -3, "B1", "c", "x" * 21, "Online"),
         (3, "c", None, 0, None, "c", "Active", "Online")],
        "id long, name string, price decimal(10,2), quantity int, barcode string, category string, "
        "status string, type string")
    items = spark.createDataFrame([(10, 5, 1, 1, D("1.00")), (11, 5, 9, 0, D("1.00")), (12, 6, None, 2, D("1.00"))],
                                  "cart_item_id long, cart_id long, product_id long, quantity int, unit_price decimal(10,2)")
    cart = spark.createDataFrame([(5, D("3.00"), "pending"), (6, D("1.00"), "lost")],
                                 "cart_id long, total_price decimal(10,2), status string")
    t = {"products": products, "cart_item": items, "cart": cart}
    got = {(r.table_name, r.check_name, r.column_name, r.row_key) for r in Q.quality_report(t).collect()}
    assert ("products", "not_null", "name", "2") in got
    assert ("products", "not_null", "price", "3") in got and ("products", "not_null", "barcode", "3") in got
    assert ("products", ">= 0", "price", "2") in got and ("products", ">= 0", "quantity", "2") in got
    assert ("products", ">= 0", "price", "3") not in got            # NULL passes CHECK
    assert ("products", "length <= 20", "status", "2") in got
    assert ("products", "unique", "barcode", "B1") in got
    assert ("cart_item", "> 0", "quantity", "11") in got
    assert ("cart_item", "fk products.id", "product_id", "11") in got
    assert ("cart_item", "fk products.id", "product_id", "12") not in got   # NULL FK passes
    assert ("cart", "enum", "status", "6") in got
    casc = Q.cascade_delete(t, "products", products.filter("id = 1").select("id")).collect()
    assert [(r.table_name, r.row_key, r.check_name) for r in casc] == [("cart_item", "10", "cascade")]


def test_audit_log_replay_reproduces_new_snapshot(spark):
    from tests.conftest import SF_SMALL
    from tillpoint.operators import audit as A
    from tillpoint.sources.bindings import commerce_binding
    before, after = commerce_binding(spark, SF_SMALL).account_snapshots("payable")
    log = A.audit_payable(before, after)
    cols = A.PAYABLE_LOG_COLUMNS
    rebuilt = A.replay_log(before, log, "id", "payable_id", cols)
    key = ["id", *cols]
    assert sorted(map(tuple, rebuilt.select(*key).collect())) == sorted(map(tuple, after.select(*key).collect()))
    ops = {r.operation_type for r in log.select("operation_type").distinct().collect()}
    assert ops == {"INSERT", "UPDATE", "DELETE"}


def test_shuffled_keys_are_not_put_together_by_compressed_size(spark):
    """Keys compress well: Spark's default of 64 MB shuffled is more than 1 GB in a task (quality_fk on 36 million lines)."""
    ensure_session_defaults(spark)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "8m"
