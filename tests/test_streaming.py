"""Streaming jobs X1-X3 run as real streams (file source, availableNow) vs their batch form."""

import os
import tempfile

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tillpoint.sources import bindings as B
from tillpoint.streaming import (audit_log_stream, code_match, revenue_hourly, start_audit_sink,
                                 start_memory_sink)


def _scratch():
    return tempfile.mkdtemp(prefix="tillpoint-stream-", dir="/tmp")


def _write_chunks(df, path, key, n=4):
    """Write ``df`` as ``n`` files in ``key`` order so the stream sees time move forward."""
    rows = df.withColumn("_chunk", F.ntile(n).over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy(key)))
    import time
    now = time.time()
    for i in range(1, n + 1):
        before = set(os.listdir(path)) if os.path.exists(path) else set()
        rows.filter(F.col("_chunk") == i).drop("_chunk").coalesce(1).write.mode("append").parquet(path)
        for f in set(os.listdir(path)) - before:      # arrival order = chunk order for the file source
            os.utime(os.path.join(path, f), (now - 100 + 10 * i, now - 100 + 10 * i))


def test_revenue_hourly_stream_matches_batch_for_closed_windows(spark):
    led = B.ledger_binding(spark, SF_SMALL)
    cols = ["generated_at", "total_amount", "payment_status"]
    bills = led.bills.select(*cols).unionByName(led.web_bills.select(*cols))
    d = _scratch()
    src = os.path.join(d, "bills")
    _write_chunks(bills, src, "generated_at")
    stream = spark.readStream.schema(bills.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = start_memory_sink(revenue_hourly(stream), "rev_hourly", os.path.join(d, "ck"))
    q.awaitTermination(300)
    got = {r.window_start: (r.total_revenue, r.n_bills) for r in spark.table("rev_hourly").collect()}
    want = {r.window_start: (r.total_revenue, r.n_bills) for r in revenue_hourly(bills).collect()}
    assert got, "no window was closed"
    for k, v in got.items():        # every emitted window is final and right
        assert want[k] == v
    # windows well before the last event are all emitted
    last = max(want)
    import datetime as dt
    closed = {k for k in want if k < last - dt.timedelta(hours=2)}
    assert closed <= set(got)


def test_late_rows_are_dropped(spark):
    schema = "generated_at timestamp_ntz, total_amount decimal(10,2), payment_status string"
    d = _scratch()
    src = os.path.join(d, "bills")
    import datetime as dt
    import decimal
    t0 = dt.datetime(2024, 1, 1, 10, 0)
    spark.createDataFrame([(t0, decimal.Decimal("5.00"), "paid")], schema).write.parquet(src + "/a")
    spark.createDataFrame([(t0 + dt.timedelta(hours=5), decimal.Decimal("7.00"), "paid")], schema) \
        .write.parquet(src + "/b")
    spark.createDataFrame([(t0 + dt.timedelta(minutes=30), decimal.Decimal("100.00"), "paid"),   # late
                           (t0 + dt.timedelta(hours=9), decimal.Decimal("1.00"), "paid")], schema) \
        .write.parquet(src + "/c")
    # the file source orders by modification time: make the arrival order explicit
    import time
    now = time.time()
    for i, sub in enumerate("abc"):
        for f in os.listdir(os.path.join(src, sub)):
            os.utime(os.path.join(src, sub, f), (now - 100 + 10 * i, now - 100 + 10 * i))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    q = start_memory_sink(revenue_hourly(stream), "rev_late", os.path.join(d, "ck"))
    q.awaitTermination(300)
    got = {r.window_start: r.total_revenue for r in spark.table("rev_late").collect()}
    assert got.get(t0) == 5.0          # the late 100.00 never reaches the closed 10:00 window


def test_code_match_stream_equals_batch(spark):
    issues = B.code_issues(spark, SF_SMALL)
    attempts = B.code_attempts(spark, SF_SMALL)
    d = _scratch()
    _write_chunks(issues, os.path.join(d, "i"), "created_at")
    _write_chunks(attempts, os.path.join(d, "a"), "attempted_at")
    si = spark.readStream.schema(issues.schema).parquet(os.path.join(d, "i"))
    sa = spark.readStream.schema(attempts.schema).parquet(os.path.join(d, "a"))
    q = start_memory_sink(code_match(si, sa, lifetime="1 day", watermark="1 day"), "codes", os.path.join(d, "ck"))
    q.awaitTermination(300)
    got = sorted((r.attempt_id, r.issue_id) for r in spark.table("codes").collect())
    want = sorted((r.attempt_id, r.issue_id) for r in code_match(issues, attempts, "1 day", "1 day").collect())
    assert got == want and got


def test_audit_sink_is_replay_safe(spark):
    ch = B.payable_changes(B.commerce_binding(spark, SF_SMALL))
    d = _scratch()
    _write_chunks(ch, os.path.join(d, "ch"), "changed_at", n=3)
    stream = spark.readStream.schema(ch.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(d, "ch"))
    out = os.path.join(d, "log")
    start_audit_sink(stream, out, os.path.join(d, "ck")).awaitTermination(300)
    # a restart from the same checkpoint finds nothing new and writes nothing twice
    stream2 = spark.readStream.schema(ch.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(d, "ch"))
    start_audit_sink(stream2, out, os.path.join(d, "ck")).awaitTermination(300)
    got = sorted(tuple(r) for r in spark.read.parquet(out).drop("batch")
                 .select("payable_id", "version", "operation_type", "status").collect())
    want = sorted(tuple(r) for r in audit_log_stream(ch).select("payable_id", "version", "operation_type",
                                                                "status").collect())
    assert got == want
