"""X1 hourly revenue, X2 code issue/attempt matching, X3 audit log from change rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tillpoint.functions.money import MONEY_SUM, money_out
from tillpoint.operators.audit import log_from_changes


def _event_time(c: str):
    # watermarks and event-time windows run on TIMESTAMP; the session zone is UTC
    return F.col(c).cast("timestamp")


def revenue_hourly(bills: DataFrame, time_col: str = "generated_at", watermark: str = "1 hour",
                   by_tenant: bool = False) -> DataFrame:
    """Paid revenue per one-hour event-time window.

    With a streaming input the watermark bounds the state: a window is
    emitted once (append mode) when the watermark passes its end, and rows
    later than the watermark are dropped.  ``bills`` holds
    (time_col, total_amount, payment_status[, client_id]).
    """
    paid = bills.filter(F.lower(F.col("payment_status")) == "paid")
    ev = paid.withColumn("_et", _event_time(time_col)).withWatermark("_et", watermark)
    keys = [F.window("_et", "1 hour")] + ([F.col("client_id")] if by_tenant else [])
    agg = ev.groupBy(*keys).agg(F.sum(F.col("total_amount").cast(MONEY_SUM)).alias("_rev"),
                                F.count(F.lit(1)).alias("n_bills"))
    return agg.select(*(["client_id"] if by_tenant else []),
                      F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window.end").cast("timestamp_ntz").alias("window_end"),
                      money_out("_rev").alias("total_revenue"), "n_bills")


def code_match(issues: DataFrame, attempts: DataFrame, lifetime: str = "10 minutes",
               watermark: str = "10 minutes") -> DataFrame:
    """Attempts matched to an issued code of the same e-mail and value within its lifetime.

    A stream-stream inner join with an event-time range condition and
    watermarks on both sides, so state is kept for one lifetime only.
    issues: (email, issue_id, code, created_at); attempts: (attempt_id, email, code, attempted_at).
    """
    i = (issues.select(F.col("email").alias("i_email"), "issue_id", F.col("code").alias("i_code"),
                       _event_time("created_at").alias("issued_at"))
         .withWatermark("issued_at", watermark))
    a = (attempts.select("attempt_id", "email", "code", _event_time("attempted_at").alias("tried_at"))
         .withWatermark("tried_at", watermark))
    cond = ((F.col("email") == F.col("i_email")) & (F.col("code") == F.col("i_code"))
            & (F.col("tried_at") >= F.col("issued_at"))
            & (F.col("tried_at") <= F.col("issued_at") + F.expr(f"INTERVAL {lifetime}")))
    j = a.join(i, cond, "inner")
    return j.select("attempt_id", "email", "code", "issue_id",
                    F.col("issued_at").cast("timestamp_ntz").alias("issued_at"),
                    F.col("tried_at").cast("timestamp_ntz").alias("attempted_at"))


PAYABLE_COLUMNS = ["account_name", "amount", "payment_date", "payment_method", "status"]


def audit_log_stream(changes: DataFrame, columns=PAYABLE_COLUMNS, key: str = "id",
                     key_alias: str = "payable_id") -> DataFrame:
    """Log rows from a change stream (op, id, version, changed_at, old_*, new_*)."""
    return log_from_changes(changes, key, columns, key_alias)


def start_memory_sink(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a streaming frame once over what is available into an in-memory table (tests, smoke)."""
    return (df.writeStream.format("memory").queryName(name).outputMode(mode)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def start_audit_sink(changes: DataFrame, out_dir: str, checkpoint: str, **kw) -> StreamingQuery:
    """X3 sink: each micro-batch writes its log rows to ``out_dir/batch=<id>`` with overwrite.

    A replayed batch (after a failure) rewrites the same folder, so the log
    holds each (id, version) change once; with the checkpoint this gives
    exactly-once output for a replayable source.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        log = audit_log_stream(batch, **kw)
        log.write.mode("overwrite").parquet(os.path.join(out_dir, f"batch={batch_id}"))

    return (changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
