"""Sign-up operators against a one-request-at-a-time replay of the reference's handlers."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_ORACLE, SF_SMALL
from tillpoint.operators import identity as I
from tillpoint.sources import bindings as B


def replay_verification(sf_dir, as_of=B.LEDGER_AS_OF, lifetime=dt.timedelta(days=1)):
    ev = pd.read_parquet(f"{sf_dir}/events.parquet")
    ev = ev[(ev.ts <= pd.Timestamp(as_of)) & ev.event_type.isin(["signup", "click"])]
    # an issue and an attempt at the same instant: the issue is written first
    ev = ev.assign(_o=(ev.event_type == "click").astype(int)).sort_values(["ts", "_o", "event_id"])
    rows, out = {}, {}
    for r in ev.itertuples():
        email, code = f"u{r.user_id}", str(r.event_id % 3)
        if r.event_type == "signup":          # DELETE + INSERT ... ON CONFLICT: fresh row, flag reset
            rows[email] = {"code": code, "expires": r.ts + lifetime, "verified": False}
            continue
        row = rows.get(email)
        if row is None:
            out[r.event_id] = "unknown"
        elif row["verified"]:
            out[r.event_id] = "already_verified"
        elif r.ts > row["expires"]:
            out[r.event_id] = "expired"
        elif row["code"] != code:
            out[r.event_id] = "wrong_code"
        else:
            out[r.event_id] = "ok"
            row["verified"] = True
    return out


@pytest.mark.parametrize("sf_dir", [SF_SMALL, SF_ORACLE])
def test_verification_matches_sequential_handler(spark, sf_dir):
    got = {r.attempt_id: r.outcome for r in
           I.verification_outcome(B.code_issues(spark, sf_dir), B.code_attempts(spark, sf_dir)).collect()}
    want = replay_verification(sf_dir)
    assert got == want
    assert set(want.values()) == set(I.OUTCOMES) or sf_dir == SF_SMALL


def test_verification_with_fine_buckets(spark):
    """Ranges that cut e-mails give the same outcomes."""
    a = I.verification_outcome(B.code_issues(spark, SF_SMALL), B.code_attempts(spark, SF_SMALL))
    b = I.verification_outcome(B.code_issues(spark, SF_SMALL), B.code_attempts(spark, SF_SMALL), ranges=40)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_ttl_and_phone_patch_modes(spark):
    rows = spark.createDataFrame([("a", "111", True), ("b", None, True), ("c", "333", True)],
                                 "email string, phone string, is_phone_verified boolean")
    patches = spark.createDataFrame([(1, "a", "999"), (2, "b", "888"), (3, "c", "333"), (4, "a", "777")],
                                    "request_id long, email string, phone string")
    def run(mode):
        return {r.email: (r.phone, r.is_phone_verified) for r in I.phone_patch(rows, patches, mode).collect()}
    assert run("overwrite") == {"a": ("777", False), "b": ("888", False), "c": ("333", False)}
    assert run("coalesce") == {"a": ("111", False), "b": ("888", False), "c": ("333", False)}
    assert run("match") == {"a": ("111", True), "b": (None, True), "c": ("333", False)}
    issues = spark.createDataFrame([(dt.datetime(2024, 1, 24, 15, 19),), (dt.datetime(2024, 1, 24, 15, 25),)],
                                   "created_at timestamp_ntz")
    assert I.ttl_purge(issues, "2024-01-24 15:30:00").count() == 1
    _ = F
