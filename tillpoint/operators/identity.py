"""Sign-up and verification operators: M12 (keep latest code), M22 (time-to-live
purge), M23 (verification outcome), M24 (account creation gate), M25
(customer registration) and M26 (phone patch).

The reference handles one request at a time against a table with one row per
e-mail.  The batch forms take whole tables of issued codes and attempts and
reproduce the sequential result: the code in force at an attempt is the
latest issue at or before it (an as-of lookup), and an issue's first correct,
unexpired attempt verifies it -- every later attempt on that issue is
"already verified".
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tillpoint.functions.ids import name_uuid
from tillpoint.functions.money import apply_defaults
from tillpoint.functions.timefn import ntz, parse_ts
from tillpoint.operators.asof import asof_join

DEFAULT_LIFETIME = dt.timedelta(minutes=10)

# Outcome names of the verification endpoint, in the order the
# reference tests them, and the HTTP codes of the sign-up gate.
OUTCOMES = ["unknown", "already_verified", "expired", "wrong_code", "ok"]
GATE_CODES = {"taken": 409, "unknown": 400, "not_verified": 400, "created": 201}


def ttl_purge(issues: DataFrame, as_of, lifetime: dt.timedelta = DEFAULT_LIFETIME,
              created_col: str = "created_at") -> DataFrame:
    """Rows kept by the purge trigger at ``as_of`` (created_at >= as_of - lifetime)."""
    return issues.filter(F.col(created_col) >= ntz(parse_ts(as_of) - lifetime))


def verification_rows(issues: DataFrame) -> DataFrame:
    """Rows of users_verification for issued codes: a retry-stable id (F19), flags by their column defaults."""
    rows = issues.select(name_uuid("users_verification", F.col("issue_id")).alias("id"), "email",
                         F.col("code").alias("email_otp"), "created_at", "expires_at")
    return apply_defaults(rows, {"is_email_verified": False, "is_phone_verified": False})


def keep_latest(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """The newest row per key by ``order_cols`` (a partially aggregated max_by)."""
    cols = [c for c in df.columns if c != key]
    order = F.struct(*[F.col(c) for c in order_cols])
    g = df.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), order).alias("_v"))
    return g.select(key, *[F.col("_v")[c].alias(c) for c in cols])


def upsert_latest(current: DataFrame, incoming: DataFrame, key: str, order_cols: list[str],
                  reset: dict | None = None) -> DataFrame:
    """One row per key, the newest of (current ∪ incoming) by ``order_cols``.

    ``reset`` sets columns on rows that came from ``incoming`` (the
    ON CONFLICT ... SET is_email_verified = FALSE).  ``max_by`` is a partial
    aggregate, so a key with very many versions is reduced before the shuffle.
    """
    cols = [c for c in current.columns if c != key]
    inc = incoming
    for c, v in (reset or {}).items():
        inc = inc.withColumn(c, F.lit(v))
    u = current.select(key, *cols).unionByName(inc.select(key, *cols))
    return keep_latest(u, key, order_cols)


def verification_outcome(issues: DataFrame, attempts: DataFrame, lifetime: dt.timedelta | None = None,
                         ranges: int | None = None) -> DataFrame:
    """Outcome of every code attempt, evaluated as the reference does sequentially.

    issues:   (email, issue_id, code, created_at[, expires_at])
    attempts: (attempt_id, email, code, attempted_at)
    Rules in order: no code issued yet -> unknown; the governing issue was
    already verified by an earlier attempt -> already_verified; attempt after
    expires_at -> expired; code differs -> wrong_code; else ok.
    """
    if "expires_at" not in issues.columns:
        life = lifetime or DEFAULT_LIFETIME
        issues = issues.withColumn("expires_at", F.col("created_at") + F.make_dt_interval(
            F.lit(life.days), F.lit(0), F.lit(0), F.lit(life.seconds)))
    g = asof_join(attempts, issues.withColumnRenamed("code", "issued_code"), ["email"], "attempted_at",
                  "created_at", ["issue_id", "issued_code", "expires_at"], ["issue_id"],
                  ranges=ranges, name="issue")
    g = g.select("*", F.col("issue.issue_id").alias("issue_id"), F.col("issue.issued_code").alias("issued_code"),
                 F.col("issue.expires_at").alias("expires_at")).drop("issue")
    expired = F.col("attempted_at") > F.col("expires_at")
    wrong = ~F.col("code").eqNullSafe(F.col("issued_code"))
    cand = g.filter(F.col("issue_id").isNotNull() & ~expired & ~wrong)
    first_ok = cand.groupBy("email", "issue_id").agg(
        F.min(F.struct("attempted_at", "attempt_id")).alias("_first"))
    out = g.join(first_ok, ["email", "issue_id"], "left")
    after_first = ((F.col("attempted_at") > F.col("_first.attempted_at"))
                   | ((F.col("attempted_at") == F.col("_first.attempted_at"))
                      & (F.col("attempt_id") > F.col("_first.attempt_id"))))
    outcome = (F.when(F.col("issue_id").isNull(), F.lit("unknown"))
                .when(F.col("_first").isNotNull() & after_first, F.lit("already_verified"))
                .when(expired, F.lit("expired"))
                .when(wrong, F.lit("wrong_code"))
                .otherwise(F.lit("ok")))
    return out.select(*attempts.columns, "issue_id", outcome.alias("outcome"))


def verified_at(outcomes: DataFrame) -> DataFrame:
    """(email, issue_id, verified_at) of every issue that an attempt verified."""
    return (outcomes.filter(F.col("outcome") == "ok")
            .groupBy("email", "issue_id").agg(F.min("attempted_at").alias("verified_at")))


def account_gate(requests: DataFrame, issues: DataFrame, outcomes: DataFrame, taken: DataFrame,
                 phone_verified: Column | None = None, ranges: int | None = None) -> DataFrame:
    """Decide account-creation requests (request_id, email, requested_at).

    Order of checks as in the reference: e-mail already registered -> 409;
    no verification row at the request time -> 400 unknown; e-mail (and
    phone) not verified by then -> 400 not_verified; else 201 created.  Two
    accepted requests for one e-mail: the first wins; any later request for that
    e-mail is 409, because the e-mail test comes first.
    """
    ver = verified_at(outcomes)
    g = asof_join(requests, issues, ["email"], "requested_at", "created_at", ["issue_id"], ["issue_id"],
                  ranges=ranges, name="issue")
    g = g.withColumn("issue_id", F.col("issue.issue_id")).drop("issue")
    g = g.join(ver, ["email", "issue_id"], "left")
    used = taken.select("email").distinct().withColumn("_taken", F.lit(True))
    g = g.join(used, "email", "left")
    ok_email = F.col("verified_at").isNotNull() & (F.col("verified_at") <= F.col("requested_at"))
    ok = ok_email if phone_verified is None else (ok_email & phone_verified)
    decided = g.withColumn("_d", F.when(F.col("_taken").isNotNull(), F.lit("taken"))
                                  .when(F.col("issue_id").isNull(), F.lit("unknown"))
                                  .when(~ok, F.lit("not_verified")).otherwise(F.lit("created")))
    first = (decided.filter(F.col("_d") == "created").groupBy("email")
             .agg(F.min(F.struct("requested_at", "request_id")).alias("_w")))
    out = decided.join(first, "email", "left")
    after = F.col("_w").isNotNull() & (F.struct("requested_at", "request_id") > F.col("_w"))
    decision = F.when(after, F.lit("taken")).otherwise(F.col("_d"))
    code = F.when(decision == "created", 201).when(decision == "taken", 409).otherwise(400)
    return out.select(*requests.columns, decision.alias("decision"), code.alias("http_code"))


def phone_patch(rows: DataFrame, patches: DataFrame, mode: str = "overwrite") -> DataFrame:
    """Apply (request_id, email, phone) patches to verification rows.

    mode: 'overwrite' (client, shop), 'coalesce' (job user keeps an existing
    phone), 'match' (market user: only where the stored phone equals the new
    one).  The phone flag is reset where the row is patched.
    """
    # requests are sequential: the last patch of an e-mail overwrites, the first one fills an empty phone,
    # and any patch may match; all three are partial aggregates
    if mode == "match":
        stored = rows.select("email", F.col("phone").alias("_stored"))
        p = patches.join(stored, "email").groupBy("email").agg(F.max(F.col("phone") == F.col("_stored")).alias("_hit"))
    elif mode == "coalesce":
        given = F.when(F.col("phone").isNotNull(), F.col("request_id"))
        p = patches.groupBy("email").agg(F.min_by("phone", given).alias("_new"), F.lit(True).alias("_hit"))
    else:
        p = patches.groupBy("email").agg(F.max_by("phone", "request_id").alias("_new"), F.lit(True).alias("_hit"))
    j = rows.join(p, "email", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    if mode == "coalesce":
        phone = F.coalesce(F.col("phone"), F.col("_new"))
    elif mode == "match":
        phone = F.col("phone")
    else:
        phone = F.when(hit, F.col("_new")).otherwise(F.col("phone"))
    out = j.withColumn("phone", phone)
    if "is_phone_verified" in rows.columns:
        out = out.withColumn("is_phone_verified", F.when(hit, F.lit(False)).otherwise(F.col("is_phone_verified")))
    return out.select(*rows.columns)


def register_customers(requests: DataFrame, stores: DataFrame, customers: DataFrame) -> DataFrame:
    """Customer sign-up: the store must exist (404) and the e-mail be unused in any store (409).

    Requests are sequential by request_id: the first accepted one takes the e-mail.
    """
    s = stores.select("client_id").distinct().withColumn("_store", F.lit(True))
    asked = requests.select("email").distinct()
    c = customers.select("email").join(asked, "email", "left_semi").distinct().withColumn("_used", F.lit(True))
    j = requests.join(s, "client_id", "left").join(c, "email", "left")
    free = F.col("_store").isNotNull() & F.col("_used").isNull()
    first = j.filter(free).groupBy("email").agg(F.min("request_id").alias("_first"))
    j = j.join(first, "email", "left")
    code = (F.when(F.col("_store").isNull(), 404)
             .when(free & ((F.col("request_id") == F.col("_first")) | F.col("email").isNull()), 201).otherwise(409))
    return j.select(*requests.columns, code.alias("http_code"))
