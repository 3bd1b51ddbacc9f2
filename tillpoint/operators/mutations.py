"""Write endpoints re-aimed as batch operators over request tables.

Every operator takes a table of requests (with ``request_id``; a larger id
arrived later) and the current table(s), and returns DataFrames: the rows the
reference would have written or returned, the table after the batch where
that is the natural result, and an ``outcome`` frame
``(request_id, http_code, message)`` that keeps the HTTP answers as data.

Batch semantics follow the sequential reference: when several requests in a
batch touch the same key, the later one sees the earlier one's effect
(last write wins for updates, first insert wins for unique keys).  Per-key
reductions use ``max_by`` / ``min`` aggregates (partially aggregated before
the shuffle) rather than windows, so one hot key does not become one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tillpoint.functions.text import conflict_labels
from tillpoint.operators.sequential import last_set, replay_unique

# Allowed sets checked by the reference's handlers.
TRANSACTION_TYPES = ["income", "expense"]
APPLICATION_STATUSES = ["pending", "reviewed", "withdrawn", "accepted", "rejected"]
PRODUCT_TYPES = ["Offline", "Online", "Hybrid"]
PRODUCT_STATUSES = ["Active", "Inactive"]


@dataclass
class Applied:
    table: DataFrame | None      # table after the batch
    returned: DataFrame | None   # rows RETURNING (inserted / updated / deleted)
    outcome: DataFrame           # request_id, http_code, message


def falsy(c: Column, dtype: str) -> Column:
    """JavaScript falsiness of a request field: null, '' or numeric 0 (and false)."""
    if dtype in ("string",):
        return c.isNull() | (c == F.lit(""))
    if dtype in ("boolean",):
        return c.isNull() | ~c
    if dtype.startswith(("decimal", "int", "bigint", "long", "double", "float", "smallint")):
        return c.isNull() | (c == F.lit(0))
    return c.isNull()


def any_falsy(df: DataFrame, cols: list[str]) -> Column:
    types = dict(df.dtypes)
    out = None
    for c in cols:
        f = falsy(F.col(c), types[c])
        out = f if out is None else (out | f)
    return out


def _outcome(df: DataFrame, code: Column, message: Column) -> DataFrame:
    return df.select("request_id", code.cast("int").alias("http_code"), message.alias("message"))


def latest_per_key(requests: DataFrame, key: str, order: str = "request_id") -> DataFrame:
    """The last request per key (sequential last-write-wins), via a max_by aggregate."""
    cols = [c for c in requests.columns if c != key]
    g = requests.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_v"))
    return g.select(key, *[F.col("_v")[c].alias(c) for c in cols])


# ---------------------------------------------------------------- M5 / M6 / M7: accounts

def add_accounts(requests: DataFrame, date_col: str = "payment_date") -> Applied:
    """M5: insert payable / receivable rows; any falsy field -> 400 (new id = request_id)."""
    fields = ["account_name", "amount", date_col, "payment_method", "status"]
    bad = any_falsy(requests, fields)
    ok = requests.filter(~bad)
    returned = ok.select(F.col("request_id").alias("id"), *fields, F.col("requested_at").alias("created_at"))
    outcome = _outcome(requests, F.when(bad, 400).otherwise(201),
                       F.when(bad, F.lit("All fields are required")).otherwise(F.lit("added")))
    return Applied(None, returned, outcome)


def update_rows(table: DataFrame, requests: DataFrame, key: str, set_cols: list[str],
                required_cols: list[str] | None = None, not_found: str = "not found") -> Applied:
    """Full-row replace by key (last request per key wins); unknown key -> 404.

    ``required_cols`` are checked first (falsy -> 400, as update-pay-acc: amount may be 0).
    """
    req = requests
    bad = any_falsy(req, required_cols) if required_cols else F.lit(False)
    valid = req.filter(~bad)
    last = latest_per_key(valid.select("request_id", key, *set_cols), key)
    j = table.join(last.select(key, *[F.col(c).alias(f"_n_{c}") for c in set_cols], "request_id"), key, "left")
    hit = F.col("request_id").isNotNull()
    after = j.select(*[F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) if c in set_cols else F.col(c)
                       for c in table.columns])
    returned = j.filter(hit).select(*[F.col(f"_n_{c}").alias(c) if c in set_cols else F.col(c)
                                      for c in table.columns])
    exists = table.select(key).distinct().withColumn("_found", F.lit(True))
    o = req.withColumn("_bad", bad).join(exists, key, "left")
    outcome = _outcome(o, F.when(F.col("_bad"), 400).when(F.col("_found").isNull(), 404).otherwise(200),
                       F.when(F.col("_bad"), F.lit("All fields are required"))
                        .when(F.col("_found").isNull(), F.lit(not_found)).otherwise(F.lit("updated")))
    return Applied(after, returned, outcome)


def delete_returning(table: DataFrame, requests: DataFrame, key: str) -> Applied:
    """M7: DELETE ... WHERE key = ? RETURNING *; unknown (or already deleted) key -> 404.

    Two requests for one key: the earlier deletes, the later gets 404.
    """
    firsts = requests.groupBy(key).agg(F.min("request_id").alias("_first"))
    kept = table.join(requests.select(key).distinct(), key, "left_anti")
    returned = table.join(firsts, key, "inner").select(F.col("_first").alias("request_id"), *table.columns)
    exists = table.select(key).distinct().withColumn("_found", F.lit(True))
    o = requests.join(exists, key, "left").join(firsts, key, "left")
    ok = F.col("_found").isNotNull() & (F.col("request_id") == F.col("_first"))
    outcome = _outcome(o, F.when(ok, 200).otherwise(404),
                       F.when(ok, F.lit("deleted")).otherwise(F.lit("not found")))
    return Applied(kept, returned, outcome)


# ---------------------------------------------------------------- M8: manual transactions

def route_manual_transactions(requests: DataFrame) -> Applied:
    """M8: type 'income' -> man_incomes, 'expense' -> man_expenses; bad type or falsy field -> 400.

    ``returned`` holds the inserted rows with a ``target`` column.
    """
    bad_type = ~F.coalesce(F.col("type").isin(TRANSACTION_TYPES), F.lit(False))
    missing = any_falsy(requests, ["description", "amount", "date"])
    ok = requests.filter(~bad_type & ~missing)
    returned = ok.select(F.col("request_id").alias("id"),
                         F.when(F.col("type") == "income", F.lit("man_incomes"))
                          .otherwise(F.lit("man_expenses")).alias("target"),
                         "type", "description", "amount", "date")
    outcome = _outcome(requests, F.when(bad_type | missing, 400).otherwise(201),
                       F.when(bad_type, F.lit('Invalid type. Use "income" or "expense".'))
                        .when(missing, F.lit("Missing required fields.")).otherwise(F.lit("added")))
    return Applied(None, returned, outcome)


# ---------------------------------------------------------------- M4: salaries

def add_salaries(requests: DataFrame, employees: DataFrame, as_of_date: Column) -> Applied:
    """M4: salary payments plus their 'Salary to <name>' expense rows (M3).

    salary_month 'YYYY-MM' becomes the first of the month; a month that does
    not parse is refused (the reference's check was always true, B13).
    Missing employee -> 404; payment_date defaults to the as-of date.
    """
    month = F.to_date(F.concat(F.col("salary_month"), F.lit("-01")), "yyyy-MM-dd")
    month = F.when(F.col("salary_month").rlike(r"^\d{4}-\d{2}$"), month)
    r = requests.withColumn("_month", month)
    missing = any_falsy(r, ["employee_id", "salary_amount", "payment_method"]) | F.col("_month").isNull()
    e = employees.select(F.col("id").alias("employee_id"), "first_name", "last_name").withColumn("_emp", F.lit(True))
    j = r.join(e, "employee_id", "left")
    ok = ~missing & F.col("_emp").isNotNull()
    good = j.filter(ok)
    pay_date = F.coalesce(F.col("payment_date"), as_of_date)
    salaries = good.select(F.col("request_id").alias("id"), "employee_id", "salary_amount",
                           F.col("_month").alias("salary_month"), "payment_method", pay_date.alias("payment_date"))
    expenses = good.select(F.col("request_id").alias("id"), F.lit("salary").alias("type"),
                           F.concat(F.lit("Salary to "), F.coalesce(F.col("first_name"), F.lit("null")), F.lit(" "),
                                    F.coalesce(F.col("last_name"), F.lit("null"))).alias("description"),
                           F.col("salary_amount").alias("amount"), pay_date.alias("expense_date"))
    outcome = _outcome(j, F.when(missing, 400).when(F.col("_emp").isNull(), 404).otherwise(201),
                       F.when(missing, F.lit("Missing required salary data."))
                        .when(F.col("_emp").isNull(), F.lit("Employee not found")).otherwise(F.lit("added")))
    return Applied(expenses, salaries, outcome)


# ---------------------------------------------------------------- M9: partial update

def patch_rows(table: DataFrame, patches: DataFrame, key: str, fields: list[str],
               provided_col: str = "provided", conflict_keys: list[str] | None = None,
               touch_col: str | None = "updated_at", touch_value: Column | None = None) -> Applied:
    """M9: only the fields named in ``provided`` change; absent and NULL differ.

    With ``conflict_keys`` a patch that sets a unique value which *another* row holds when its
    turn comes is refused with 409 and the reference's label text ('Email, Phone' ...); earlier
    patches of the batch take and free values.  No provided field -> 400.  Of several accepted
    patches of a row the last one that provides a field wins, field by field.
    """
    p = patches.join(table.select(key).distinct().withColumn("_found", F.lit(True)), key, "left")
    none = F.size(F.col(provided_col)) == 0
    lab = F.lit("")
    if conflict_keys:
        taken = replay_unique(table, p, key, conflict_keys, F.col(provided_col), F.col("_found"))
        p = p.join(taken, "request_id", "left")
        lab = conflict_labels([(F.array_contains("taken", k), _LABELS.get(k, k)) for k in conflict_keys])
    conflict = F.length(lab) > 0
    code = F.when(none, 400).when(conflict, 409).when(F.col("_found").isNull(), 404).otherwise(200)
    message = (F.when(none, F.lit("No fields provided for update"))
               .when(conflict, F.concat(lab, F.lit(" already exists for another employee.")))
               .when(F.col("_found").isNull(), F.lit("not found")).otherwise(F.lit("updated")))
    last = last_set(p.filter(code == 200), key, fields, F.col(provided_col)).withColumn("_hit", F.lit(True))
    j = table.join(last, key, "left")
    cols = []
    for c in table.columns:
        if c in fields:
            cols.append(F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(False)), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        elif touch_col and c == touch_col and touch_value is not None:
            cols.append(F.when(F.col("_hit"), touch_value).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return Applied(j.select(*cols), None, _outcome(p, code, message))


_LABELS = {"email": "Email", "phone": "Phone", "bank_account_number": "Bank Account Number",
           "barcode": "Barcode"}


# ---------------------------------------------------------------- M11: inserts with unique keys

def first_wins_unique(requests: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Sequential insert with UNIQUE keys: (request_id, conflict label text or NULL).

    A request is refused when a key value is held by the table or by an
    *earlier accepted* request of the batch; refused requests free nothing
    because they never inserted.  With several keys acceptance can chain, so
    it is decided in rounds: accept when no earlier not-refused request and no
    existing row shares a value; refuse when an existing row or an earlier
    accepted request does.  Per-key first holders are min aggregates.
    """
    from tillpoint.session import checkpoint_dir
    checkpoint_dir(requests.sparkSession)
    req = requests.select("request_id", *keys).checkpoint()
    held = {}
    for k in keys:
        held[k] = existing.select(F.col(k).alias("_v")).filter(F.col("_v").isNotNull()).distinct() \
            .withColumn(f"_ex_{k}", F.lit(True))
    base = req
    for k in keys:
        base = base.join(held[k].withColumnRenamed("_v", k), k, "left")
    base = base.checkpoint()
    state = base.select("request_id", F.lit("open").alias("st"))
    ex_any = None
    for k in keys:
        e = F.col(f"_ex_{k}").isNotNull()
        ex_any = e if ex_any is None else (ex_any | e)
    state = base.select("request_id", F.when(ex_any, F.lit("rej")).otherwise(F.lit("open")).alias("st")).checkpoint()
    while state.filter(F.col("st") == "open").count() > 0:      # each round decides the earliest open request
        cur = base.join(state, "request_id")
        up_any, lo_any = None, None
        for k in keys:
            firsts = (cur.filter(F.col(k).isNotNull() & (F.col("st") != "rej")).groupBy(k)
                      .agg(F.min("request_id").alias(f"_up_{k}"),
                           F.min(F.when(F.col("st") == "acc", F.col("request_id"))).alias(f"_lo_{k}")))
            cur = cur.join(firsts, k, "left")
            up = F.col(f"_up_{k}") < F.col("request_id")
            lo = F.col(f"_lo_{k}") < F.col("request_id")
            up_any = up if up_any is None else (up_any | up)
            lo_any = lo if lo_any is None else (lo_any | lo)
        dec = cur.select("request_id", F.when(F.col("st") != "open", F.col("st"))
                         .when(~F.coalesce(up_any, F.lit(False)), F.lit("acc"))
                         .when(F.coalesce(lo_any, F.lit(False)), F.lit("rej"))
                         .otherwise(F.lit("open")).alias("st"))
        state = dec.checkpoint()
    # labels: keys shared with existing rows or with earlier accepted requests
    cur = base.join(state, "request_id")
    lab = []
    for k in keys:
        acc_first = (cur.filter((F.col("st") == "acc") & F.col(k).isNotNull()).groupBy(k)
                     .agg(F.min("request_id").alias(f"_a_{k}")))
        cur = cur.join(acc_first, k, "left")
        lab.append(((F.col(f"_ex_{k}").isNotNull() | (F.col(f"_a_{k}") < F.col("request_id"))), _LABELS.get(k, k)))
    text = conflict_labels(lab)
    return cur.select("request_id", F.when(F.col("st") == "rej", text).alias("conflict"))


EMPLOYEE_FIELDS = ["first_name", "last_name", "email", "phone", "position", "salary", "bank_name",
                   "bank_account_number", "ifsc_code", "joining_date"]


def add_employees(requests: DataFrame, employees: DataFrame) -> Applied:
    """Add employees; falsy field -> 400; email / phone / bank account taken -> 409 + labels."""
    bad = any_falsy(requests, EMPLOYEE_FIELDS)
    valid = requests.filter(~bad)
    conf = first_wins_unique(valid, employees, ["email", "phone", "bank_account_number"])
    o = requests.withColumn("_bad", bad).join(conf, "request_id", "left")
    code = F.when(F.col("_bad"), 400).when(F.col("conflict").isNotNull(), 409).otherwise(201)
    msg = (F.when(F.col("_bad"), F.lit("All fields are required"))
            .when(F.col("conflict").isNotNull(), F.concat(F.col("conflict"), F.lit(" already exists")))
            .otherwise(F.lit("added")))
    outcome = _outcome(o, code, msg)
    returned = o.filter(code == 201).select(F.col("request_id").alias("id"), *EMPLOYEE_FIELDS)
    return Applied(None, returned, outcome)


def add_products(requests: DataFrame, products: DataFrame) -> Applied:
    """Add products; invalid data -> 400; barcode taken (table or earlier request) -> 409.

    quantity / price arrive as text and are parsed with ``try_cast`` (NULL
    rejects where the reference let NaN through, P13).
    """
    r, bad = _parse_product_fields(requests)
    valid = r.filter(~bad)
    conf = first_wins_unique(valid, products, ["barcode"])
    o = r.withColumn("_bad", bad).join(conf, "request_id", "left")
    code = F.when(F.col("_bad"), 400).when(F.col("conflict").isNotNull(), 409).otherwise(201)
    msg = (F.when(F.col("_bad"), F.lit("Invalid product data"))
            .when(F.col("conflict").isNotNull(), F.lit("Product with this barcode already exists"))
            .otherwise(F.lit("added")))
    returned = o.filter(code == 201).select(F.col("request_id").alias("id"), "name", "category", "quantity",
                                            "barcode", "price", "type", "status")
    return Applied(None, returned, _outcome(o, code, msg))


# ---------------------------------------------------------------- M10: products

def soft_delete_products(products: DataFrame, requests: DataFrame, as_of_ts: Column | None = None) -> Applied:
    """deleted = true by id (RETURNING the row); unknown id -> 404."""
    hits = requests.select("id").distinct().withColumn("_hit", F.lit(True))
    j = products.join(hits, "id", "left")
    after = j.select(*[F.when(F.col("_hit"), F.lit(True)).otherwise(F.col("deleted")).alias("deleted")
                       if c == "deleted" else F.col(c) for c in products.columns])
    exists = products.select("id").withColumn("_found", F.lit(True))
    o = requests.join(exists, "id", "left")
    outcome = _outcome(o, F.when(F.col("_found").isNull(), 404).otherwise(200),
                       F.when(F.col("_found").isNull(), F.lit("Product not found")).otherwise(F.lit("Product deleted")))
    return Applied(after, None, outcome)


# ---------------------------------------------------------------- M13 / M14: categories

def guarded_delete_category(category: DataFrame, products: DataFrame, requests: DataFrame) -> Applied:
    """A category used by any product -> 409; unknown id -> 404; else deleted (200).

    The in-use test is a semi join on the category *name* (the reference's
    scalar subquery), evaluated against products before the batch.
    """
    used = products.select("category").distinct().withColumn("_used", F.lit(True))
    cat = category.select("category_id", "category").join(used, "category", "left")
    o = requests.join(cat, "category_id", "left")
    first = requests.groupBy("category_id").agg(F.min("request_id").alias("_first"))
    o = o.join(first, "category_id", "left")
    missing = F.col("category").isNull() | (F.col("request_id") != F.col("_first"))
    code = F.when(falsy(F.col("category_id"), "int"), 400).when(F.col("_used").isNotNull(), 409) \
        .when(missing, 404).otherwise(200)
    msg = (F.when(code == 400, F.lit("Category ID is required"))
            .when(code == 409, F.lit("Cannot delete category: Products are using this category."))
            .when(code == 404, F.lit("Category not found.")).otherwise(F.lit("Category deleted successfully.")))
    outcome = _outcome(o, code, msg)
    deleted = o.filter(code == 200).select("category_id")
    after = category.join(deleted, "category_id", "left_anti")
    return Applied(after, None, outcome)


def add_categories(requests: DataFrame) -> Applied:
    """Non-empty category text -> appended with the request time."""
    bad = falsy(F.col("category"), "string")
    returned = requests.filter(~bad).select(F.col("request_id").alias("category_id"), "category",
                                            F.col("requested_at").alias("created_at"))
    return Applied(None, returned, _outcome(requests, F.when(bad, 400).otherwise(201),
                                            F.when(bad, F.lit("Invalid category data")).otherwise(F.lit("added"))))


# ---------------------------------------------------------------- M15-M17: job board

def apply_jobs(requests: DataFrame, job_list: DataFrame, job_apply: DataFrame) -> Applied:
    """The job must be open (404) and not applied to already (400, also within the batch)."""
    open_jobs = job_list.filter(F.col("status") == "open").select("job_id").withColumn("_open", F.lit(True))
    prior = job_apply.select("job_id", "job_user_id").distinct().withColumn("_prior", F.lit(True))
    first = (requests.filter(F.col("job_id").isNotNull())
             .groupBy("job_id", "job_user_id").agg(F.min("request_id").alias("_first")))
    o = (requests.join(open_jobs, "job_id", "left").join(prior, ["job_id", "job_user_id"], "left")
         .join(first, ["job_id", "job_user_id"], "left"))
    code = (F.when(falsy(F.col("job_id"), "bigint"), 400).when(F.col("_open").isNull(), 404)
             .when(F.col("_prior").isNotNull() | (F.col("request_id") != F.col("_first")), 400).otherwise(201))
    msg = (F.when(falsy(F.col("job_id"), "bigint"), F.lit("Missing job_id"))
            .when(F.col("_open").isNull(), F.lit("Job not found or no longer available"))
            .when(code == 400, F.lit("You have already applied for this job"))
            .otherwise(F.lit("Job application submitted successfully")))
    returned = o.filter(code == 201).select(F.col("request_id").alias("job_apply_id"), "job_id", "job_user_id",
                                            F.col("requested_at").alias("applied_at"),
                                            F.lit("pending").alias("status"), F.col("fileurl").alias("resume"))
    return Applied(None, returned, _outcome(o, code, msg))


def close_jobs(job_list: DataFrame, requests: DataFrame) -> Applied:
    """status = 'closed' only where (job_id, client_id) match; else 404."""
    own = job_list.select("job_id", "client_id").withColumn("_own", F.lit(True))
    o = requests.join(own, ["job_id", "client_id"], "left")
    closed = o.filter(F.col("_own").isNotNull()).select("job_id").distinct().withColumn("_close", F.lit(True))
    after = job_list.join(closed, "job_id", "left").select(
        *[F.when(F.col("_close"), F.lit("closed")).otherwise(F.col("status")).alias("status")
          if c == "status" else F.col(c) for c in job_list.columns])
    code = F.when(falsy(F.col("job_id"), "bigint"), 400).when(F.col("_own").isNull(), 404).otherwise(200)
    msg = (F.when(code == 400, F.lit("Missing required fields"))
            .when(code == 404, F.lit("Job not found or unauthorized"))
            .otherwise(F.lit("Job deleted (closed) successfully")))
    return Applied(after, None, _outcome(o, code, msg))


def update_application_status(job_apply: DataFrame, job_list: DataFrame, requests: DataFrame,
                              owner_check: bool = False) -> Applied:
    """Status must be in the allowed set (400); the application must exist on a listed
    job (404; with ``owner_check`` also belong to the requesting client, B10); last request wins."""
    listed = job_list.select("job_id", "client_id")
    apps = job_apply.select("job_apply_id", "job_id").join(listed, "job_id", "inner")
    o = requests.join(apps.select("job_apply_id", F.col("client_id").alias("_owner")).withColumn("_f", F.lit(True)),
                      "job_apply_id", "left")
    missing = falsy(F.col("job_apply_id"), "bigint") | falsy(F.col("status"), "string")
    invalid = ~F.coalesce(F.col("status").isin(APPLICATION_STATUSES), F.lit(False))
    found = F.col("_f").isNotNull()
    if owner_check:
        found = found & (F.col("_owner") == F.col("client_id"))
    code = F.when(missing, 400).when(invalid, 400).when(~found, 404).otherwise(200)
    msg = (F.when(missing, F.lit("Missing job_apply_id or status"))
            .when(invalid, F.lit("Invalid status value"))
            .when(~found, F.lit("Application not found or unauthorized")).otherwise(F.lit("updated")))
    ok = o.filter(code == 200).select("request_id", "job_apply_id", F.col("status").alias("_new"))
    last = latest_per_key(ok, "job_apply_id")
    after = job_apply.join(last.select("job_apply_id", "_new"), "job_apply_id", "left").select(
        *[F.coalesce(F.col("_new"), F.col("status")).alias("status") if c == "status" else F.col(c)
          for c in job_apply.columns])
    return Applied(after, None, _outcome(o, code, msg))


# ---------------------------------------------------------------- M18 / M19

def update_order_status(orders: DataFrame, web_bills: DataFrame, requests: DataFrame) -> Applied:
    """Set web_bills.payment_status and orders.status from one request, both or neither.

    The reference updates a column that does not exist after changing the
    bill (B9); here both change together.  A missing field -> 400; an unknown
    order changes nothing and answers 200; last wins.
    """
    o = requests
    missing = any_falsy(requests, ["order_id", "payment_status", "order_status"])
    code = F.when(missing, 400).otherwise(200)
    msg = (F.when(missing, F.lit("order_id, payment_status, and order_status are required."))
            .otherwise(F.lit("Payment and order status updated successfully.")))
    ok = latest_per_key(o.filter(code == 200).select("request_id", "order_id", "payment_status", "order_status"),
                        "order_id")
    orders_after = orders.join(ok.select("order_id", "order_status"), "order_id", "left").select(
        *[F.coalesce(F.col("order_status"), F.col("status")).alias("status") if c == "status" else F.col(c)
          for c in orders.columns])
    bills_after = web_bills.join(ok.select("order_id", F.col("payment_status").alias("_ps")), "order_id", "left") \
        .select(*[F.coalesce(F.col("_ps"), F.col("payment_status")).alias("payment_status")
                  if c == "payment_status" else F.col(c) for c in web_bills.columns])
    return Applied(orders_after, bills_after, _outcome(o, code, msg))


def set_subdomains(clients: DataFrame, requests: DataFrame) -> Applied:
    """Change a client's subdomain; a value that another client holds when the request's turn
    comes -> 400 (earlier requests take and free names); an unknown client -> 401; the last
    accepted request per client wins."""
    r = requests.join(clients.select("client_id").withColumn("_known", F.lit(True)), "client_id", "left")
    o = r.join(replay_unique(clients, r, "client_id", ["subdomain"], acts=F.col("_known")), "request_id", "left")
    code = F.when(F.col("_known").isNull(), 401).when(F.col("taken").isNotNull(), 400).otherwise(200)
    msg = (F.when(code == 401, F.lit("Invalid client ID. Unauthorized access."))
            .when(code == 400, F.lit("Subdomain already exists for another client."))
            .otherwise(F.lit("Subdomain saved successfully")))
    last = last_set(o.filter(code == 200), "client_id", ["subdomain"])
    after = clients.join(last, "client_id", "left").select(
        *[F.when(F.coalesce("_s_subdomain", F.lit(False)), F.col("_n_subdomain")).otherwise(F.col(c)).alias(c)
          if c == "subdomain" else F.col(c) for c in clients.columns])
    return Applied(after, None, _outcome(o, code, msg))


JOB_FIELDS = ["jobtitle", "description", "location", "salary", "company_name", "quali_1", "quali_2", "type",
              "work_type"]


def list_jobs(requests: DataFrame) -> Applied:
    """Post jobs (status 'open'); any falsy field -> 400.  New job_id = request_id."""
    bad = any_falsy(requests, JOB_FIELDS)
    returned = requests.filter(~bad).select(
        F.col("request_id").alias("job_id"), F.col("jobtitle").alias("job_title"), "client_id", "description",
        "location", F.col("salary").alias("salary_range"), F.lit("open").alias("status"), "company_name",
        "quali_1", "quali_2", "type", "work_type")
    return Applied(None, returned, _outcome(requests, F.when(bad, 400).otherwise(201),
                                            F.when(bad, F.lit("Missing required fields")).otherwise(F.lit("listed"))))


def _parse_product_fields(requests: DataFrame) -> tuple[DataFrame, Column]:
    """quantity / price arrive as text (parseInt / parseFloat); invalid data -> the 400 flag."""
    r = (requests.withColumn("quantity", F.expr("try_cast(quantity_text AS INT)"))
         .withColumn("price", F.expr("try_cast(price_text AS DECIMAL(10,2))")))
    bad = (falsy(F.col("name"), "string") | falsy(F.col("category"), "string") | F.col("quantity").isNull()
           | falsy(F.col("barcode"), "string") | F.col("price").isNull()
           | ~F.coalesce(F.col("type").isin(PRODUCT_TYPES), F.lit(False))
           | ~F.coalesce(F.col("status").isin(PRODUCT_STATUSES), F.lit(False)))
    return r, bad


def update_products(products: DataFrame, requests: DataFrame, as_of_ts: Column) -> Applied:
    """Replace name, category, quantity, barcode, price, type, status and stamp updated_at;
    invalid data -> 400, unknown id -> 404, a barcode that another product holds when the
    request's turn comes -> 500; the last accepted request per id wins."""
    r, bad = _parse_product_fields(requests)
    r = (r.withColumn("updated_at", as_of_ts).withColumn("_bad", bad)
         .join(products.select("id").withColumn("_found", F.lit(True)), "id", "left"))
    r = r.join(replay_unique(products, r.filter(~F.col("_bad")), "id", ["barcode"], acts=F.col("_found")), "request_id", "left")
    code = (F.when(F.col("_bad"), 400).when(F.col("_found").isNull(), 404).when(F.col("taken").isNotNull(), 500)
            .otherwise(200))
    msg = (F.when(F.col("_bad"), F.lit("Invalid product data")).when(code == 404, F.lit("Product not found"))
            .when(code == 500, F.lit("Failed to update product")).otherwise(F.lit("Product updated")))
    fields = ["name", "category", "quantity", "barcode", "price", "type", "status", "updated_at"]
    out = update_rows(products, r.filter(code == 200).select("request_id", "id", *fields), "id", fields)
    return Applied(out.table, out.returned, _outcome(r, code, msg))


def update_manual_transactions(incomes: DataFrame, expenses: DataFrame, requests: DataFrame) -> Applied:
    """M8 (update): type routes the request to man_incomes or man_expenses; description,
    amount and date are replaced by id; bad type or falsy field -> 400, unknown id -> 404.

    ``table`` = incomes after, ``returned`` = expenses after.
    """
    bad_type = ~F.coalesce(F.col("type").isin(TRANSACTION_TYPES), F.lit(False))
    missing = any_falsy(requests, ["description", "amount", "date"])
    r = requests.withColumn("_bad", bad_type | missing)
    after = {}
    for t, table, date_col in (("income", incomes, "income_date"), ("expense", expenses, "expense_date")):
        sel = (r.filter(~F.col("_bad") & (F.col("type") == t))
               .select("request_id", "id", "description", "amount", F.col("date").alias(date_col)))
        after[t] = update_rows(table, sel, "id", ["description", "amount", date_col]).table
    inc_ids = incomes.select("id").withColumn("_in_inc", F.lit(True))
    exp_ids = expenses.select("id").withColumn("_in_exp", F.lit(True))
    o = r.join(inc_ids, "id", "left").join(exp_ids, "id", "left")
    found = F.when(F.col("type") == "income", F.col("_in_inc").isNotNull()).otherwise(F.col("_in_exp").isNotNull())
    code = F.when(bad_type | missing, 400).when(~found, 404).otherwise(200)
    msg = (F.when(bad_type, F.lit('Invalid type. Use "income" or "expense".'))
            .when(missing, F.lit("Missing required fields.")).when(code == 404, F.lit("Transaction not found"))
            .otherwise(F.lit("updated")))
    return Applied(after["income"], after["expense"], _outcome(o, code, msg))
