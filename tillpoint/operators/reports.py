"""Report read models: catalogues (P3-P6), lookups (P15-P17, S3), nested
documents (D16-D18, D21), registers (D13, D14, D20, S7), category counts
(D19) and the job-board reads (D22, D23).

Joins are written as plain equi-joins; Catalyst/AQE choose broadcast or
sort-merge from runtime sizes.  Where the reference ran one query per parent
row (N+1), the batch form is one join plus one grouped aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillpoint.functions.money import money_out
from tillpoint.functions.nesting import nest
from tillpoint.functions.text import first_label, js_template, pg_concat

# Fixed values of the reference's catalogue filters.
POS_TYPES = ["Offline", "Hybrid"]
WEB_TYPES = ["Online", "Hybrid"]
ECOM_COLUMNS = ["id", "barcode", "name", "imageurl", "quantity", "category", "price"]
RESERVED_SUBDOMAINS = ["", "www"]


def _newest_first(df: DataFrame, col: str = "created_at", *ties: str) -> DataFrame:
    """ORDER BY col DESC with PostgreSQL's NULLS FIRST, plus a unique tiebreaker."""
    return df.orderBy(F.col(col).desc_nulls_first(), *ties)


# ---------------------------------------------------------------- catalogues

def _live(products: DataFrame) -> DataFrame:
    return products.filter(~F.col("deleted"))


def products_pos(products: DataFrame) -> DataFrame:
    """Active, sold in store (Offline/Hybrid), not deleted; newest first."""
    p = _live(products).filter((F.col("status") == "Active") & F.col("type").isin(POS_TYPES))
    return _newest_first(p, "created_at", "id")


def products_web(products: DataFrame) -> DataFrame:
    """Active, sold online (Online/Hybrid), not deleted."""
    return _live(products).filter((F.col("status") == "Active") & F.col("type").isin(WEB_TYPES))


def products_ecom(products: DataFrame) -> DataFrame:
    """P5: the web catalogue projected to the seven shop columns."""
    return products_web(products).select(*ECOM_COLUMNS)


def products_live(products: DataFrame) -> DataFrame:
    """Products not soft-deleted (NULL deleted is dropped, as in SQL)."""
    return _live(products)


def category_counts(category: DataFrame, products: DataFrame) -> DataFrame:
    """Products per category name, 0 for unused; soft-deleted products count.

    Products are counted per category *before* the join (partial aggregation
    over the big side), then the small category list is left-joined.
    """
    per_name = products.groupBy("category").agg(F.count("id").alias("product_count"))
    out = category.select("category_id", "category").join(per_name, "category", "left")
    return (out.select("category_id", "category",
                       F.coalesce(F.col("product_count"), F.lit(0)).cast("long").alias("product_count"))
               .orderBy("category", "category_id"))


# ---------------------------------------------------------------- nested documents

PRODUCT_FIELDS = ["product_id", "name", "price", "quantity"]


def _bill_products(items: DataFrame, parent: str, products: DataFrame) -> DataFrame:
    lines = items.join(products.select(F.col("id").alias("product_id"), "name", "price"), "product_id", "inner")
    return nest(lines.select(parent, *PRODUCT_FIELDS), [parent], PRODUCT_FIELDS, "products")


def pos_bills_nested(bills: DataFrame, cart_item: DataFrame, products: DataFrame) -> DataFrame:
    """Each bill with its products [(product_id, name, price, quantity)].

    Inner joins as in the reference: bills without items vanish.  Items are
    nested per cart first, then joined to the bills.
    """
    nested = _bill_products(cart_item, "cart_id", products)
    out = bills.join(nested, "cart_id", "inner")
    return _newest_first(out.select(
        "bill_id", "cart_id", money_out("total_amount").alias("total_amount"), "payment_status",
        "payment_method", F.date_format("generated_at", "dd-MM-yyyy").alias("generated_at"),
        F.col("generated_at").alias("_ts"), "products"), "_ts", "bill_id").drop("_ts")


def web_bills_nested(web_bills: DataFrame, order_item: DataFrame, products: DataFrame) -> DataFrame:
    """Each web bill with its products; ordered by web_bill_id (JS object key order)."""
    nested = _bill_products(order_item, "order_id", products)
    out = web_bills.join(nested, "order_id", "inner")
    return out.select(
        "web_bill_id", "order_id", money_out("total_amount").alias("total_amount"), "payment_status",
        "payment_method", F.date_format("generated_at", "dd-MM-yyyy").alias("generated_at"),
        "products").orderBy("web_bill_id")


ORDER_ITEM_FIELDS = ["order_item_id", "product_id", "quantity", "unit_price", "product_name"]


def orders_nested(orders: DataFrame, users: DataFrame, web_bills: DataFrame,
                  order_item: DataFrame, products: DataFrame) -> DataFrame:
    """Orders with buyer, payment status and items; orders without items get [].

    One join + one grouped aggregate replaces the reference's per-order query
    loop.  Several bills for one order repeat the order, as in the reference.
    """
    head = (orders.join(users.select("user_id", F.col("full_name").alias("user_name"),
                                     F.col("email").alias("user_email")), "user_id", "inner")
                  .join(web_bills.select("order_id", "payment_status"), "order_id", "left"))
    lines = order_item.join(products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name")),
                            "product_id", "inner")
    items = nest(lines.select("order_id", *ORDER_ITEM_FIELDS), ["order_id"], ORDER_ITEM_FIELDS, "items")
    out = head.join(items, "order_id", "left")
    empty = F.array().cast(items.schema["items"].dataType)
    return _newest_first(out.select(
        "order_id", money_out("total_price").alias("total_price"), F.col("status").alias("order_status"),
        "created_at", "user_name", "user_email", "payment_status",
        F.coalesce(F.col("items"), empty).alias("items")), "created_at", "order_id")


APPLICANT_FIELDS = ["job_apply_id", "job_id", "job_user_id", "applied_at", "status", "resume",
                    "job_user_name", "email", "phone", "address", "dob", "image"]


def jobs_with_applicants(job_list: DataFrame, job_apply: DataFrame, job_user: DataFrame,
                         client_id: int | None = None) -> DataFrame:
    """Open jobs (of one client, or of all clients) with pending applicants nested.

    Jobs without applicants keep an empty list.  ``qualifications`` is the JS
    template "q1, q2" (null prints as 'null').
    """
    jobs = job_list.filter(F.col("status") == "open")
    if client_id is not None:
        jobs = jobs.filter(F.col("client_id") == client_id)
    apps = (job_apply.filter(F.col("status") == "pending")
            .join(job_user.select("job_user_id", "job_user_name", "email", "phone", "address", "dob", "image"),
                  "job_user_id", "inner"))
    nested = nest(apps.select(*APPLICANT_FIELDS), ["job_id"], APPLICANT_FIELDS, "applicants")
    out = jobs.join(nested, "job_id", "left")
    empty = F.array().cast(nested.schema["applicants"].dataType)
    return out.select(
        "client_id", "job_id", F.col("job_title").alias("title"), F.col("created_at").alias("posted_at"),
        F.col("company_name").alias("company"), "location", "type", "work_type",
        F.col("salary_range").alias("salary_per_month"), "description",
        js_template(F.col("quali_1"), ", ", F.col("quali_2")).alias("qualifications"),
        F.coalesce(F.col("applicants"), empty).alias("applicants"))


def not_in_anti(left: DataFrame, right: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """``left.key NOT IN (right.key)`` with SQL's null rule, optionally per ``by`` group.

    A NULL in a group's right keys makes NOT IN unknown for every left row of
    that group, so the group returns nothing; otherwise it is a left anti join.
    Written as anti joins (no nested-loop plan), so both sides can be large.
    """
    by = by or []
    blocked = right.filter(F.col(key).isNull()).select(*by).distinct() if by else None
    if by:
        out = left.join(right.filter(F.col(key).isNotNull()).select(*by, key).distinct(), [*by, key], "left_anti")
        return out.join(blocked, by, "left_anti")
    # one NULL anywhere on the right makes every NOT IN unknown: a scalar subquery, run once
    has_null = right.filter(F.col(key).isNull()).select(F.count(F.lit(1)) > 0).scalar()
    out = left.join(right.filter(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
    return out.filter(~has_null)


def open_jobs_for(job_user: DataFrame, job_list: DataFrame, job_apply: DataFrame) -> DataFrame:
    """D22 batch form: per job user, how many open jobs they have not applied to.

    ``NOT IN`` semantics per user: a user with an application whose job_id is
    NULL gets 0.  The per-user list itself is users x jobs in size, so the
    batch form reports the count; the list for one user is
    ``not_in_anti(open_jobs, applications_of_user, "job_id")``.
    """
    open_jobs = job_list.filter(F.col("status") == "open")
    n_open = open_jobs.select(F.count(F.lit(1))).scalar()      # scalar subquery, evaluated once
    applied_open = (job_apply.filter(F.col("job_id").isNotNull()).select("job_user_id", "job_id").distinct()
                    .join(open_jobs.select("job_id"), "job_id", "left_semi")
                    .groupBy("job_user_id").agg(F.count(F.lit(1)).alias("n_applied")))
    blocked = (job_apply.filter(F.col("job_id").isNull()).select("job_user_id").distinct()
               .withColumn("_blocked", F.lit(True)))
    out = (job_user.select("job_user_id")
           .join(applied_open, "job_user_id", "left")
           .join(blocked, "job_user_id", "left"))
    avail = n_open - F.coalesce(F.col("n_applied"), F.lit(0))
    return out.select("job_user_id",
                      F.when(F.col("_blocked"), F.lit(0)).otherwise(avail).cast("long").alias("open_jobs_available"))


def applied_jobs(job_apply: DataFrame, job_user: DataFrame, job_list: DataFrame) -> DataFrame:
    """Every user's applications with company and title, newest first."""
    out = (job_apply.join(job_user.select("job_user_id"), "job_user_id", "inner")
                    .join(job_list.select("job_id", "company_name", "job_title"), "job_id", "inner"))
    return out.select("job_user_id", "job_apply_id", "company_name", "job_title",
                      F.col("status").alias("application_status"), "applied_at") \
              .orderBy("job_user_id", F.col("applied_at").desc_nulls_first(), "job_apply_id")


# ---------------------------------------------------------------- registers

def accounts(payable: DataFrame, receivable: DataFrame) -> dict[str, DataFrame]:
    """Payable and receivable lists, dates as DD/MM/YYYY, newest first."""
    def one(df, date_col):
        return _newest_first(df.select("id", "account_name", money_out("amount").alias("amount"),
                                       F.date_format(date_col, "dd/MM/yyyy").alias(date_col),
                                       "payment_method", "status", "created_at"),
                             "created_at", "id").drop("created_at")
    return {"payable": one(payable, "payment_date"), "receivable": one(receivable, "due_date")}


def accounts_tagged(payable: DataFrame, receivable: DataFrame) -> DataFrame:
    """The two account lists as one frame with an ``account_type`` tag."""
    p = payable.select(F.lit("payable").alias("account_type"), "id", "account_name",
                       money_out("amount").alias("amount"),
                       F.date_format("payment_date", "dd/MM/yyyy").alias("date"), "payment_method", "status",
                       "created_at")
    r = receivable.select(F.lit("receivable").alias("account_type"), "id", "account_name",
                          money_out("amount").alias("amount"),
                          F.date_format("due_date", "dd/MM/yyyy").alias("date"), "payment_method", "status",
                          "created_at")
    return _newest_first(p.unionByName(r), "created_at", "account_type", "id").drop("created_at")


def salary_register(salaries: DataFrame, employees: DataFrame) -> DataFrame:
    """Salaries with the employee's full name, formatted dates, by first/last name."""
    e = employees.select(F.col("id").alias("employee_id"), "first_name", "last_name")
    out = salaries.join(e, "employee_id", "inner")
    return out.select(
        pg_concat("first_name", F.lit(" "), "last_name").alias("employee_name"),
        money_out("salary_amount").alias("salary_amount"),
        F.date_format("payment_date", "dd/MM/yyyy").alias("payment_date"),
        F.date_format("salary_month", "MMM yyyy").alias("salary_month"),
        "payment_method", "first_name", "last_name", F.col("id").alias("_id")) \
        .orderBy(F.col("first_name").asc_nulls_last(), F.col("last_name").asc_nulls_last(), "_id") \
        .drop("first_name", "last_name", "_id")


EMPLOYEE_COLUMNS = ["id", "first_name", "last_name", "email", "phone", "position", "salary", "bank_name",
                    "bank_account_number", "ifsc_code", "joining_date", "created_at", "updated_at"]


def employee_register(employees: DataFrame) -> DataFrame:
    """Thirteen columns, joining date as DD//MM//YYYY (literal double slash), newest first."""
    cols = [money_out("salary").alias("salary") if c == "salary"
            else F.date_format("joining_date", "dd//MM//yyyy").alias("joining_date") if c == "joining_date"
            else F.col(c) for c in EMPLOYEE_COLUMNS]
    return _newest_first(employees.select(*cols), "created_at", "id")


def documents_list(documents: DataFrame) -> DataFrame:
    """S7 read side: documents newest first."""
    return _newest_first(documents.select("document_id", "file_url", "description", "created_at"),
                         "created_at", "document_id")


# ---------------------------------------------------------------- tenants and lookups

def resolve_tenant(requests: DataFrame, clients: DataFrame, host_col: str = "host") -> DataFrame:
    """S3: first label of the host -> tenant.

    Empty or 'www' -> 'rejected'; no such subdomain -> 'unknown'; else 'ok'
    with client_id and db_name.
    """
    sub = first_label(F.col(host_col))
    r = requests.withColumn("subdomain", sub)
    out = r.join(clients.select("subdomain", "client_id", "db_name"), "subdomain", "left")
    status = (F.when(F.col("subdomain").isin(RESERVED_SUBDOMAINS) | F.col("subdomain").isNull(), F.lit("rejected"))
               .when(F.col("client_id").isNull(), F.lit("unknown")).otherwise(F.lit("ok")))
    ok = status == "ok"
    return out.select(*requests.columns, "subdomain",
                      F.when(ok, F.col("client_id")).alias("client_id"),
                      F.when(ok, F.col("db_name")).alias("db_name"), status.alias("resolution"))


def store_info(requests: DataFrame, clients: DataFrame, sub_col: str = "subdomain") -> DataFrame:
    """Store card for a requested subdomain (trimmed, lower-cased): name, e-mail, welcome text."""
    r = requests.withColumn("_sub", F.lower(F.trim(F.col(sub_col))))
    c = clients.select(F.col("subdomain").alias("_sub"), "client_name", "email")
    out = r.join(c, "_sub", "inner")
    return out.select(*requests.columns, F.col("client_name").alias("store_name"), F.col("email").alias("store_email"),
                      F.concat(F.lit("Welcome to "), F.col("client_name")).alias("welcome"))


def lookup_by_email(requests: DataFrame, table: DataFrame, email_col: str = "email") -> DataFrame:
    """Is the e-mail already registered? (batch equi left-semi test as a flag)."""
    known = table.select(F.col(email_col).alias("_e")).distinct().withColumn("_known", F.lit(True))
    out = requests.join(known, requests[email_col] == known["_e"], "left")
    return out.select(*requests.columns, F.coalesce(F.col("_known"), F.lit(False)).alias("registered"))


def public_view(df: DataFrame, sensitive=("password_hash", "password")) -> DataFrame:
    """Drop secret columns from a profile row (the reference returned them)."""
    return df.drop(*[c for c in sensitive if c in df.columns])


def client_profile(clients: DataFrame, client_id: int | None = None) -> DataFrame:
    """P16 + P14: a client's profile row without secret columns (one client or all)."""
    c = clients if client_id is None else clients.filter(F.col("client_id") == client_id)
    return public_view(c)


def subdomain_of(clients: DataFrame, requests: DataFrame) -> DataFrame:
    """Subdomain per requesting client; unknown client -> NULL (the reference's 404)."""
    return requests.join(clients.select("client_id", "subdomain"), "client_id", "left")


def register_documents(documents: DataFrame, uploads: DataFrame, as_of_ts) -> DataFrame:
    """Append uploaded (file_url, description) rows stamped ``as_of_ts`` and list newest first.

    New ids are the upload request ids (no global counter to coordinate).
    """
    new = uploads.select(F.col("request_id").alias("document_id"), "file_url", "description",
                         as_of_ts.alias("created_at"))
    return documents_list(documents.select("document_id", "file_url", "description", "created_at").unionByName(new))
