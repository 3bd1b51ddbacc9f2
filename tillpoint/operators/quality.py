"""Integrity checks Q1-Q7: the declared constraints of the tenant schema as
data-quality jobs that return violation rows.

Violation rows have one schema: ``(table_name, check_name, column_name,
row_key, value)`` (strings).  Row-level checks (NOT NULL, CHECK, enum, length)
of one table run in a single scan: each row yields an array of candidate
violations that is filtered and inlined, so adding checks adds no scans.
UNIQUE uses a partially aggregated count; foreign keys anti-join the
*distinct* child keys against the parent before touching child rows, so a
hot key costs one row in the shuffle.  SQL semantics: NULL passes CHECK,
enum and FK tests and is ignored by UNIQUE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# ---------------------------------------------------------------- fixed values
# Declared constraints of the tenant schema (NOT NULL columns, CHECK bounds,
# UNIQUE keys, enum types / IN lists, foreign keys, VARCHAR lengths).

PRIMARY_KEYS = {
    "users": "user_id", "products": "id", "category": "category_id", "employees": "id", "salaries": "id",
    "cart": "cart_id", "cart_item": "cart_item_id", "bills": "bill_id", "orders": "order_id",
    "order_item": "order_item_id", "web_bills": "web_bill_id", "documents": "document_id",
    "man_expenses": "id", "man_incomes": "id", "accounts_payable": "id", "accounts_receivable": "id",
    "clients": "client_id",
}

NOT_NULL = {
    "users": ["email", "phone"],
    "products": ["name", "price", "quantity", "barcode", "category"],
    "category": ["category"],
    "employees": ["first_name", "last_name", "email", "phone", "position", "salary", "bank_name",
                  "bank_account_number", "ifsc_code"],
    "salaries": ["employee_id", "salary_amount", "payment_date", "salary_month", "payment_method"],
    "cart": ["total_price"],
    "cart_item": ["cart_id", "product_id", "quantity", "unit_price"],
    "bills": ["cart_id", "total_amount"],
    "orders": ["user_id", "total_price"],
    "order_item": ["order_id", "product_id", "quantity", "unit_price"],
    "web_bills": ["order_id", "total_amount"],
    "documents": ["file_url"],
    "man_expenses": ["type", "amount", "expense_date"],
    "man_incomes": ["type", "amount", "income_date"],
    "accounts_payable": ["account_name", "amount", "payment_date", "payment_method"],
    "accounts_receivable": ["account_name", "amount", "due_date", "payment_method"],
}

# (column, operator, bound): the row must satisfy ``column operator bound``
CHECKS = {
    "products": [("price", ">=", 0), ("quantity", ">=", 0)],
    "employees": [("salary", ">=", 0)],
    "salaries": [("salary_amount", ">=", 0)],
    "cart_item": [("quantity", ">", 0), ("unit_price", ">=", 0)],
    "order_item": [("quantity", ">", 0), ("unit_price", ">=", 0)],
    "man_expenses": [("amount", ">=", 0)],
    "man_incomes": [("amount", ">=", 0)],
}

UNIQUE = {
    "users": ["email", "phone"],
    "products": ["barcode"],
    "employees": ["email", "phone", "bank_account_number"],
    "clients": ["subdomain"],
}

CART_STATUS = ["pending", "processing", "completed", "cancelled"]
BILL_STATUS = ["paid", "pending", "failed"]
WEB_BILL_STATUS = ["Paid", "Pending", "Failed"]
ORDER_STATUS = ["pending", "processing", "completed", "cancelled"]
PAYMENT_STATUS = ["Pending", "Paid", "Overdue"]
PAYMENT_METHOD = ["Cash", "Credit Card", "Bank Transfer", "Other"]
PAYMENT_METHOD_SALARY = ["bank_transfer", "cash", "cheque", "upi"]
BILL_METHODS = ["card", "UPI", "cash"]
WEB_BILL_METHODS = ["Card", "UPI", "Cash", "Other"]
MANUAL_METHODS = ["Cash", "Card", "UPI", "Bank Transfer", "Other"]

ENUMS = {
    "cart": {"status": CART_STATUS},
    "bills": {"payment_status": BILL_STATUS, "payment_method": BILL_METHODS},
    "orders": {"status": ORDER_STATUS},
    "web_bills": {"payment_status": WEB_BILL_STATUS, "payment_method": WEB_BILL_METHODS},
    "salaries": {"payment_method": PAYMENT_METHOD_SALARY},
    "man_expenses": {"payment_method": MANUAL_METHODS},
    "man_incomes": {"payment_method": MANUAL_METHODS},
    "accounts_payable": {"payment_method": PAYMENT_METHOD, "status": PAYMENT_STATUS},
    "accounts_receivable": {"payment_method": PAYMENT_METHOD, "status": PAYMENT_STATUS},
}

# (child table, child column, parent table, parent column, on delete cascade)
FOREIGN_KEYS = [
    ("salaries", "employee_id", "employees", "id", True),
    ("cart_item", "cart_id", "cart", "cart_id", True),
    ("cart_item", "product_id", "products", "id", True),
    ("bills", "cart_id", "cart", "cart_id", False),
    ("orders", "user_id", "users", "user_id", False),
    ("order_item", "order_id", "orders", "order_id", True),
    ("order_item", "product_id", "products", "id", True),
    ("web_bills", "order_id", "orders", "order_id", False),
]

LENGTHS = {
    "users": {"email": 255, "phone": 255, "full_name": 255},
    "products": {"name": 255, "barcode": 50, "category": 100, "status": 20, "type": 50},
    "category": {"category": 255},
    "employees": {"first_name": 100, "last_name": 100, "email": 255, "phone": 20, "position": 100,
                  "bank_name": 255, "bank_account_number": 50, "ifsc_code": 11},
    "bills": {"payment_method": 50},
    "web_bills": {"payment_method": 50},
    "man_expenses": {"type": 100, "payment_method": 50},
    "man_incomes": {"type": 100, "payment_method": 50},
    "accounts_payable": {"account_name": 255},
    "accounts_receivable": {"account_name": 255},
    "clients": {"subdomain": 255},
}

VIOLATION_COLUMNS = ["table_name", "check_name", "column_name", "row_key", "value"]

def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _s(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _violation_sql(table: str, check: str, column: str, key: str, value_sql: str) -> str:
    return (f"named_struct('table_name', {_s(table)}, 'check_name', {_s(check)}, 'column_name', {_s(column)}, "
            f"'row_key', CAST({_q(key)} AS STRING), 'value', CAST({value_sql} AS STRING))")


def row_checks(df: DataFrame, table: str, kinds=("not_null", "check", "enum", "length")) -> DataFrame | None:
    """All row-level violations of one table in one pass (None if nothing declared).

    The candidate violations are one SQL expression,
    ``inline(filter(array(CASE WHEN <broken> THEN struct END, ...), v -> v IS NOT NULL))``,
    so the whole check list costs one projection over one scan.
    """
    key = PRIMARY_KEYS.get(table, df.columns[0])
    cols = set(df.columns)
    cands = []
    if "not_null" in kinds:
        for c in NOT_NULL.get(table, []):
            if c in cols:
                cands.append(f"CASE WHEN {_q(c)} IS NULL THEN {_violation_sql(table, 'not_null', c, key, 'NULL')} END")
    if "check" in kinds:
        for c, op, bound in CHECKS.get(table, []):
            if c in cols:
                cands.append(f"CASE WHEN NOT ({_q(c)} {op} {bound}) THEN "
                             f"{_violation_sql(table, f'{op} {bound}', c, key, _q(c))} END")
    if "enum" in kinds:
        for c, allowed in ENUMS.get(table, {}).items():
            if c in cols:
                lst = ", ".join(_s(a) for a in allowed)
                cands.append(f"CASE WHEN {_q(c)} NOT IN ({lst}) THEN "
                             f"{_violation_sql(table, 'enum', c, key, _q(c))} END")
    if "length" in kinds:
        for c, n in LENGTHS.get(table, {}).items():
            if c in cols:
                cands.append(f"CASE WHEN char_length({_q(c)}) > {n} THEN "
                             f"{_violation_sql(table, f'length <= {n}', c, key, f'char_length({_q(c)})')} END")
    if not cands:
        return None
    return df.selectExpr(f"inline(filter(array({', '.join(cands)}), v -> v IS NOT NULL))")


def _union(frames: list[DataFrame], spark) -> DataFrame:
    frames = [f for f in frames if f is not None]
    if not frames:
        return spark.createDataFrame([], "table_name string, check_name string, column_name string, "
                                         "row_key string, value string")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def check_rows(tables: dict[str, DataFrame], kinds) -> DataFrame:
    """Row-level violations (Q1, Q2, Q4, Q7) over every given table."""
    spark = next(iter(tables.values())).sparkSession
    return _union([row_checks(df, name, kinds) for name, df in tables.items()], spark)


def unique_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Q3: values of UNIQUE columns held by more than one row (NULLs excluded)."""
    spark = next(iter(tables.values())).sparkSession
    frames = []
    for name, df in tables.items():
        pk = PRIMARY_KEYS.get(name)
        cols = list(UNIQUE.get(name, [])) + ([pk] if pk and pk in df.columns else [])
        for c in cols:
            if c not in df.columns:
                continue
            g = (df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
                 .filter(F.col("n") > 1))
            frames.append(g.selectExpr(f"{_s(name)} AS table_name", "'unique' AS check_name",
                                       f"{_s(c)} AS column_name", f"CAST({_q(c)} AS STRING) AS row_key",
                                       "CAST(n AS STRING) AS value"))
    return _union(frames, spark)


def fk_violations(tables: dict[str, DataFrame], fks=FOREIGN_KEYS) -> DataFrame:
    """Q5: child rows whose non-NULL foreign key has no parent row."""
    spark = next(iter(tables.values())).sparkSession
    frames = []
    for child, ccol, parent, pcol, _ in fks:
        if child not in tables or parent not in tables:
            continue
        c, p = tables[child], tables[parent]
        keys = c.select(F.col(ccol).alias("_k")).filter(F.col("_k").isNotNull()).distinct()
        missing = keys.join(p.select(F.col(pcol).alias("_k")), "_k", "left_anti")
        rows = c.join(missing, c[ccol] == missing["_k"], "left_semi")
        frames.append(rows.select(F.lit(child).alias("table_name"), F.lit(f"fk {parent}.{pcol}").alias("check_name"),
                                  F.lit(ccol).alias("column_name"),
                                  F.col(PRIMARY_KEYS[child]).cast("string").alias("row_key"),
                                  F.col(ccol).cast("string").alias("value")))
    return _union(frames, spark)


def cascade_delete(tables: dict[str, DataFrame], parent: str, deleted: DataFrame,
                   fks=FOREIGN_KEYS) -> DataFrame:
    """Q6: child rows removed by ON DELETE CASCADE when ``deleted`` parent keys go.

    ``deleted`` holds the parent's key column.  Children without CASCADE are
    reported as blocking (the delete would fail in the reference).
    """
    spark = deleted.sparkSession
    frames = []
    for child, ccol, ptable, pcol, cascade in fks:
        if ptable != parent or child not in tables:
            continue
        c = tables[child]
        keys = deleted.select(F.col(pcol).alias("_k")).distinct()
        rows = c.join(keys, c[ccol] == keys["_k"], "left_semi")
        frames.append(rows.select(F.lit(child).alias("table_name"),
                                  F.lit("cascade" if cascade else "blocks_delete").alias("check_name"),
                                  F.lit(ccol).alias("column_name"),
                                  F.col(PRIMARY_KEYS[child]).cast("string").alias("row_key"),
                                  F.col(ccol).cast("string").alias("value")))
    return _union(frames, spark)


def quality_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Every declared constraint over every given table, as one violation frame."""
    return (check_rows(tables, ("not_null", "check", "enum", "length"))
            .unionByName(unique_violations(tables)).unionByName(fk_violations(tables)))
