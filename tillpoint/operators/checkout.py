"""Checkout allocation M1/M2 and derived ledger rows M3.

The reference processes one cart per request: for each item in order it
checks the product (missing -> 404) and the current stock (short -> 400),
inserts the item and decrements stock; a failure rolls the cart back.  Carts
therefore compete for stock in arrival order and a refused cart frees its
stock for later ones.  The batch form decides a whole table of carts with the
same result as processing them one by one (all-or-nothing per cart, defect
B4 fixed), without a sequential loop over carts:

* a cart's products are reduced to lines (cart, product, total quantity);
* each round computes, per line, the stock used by earlier carts two ways:
  *upper* = earlier carts not yet refused, *lower* = earlier accepted carts.
  An open cart whose lines all fit under *upper* is accepted; one with a line
  that fails under *lower* is refused.  The earliest open cart always gets
  decided, usually thousands do; the loop ends when none is open;
* running sums per product are computed on (product, range) so a hot
  product is spread over many tasks: lines are dealt by range over (product,
  time, cart) once (``functions.ordering``); the totals of the products on
  borders carry into the range, a window inside the range adds the rest;
* the cart state is checkpointed each round (``spark.checkpoint.dir``), so
  lineage stays short and a lost executor recomputes one round at most.

A last pass replays the stock seen by each refused cart item by item to give
the reference's answer: the first failing item decides 404 / 400 / 500.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tillpoint.functions.money import MONEY_SUM, money_out
from tillpoint.functions.ordering import border_keys, in_ranges, of_borders, with_carry
from tillpoint.session import checkpoint_dir

# Reference response codes and messages.
MSG_MISSING_FIELDS = "Missing required fields"
MSG_USER_NOT_FOUND = "User not found"
MSG_FAILED = "Checkout failed"


@dataclass
class CheckoutResult:
    decisions: DataFrame      # cart_id, decision, http_code, reason, total_price, rounds
    carts: DataFrame          # accepted carts / orders
    items: DataFrame          # their items
    bills: DataFrame          # bills / web bills
    incomes: DataFrame        # M3 'Sale' rows
    stock: DataFrame          # product id, quantity after all accepted carts
    rounds: int




def prefix_sums(df: DataFrame, key: str, order: list[str], values: dict[str, str], borders: DataFrame) -> DataFrame:
    """Exclusive running sums of ``values`` per ``key`` in ``order``.

    ``df`` is dealt by range (column ``_b``); ``borders`` are the keys that stand in several ranges.  The rows are
    shuffled once, on (key, range), for the window inside the range; the totals that are carried from range to range
    are those of the few keys on borders.
    """
    inside = Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.select("*", *[F.sum(v).over(inside).alias(f"_in_{o}") for o, v in values.items()])
    totals = of_borders(df, borders, [key]).groupBy(key, "_b").agg(*[F.sum(v).alias(f"_t_{o}") for o, v in values.items()])
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(key, "_b", *[F.sum(f"_t_{o}").over(before).alias(f"_c_{o}") for o in values])
    out = with_carry(sums, carry, [key, "_b"])
    return out.select(*df.columns, *[(F.coalesce(F.col(f"_c_{o}"), F.lit(0)) + F.coalesce(F.col(f"_in_{o}"), F.lit(0)))
                                     .alias(o) for o in values])


def checkout(requests: DataFrame, items: DataFrame, products: DataFrame, users: DataFrame | None = None,
             web: bool = False, ranges: int | None = None) -> CheckoutResult:
    """Decide a table of checkout requests against product stock.

    requests: cart_id, requested_at, status, payment_status, payment_method[, email]
    items:    cart_id, pos, product_id, quantity, unit_price   (one row per request item)
    products: id, quantity (current stock)
    users:    user_id, email  (web checkout: the buyer must exist, else 404 first)
    """
    spark = requests.sparkSession
    checkpoint_dir(spark)
    id_name = "order_id" if web else "cart_id"

    # -- static checks: user (web), required fields, missing / invalid items
    req = requests
    if web:
        u = users.select("email", "user_id").groupBy("email").agg(F.min("user_id").alias("user_id"))
        req = req.join(u, "email", "left")
    n_items = items.groupBy("cart_id").agg(
        F.count(F.lit(1)).alias("_n_items"),
        F.sum((F.col("quantity") * F.col("unit_price")).cast(MONEY_SUM)).alias("_total"))
    req = req.join(n_items, "cart_id", "left")
    missing_fields = (F.col("status").isNull() | (F.col("status") == "") | F.col("_n_items").isNull()
                      | F.col("payment_status").isNull())
    pre = F.when(missing_fields, F.lit(400))
    pre_reason = F.when(missing_fields, F.lit(MSG_MISSING_FIELDS))
    if web:
        pre = F.when(F.col("user_id").isNull(), F.lit(404)).otherwise(pre)
        pre_reason = F.when(F.col("user_id").isNull(), F.lit(MSG_USER_NOT_FOUND)).otherwise(pre_reason)
    req = req.withColumn("_pre", pre).withColumn("_pre_reason", pre_reason).checkpoint()

    stock = products.select(F.col("id").alias("product_id"), F.col("quantity").alias("_stock"))
    it = items.join(stock, "product_id", "left").withColumn(
        "_static", F.when(F.col("_stock").isNull(), F.lit(404))
                    .when(F.col("quantity").isNull() | F.col("unit_price").isNull() | (F.col("quantity") <= 0) | (F.col("unit_price") < 0), F.lit(500)))
    bad_carts = it.filter(F.col("_static").isNotNull()).select("cart_id").distinct()
    eligible = (req.filter(F.col("_pre").isNull()).select("cart_id", "requested_at")
                .join(bad_carts, "cart_id", "left_anti"))

    # -- lines: one per (cart, product); a line above the whole stock can never fit, so its cart goes before anything is dealt
    lines = (it.join(eligible, "cart_id", "inner").groupBy("cart_id", "requested_at", "product_id")
             .agg(F.sum("quantity").alias("q"), F.first("_stock").alias("s"))
             .withColumn("_never", F.max(F.col("q") > F.col("s")).over(Window.partitionBy("cart_id")))
             .filter(~F.col("_never")).drop("_never"))
    # the working set carries each line's cart status; refused carts and products without open carts leave it for good
    act = in_ranges(lines, ["product_id"], ["requested_at", "cart_id"], ranges).withColumn("st", F.lit("open"))
    borders = border_keys(act, ["product_id"])
    sold = ["product_id", "requested_at", "cart_id", "q"]
    rounds, before, taken = 0, None, [act.filter("false").select(*sold)]
    while True:
        n_open = act.filter(F.col("st") == "open").count()
        if n_open == 0:
            break
        if n_open == before:        # the earliest open line is always decided
            raise RuntimeError(f"a checkout round decided none of {n_open} open lines")
        before = n_open
        rounds += 1
        live = act.filter(F.col("st") == "open").select("product_id").distinct()
        work = (act.join(live, "product_id", "left_semi")
                .withColumn("w_lo", F.when(F.col("st") == "acc", F.col("q")).otherwise(F.lit(0))))
        pre_sums = prefix_sums(work, "product_id", ["requested_at", "cart_id"], {"U": "q", "L": "w_lo"}, borders)
        dec = (pre_sums.filter(F.col("st") == "open").groupBy("cart_id")
               .agg(F.bool_and((F.col("U") + F.col("q")) <= F.col("s")).alias("all_fit"),
                    F.bool_or((F.col("L") + F.col("q")) > F.col("s")).alias("any_fail"))
               .filter("all_fit or any_fail")
               .select("cart_id", F.when(F.col("all_fit"), F.lit("acc")).otherwise(F.lit("rej")).alias("new_st")))
        # all lines of a cart that was open are in ``work``: what is accepted now is read from this round's lines
        act = (work.join(dec, "cart_id", "left")
               .select(*[c for c in act.columns if c != "st"], F.coalesce(F.col("new_st"), F.col("st")).alias("st"),
                       (F.col("new_st") == "acc").alias("now"))
               .filter(F.col("st") != "rej")
               .checkpoint())
        taken.append(act.filter("now").select(*sold))
        act = act.drop("now")

    acc_lines = reduce(DataFrame.unionByName, taken)
    accepted = acc_lines.select("cart_id").distinct().checkpoint()

    # -- final replay for reasons: stock used by accepted carts before each cart, item by item
    used_tot = acc_lines.groupBy("product_id").agg(F.sum("q").alias("_used"))
    probe = (it.join(req.select("cart_id", "requested_at"), "cart_id", "inner")
             .join(accepted, "cart_id", "left_anti"))           # an accepted cart has no reason
    # usage before each cart = running sum of accepted lines in cart order (per product)
    marks = (acc_lines.select("product_id", "requested_at", "cart_id", F.col("q").alias("_w"))
             .unionByName(probe.select("product_id", "requested_at", "cart_id").distinct()
                          .withColumn("_w", F.lit(0).cast("long"))))
    marks = in_ranges(marks, ["product_id"], ["requested_at", "cart_id"], ranges)
    before = prefix_sums(marks, "product_id", ["requested_at", "cart_id"], {"_before": "_w"},
                         border_keys(marks, ["product_id"])).select("product_id", "cart_id", "_before")
    w_item = Window.partitionBy("cart_id", "product_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    chk = (probe.join(before, ["product_id", "cart_id"], "left")
           .withColumn("_cum", F.sum("quantity").over(w_item))
           .withColumn("_code", F.when(F.col("_static") == 404, F.lit(404))
                                 .when(F.col("_stock") < F.coalesce(F.col("_before"), F.lit(0)) + F.col("_cum"),
                                       F.lit(400))
                                 .when(F.col("_static") == 500, F.lit(500))))
    first_fail = (chk.filter(F.col("_code").isNotNull())
                  .groupBy("cart_id").agg(F.min(F.struct("pos", "_code", "product_id")).alias("_f")))
    reason = (F.when(F.col("_f._code") == 404, F.concat(F.lit("Product ID "), F.col("_f.product_id").cast("string"),
                                                        F.lit(" not found")))
               .when(F.col("_f._code") == 400, F.concat(F.lit("Insufficient stock for product ID "),
                                                        F.col("_f.product_id").cast("string")))
               .when(F.col("_f._code") == 500, F.lit(MSG_FAILED)))
    d = (req.join(accepted.withColumn("_acc", F.lit(True)), "cart_id", "left")
         .join(first_fail, "cart_id", "left"))
    code = (F.when(F.col("_pre").isNotNull(), F.col("_pre")).when(F.col("_acc"), F.lit(201))
             .otherwise(F.coalesce(F.col("_f._code"), F.lit(400))))
    why = F.when(F.col("_pre").isNotNull(), F.col("_pre_reason")).when(F.col("_acc"), F.lit(None)).otherwise(reason)
    decisions = d.select(F.col("cart_id").alias(id_name),
                         F.when(F.col("_acc"), F.lit("accepted")).otherwise(F.lit("rejected")).alias("decision"),
                         code.cast("int").alias("http_code"), why.alias("reason"),
                         money_out("_total").alias("total_price"))

    acc_req = req.join(accepted, "cart_id", "left_semi")
    carts = acc_req.select(F.col("cart_id").alias(id_name), *(["user_id"] if web else []),
                           money_out("_total").alias("total_price"), "status",
                           F.col("requested_at").alias("created_at"))
    acc_items = items.join(accepted, "cart_id", "left_semi").select(
        F.col("cart_id").alias(id_name), "pos", "product_id", "quantity", money_out("unit_price").alias("unit_price"))
    bill_id = "web_bill_id" if web else "bill_id"
    bills = acc_req.select(F.col("cart_id").alias(bill_id), F.col("cart_id").alias(id_name),
                           money_out("_total").alias("total_amount"), "payment_status", "payment_method",
                           F.col("requested_at").alias("generated_at"))
    incomes = sale_income_rows(acc_req.select(F.col("cart_id"), F.col("_total").alias("total"), "requested_at"),
                               id_name)
    stock_after = (products.select("id", "quantity")
                   .join(used_tot.withColumnRenamed("product_id", "id"), "id", "left")
                   .select("id", (F.col("quantity") - F.coalesce(F.col("_used"), F.lit(0))).alias("quantity")))
    return CheckoutResult(decisions, carts, acc_items, bills, incomes, stock_after, rounds)


def sale_income_rows(sales: DataFrame, id_name: str = "cart_id") -> DataFrame:
    """M3: a manual income row per sale: ('Sale', 'Bill for <id_name> N', total, date)."""
    return sales.select(F.lit("Sale").alias("type"),
                        F.concat(F.lit(f"Bill for {id_name} "), F.col("cart_id").cast("string")).alias("description"),
                        money_out("total").alias("amount"), F.to_date("requested_at").alias("income_date"))


def salary_expense_rows(salaries: DataFrame, employees: DataFrame) -> DataFrame:
    """M3: a manual expense row per salary payment: ('salary', 'Salary to <first last>', amount, date)."""
    e = employees.select(F.col("id").alias("employee_id"), "first_name", "last_name")
    j = salaries.join(e, "employee_id", "inner")
    return j.select(F.lit("salary").alias("type"),
                    F.concat(F.lit("Salary to "), F.coalesce(F.col("first_name").cast("string"), F.lit("null")),
                             F.lit(" "), F.coalesce(F.col("last_name").cast("string"), F.lit("null")))
                    .alias("description"),
                    money_out("salary_amount").alias("amount"), F.col("payment_date").alias("expense_date"))


def explode_items(requests: DataFrame, items_col: str = "items") -> DataFrame:
    """Request rows with an ``items`` array -> one row per item with its position."""
    return requests.select("cart_id", F.posexplode(items_col).alias("pos", "_it")).select(
        "cart_id", "pos", "_it.product_id", "_it.quantity", "_it.unit_price")
