"""Money and percentage expressions.

Money is DECIMAL(10,2) in tables; sums widen to DECIMAL(20,2).  Values leave
the library as DOUBLE (``money_out``) so every consumer sees the same type.
Percentages follow the reference's numeric rules: ROUND(x, 2) half away from
zero on exact decimals, NULLIF on the divisor (ANSI division by zero raises).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONEY = "decimal(10,2)"
MONEY_SUM = "decimal(20,2)"


def to_money(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(MONEY)


def money_out(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("double")


def zero_money() -> Column:
    return F.lit(0).cast(MONEY_SUM)


def pct_change(cur: Column, last: Column) -> Column:
    """ROUND((cur - last) / NULLIF(last, 0) * 100, 2) on decimals; NULL when last is 0/NULL."""
    cur_d = cur.cast("decimal(20,2)")
    last_d = last.cast("decimal(20,2)")
    return F.round((cur_d - last_d) / F.nullif(last_d, F.lit(0).cast("decimal(20,2)")) * F.lit(100), 2)


def count_pct_change(cur: Column, last: Column) -> Column:
    """ROUND((cur - last) * 100.0 / NULLIF(last, 0), 2) for counts."""
    return F.round((cur - last) * F.lit(100.0).cast("decimal(4,1)")
                   / F.nullif(last, F.lit(0)).cast("decimal(20,0)"), 2)


def zero_rule(cur: Column, last: Column, pct: Column, hundred_on_growth: bool) -> Column:
    """Percent with the reference's zero rules.

    last = 0 and cur > 0 -> 100 when ``hundred_on_growth``; last = 0 -> 0;
    otherwise ``pct``.  NULLs count as 0.
    """
    last0 = F.coalesce(last, F.lit(0)) == 0
    cur_pos = F.coalesce(cur, F.lit(0)) > 0
    expr = F.when(last0 & cur_pos, F.lit(100 if hundred_on_growth else 0)).when(last0, F.lit(0))
    return expr.otherwise(pct).cast("double")


def items_total(items: Column | str, quantity: str = "quantity", unit_price: str = "unit_price") -> Column:
    """sum(quantity * unit_price) over an array of item structs, in decimal.

    The accumulator is cast back to DECIMAL(20,2) inside the lambda, as Spark
    requires the fold's type to stay fixed.
    """
    items = F.col(items) if isinstance(items, str) else items
    return F.aggregate(items, F.lit(0).cast(MONEY_SUM),
                       lambda acc, it: (acc + it[quantity] * it[unit_price]).cast(MONEY_SUM))


def apply_defaults(df, defaults: dict):
    """column defaults at insert time (DEFAULT NOW(), FALSE, 'active', 'Pending' ...)."""
    for c, v in defaults.items():
        val = v if isinstance(v, Column) else F.lit(v)
        df = df.withColumn(c, F.coalesce(F.col(c), val) if c in df.columns else val)
    return df
