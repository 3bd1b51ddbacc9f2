"""As-of lookup: for each left row, the latest right row at or before its time.

Spark has no as-of join.  A window over the union of both sides partitioned by
the key alone would put a hot key (say one e-mail with a third of all rows)
into one task, so the union is dealt by range over (key, time, side, row)
(``functions.ordering``): a hot key spans many ranges.

1. inside one (key, range) the left and right rows are ordered by time and
   the latest right row so far is taken;
2. where a key stands in several ranges -- at most one key per border -- the
   latest right row of each (key, range) is a ``max_by`` aggregate, and a
   running ``last`` over these few rows is what a range gets carried in.

Rows at equal times: right rows count as "at or before" the left row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tillpoint.functions.ordering import border_keys, in_ranges, of_borders, with_carry


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str,
              right_cols: list[str], right_order: list[str] | None = None,
              ranges: int | None = None, name: str = "asof") -> DataFrame:
    """Left rows plus ``name``: struct of the governing right row (NULL if none).

    ``right_order`` breaks ties between right rows at the same time (later
    wins); it defaults to ``right_cols``.
    """
    right_order = right_order or right_cols
    rstruct = F.struct(*[F.col(c) for c in right_cols])
    rkey = F.struct(F.col(right_time).alias("_t"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(right_order)])

    r0 = right.select(*by, F.col(right_time).alias("_t"), rkey.alias("_rk"), rstruct.alias("_r"))
    lcols = left.columns
    l0 = left.select(*by, F.col(left_time).alias("_t"), F.struct(*[F.col(c) for c in lcols]).alias("_l"))
    kinds = {c: r0.schema[c].dataType for c in ("_rk", "_r")} | {"_l": l0.schema["_l"].dataType}
    none = {c: F.lit(None).cast(k).alias(c) for c, k in kinds.items()}
    both = (r0.select(*by, "_t", F.lit(0).alias("_tag"), "_rk", "_r", none["_l"])
            .unionByName(l0.select(*by, "_t", F.lit(1).alias("_tag"), none["_rk"], none["_r"], "_l"))
            .withColumn("_n", F.xxhash64("_rk", "_l")))         # rows of one time may lie in several ranges
    dealt = in_ranges(both, by, ["_t", "_tag", "_rk", "_n"], ranges)

    # latest right row at or before each left row, inside a range
    inside = (Window.partitionBy(*by, "_b").orderBy("_t", "_tag", "_rk")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = dealt.withColumn("_in", F.last("_r", ignorenulls=True).over(inside)).filter(F.col("_tag") == 1)

    # what the ranges before hold, for the keys that go over a border
    parts = of_borders(dealt, border_keys(dealt, by), by).groupBy(*by, "_b").agg(
        F.max_by("_r", F.when(F.col("_tag") == 0, F.col("_rk"))).alias("_last"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(*by, "_b", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    out = with_carry(out, carry, [*by, "_b"])
    return out.select(*[F.col("_l")[c].alias(c) for c in lcols], F.coalesce("_in", "_carry").alias(name))
