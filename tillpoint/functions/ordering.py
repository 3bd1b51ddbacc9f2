"""Ranges in key order for running sums and as-of lookups on skewed keys.

A running sum per key needs the key's rows in order.  A window over the key
alone puts a key with a third of all rows into one task, so rows are dealt by
range over (key, order): a key with many rows spans several ranges, whatever
the times of its rows, as the order ends with an id.  Inside a range a window
does the work; what goes over from one range to the next concerns only the
keys that stand on a border, at most one per border.

The same way is taken at every size.  The dealt rows are checkpointed, so the
number of a row's range is fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillpoint.session import checkpoint_dir


def in_ranges(df: DataFrame, keys: list[str], order: list[str], ranges: int | None = None, name: str = "_b") -> DataFrame:
    """``df`` with the number of its range as a LONG column, which never falls along (keys, order)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys, *order).withColumn(name, F.spark_partition_id().cast("long")).checkpoint()


def border_keys(dealt: DataFrame, keys: list[str], name: str = "_b") -> DataFrame:
    """The keys that stand in more than one range: at most one row per range."""
    key = F.struct(*keys)
    ends = dealt.groupBy(name).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    both = ends.select(name, F.col("lo").alias("k")).unionByName(ends.select(name, F.col("hi").alias("k")))
    return (both.groupBy("k").agg(F.min(name).alias("a"), F.max(name).alias("z")).filter("a < z").select("k.*").checkpoint())


def of_borders(dealt: DataFrame, borders: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the keys on borders; ``borders`` has at most one row per range, so it is broadcast."""
    b = borders.select(*[F.col(k).alias(f"_border_{k}") for k in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_border_{k}"))
    return dealt.join(F.broadcast(b), on, "left_semi")


def with_carry(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` left joined with what each (keys) has carried in: at most two rows per range, so it is broadcast."""
    c = carry.select(*[F.col(k).alias(f"_carry_{k}") for k in keys], *[x for x in carry.columns if x not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_carry_{k}"))
    return rows.join(F.broadcast(c), on, "left").drop(*[f"_carry_{k}" for k in keys])
