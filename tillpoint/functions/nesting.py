"""Nested documents: group item rows into an array of structs per parent key.

Replaces the reference's N+1 per-row lookups and its JS grouping loops with
one aggregation.  ``nest`` gives one row per parent with its whole list, at
every size, as the SQL does; ``nest_parts`` gives (parent, part_no, part of the
list), also at every size, for callers that can take a list in parts, so that
no task or row holds an unbounded list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DEFAULT_MAX_ITEMS = 50_000
BUCKETS = 1024


def nest(items: DataFrame, keys: list[str], fields: list[str], name: str, max_items: int | None = None) -> DataFrame:
    """(keys..., name: array<struct<fields>>) sorted by the struct fields in order; in parts if ``max_items`` is given."""
    if max_items is not None:
        return nest_parts(items, keys, fields, name, max_items)
    return items.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def nest_parts(items: DataFrame, keys: list[str], fields: list[str], name: str,
               max_items: int = DEFAULT_MAX_ITEMS) -> DataFrame:
    """(keys..., part_no, name): lists of ``max_items`` items, the last part of a parent has the rest.

    Equal items are counted first.  Distinct items are numbered inside (parent, bucket of their hash) behind the
    counts of the buckets before, so a hot parent is numbered and grouped by many tasks.
    """
    item = F.struct(*fields)
    counted = (items.groupBy(*keys, item.alias("_item")).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_h", F.xxhash64("_item")).withColumn("_bucket", F.pmod("_h", F.lit(BUCKETS))))
    sizes = counted.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"),
                           F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))     # BUCKETS rows a parent
    same = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_h", "_item").rowsBetween(Window.unboundedPreceding, -1)
    first, bound = F.col("_first"), F.lit(max_items)
    placed = (counted.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(offsets, same)
              .withColumn("_first", F.col("_before") + F.col("_inside")).withColumn("_end", first + F.col("_n"))
              .withColumn("part_no", F.explode(F.sequence(F.floor(first / bound), F.floor((F.col("_end") - 1) / bound)))))
    copies = F.least(F.col("_end"), (F.col("part_no") + 1) * bound) - F.greatest(first, F.col("part_no") * bound)
    return (placed.select(*keys, "part_no", F.explode(F.array_repeat("_item", copies.cast("int"))).alias("_item"))
            .repartition(*keys, "part_no").groupBy(*keys, "part_no")
            .agg(F.sort_array(F.collect_list("_item")).alias(name)))


def nested_text(c: Column | str, fields: list[str], sep: str = "; ") -> Column:
    """Canonical text of an array of structs: 'f1|f2|...' per element, joined by ``sep``.

    Used to compare nested documents with SQL engines that render nested
    values differently.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(
        F.transform(c, lambda e: F.concat_ws("|", *[F.coalesce(e[f].cast("string"), F.lit("null"))
                                                    for f in fields])), sep)
