"""Sharding by jump consistent hashing, in DataFrame functions only.

A stable key and the number of shards decide a row's shard: the key seeds a
64-bit linear congruential sequence, and the row jumps forward from shard to
shard until a jump passes the last one (Lamping and Veach, "A Fast, Minimal
Memory, Consistent Hash Algorithm").  No ring table is kept, and appending a
shard moves a row only into the new shard.

Rows of a shard are numbered without a gap.  A shard holds a fixed share of
all rows, so no window runs over a whole shard: rows are dealt by ranges of
the key, numbered inside (range, shard), and the numbers are shifted by the
counts of the earlier ranges, a table of ranges x shards rows.

Defined results: a null key hashes like the empty text; a null payload has
size 1; repeated rows share a shard and get different slots; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillpoint.llm.common import md5_hex, pick

# Fixed values of the published algorithm: the multiplier, in limbs of 24, 24 and 16 bits.
MULTIPLIER = 2862933555777941757
LOW, MID, HIGH = MULTIPLIER & 0xFFFFFF, MULTIPLIER >> 24 & 0xFFFFFF, MULTIPLIER >> 48


def jump_hash(key: Column, shards: list[int]) -> Column:
    """Struct of the shard for each number of shards in ``shards`` (fields ``s<number>``), from one sequence.

    The 64-bit state is kept in three limbs, whose products stay below 2**50,
    so the arithmetic never overflows under ANSI rules.
    """
    most = max(shards)
    digest = md5_hex(key)

    def limb(start: int, length: int) -> Column:
        return F.conv(F.substring(digest, start, length), 16, 10).cast("long")

    names = [f"s{n}" for n in shards]
    begin = F.struct(limb(11, 6).alias("k0"), limb(5, 6).alias("k1"), limb(1, 4).alias("k2"),
                     F.lit(0).cast("long").alias("j"), *[F.lit(0).cast("long").alias(n) for n in names])

    def step(s: Column, _) -> Column:
        r0 = s["k0"] * LOW + 1
        r1 = s["k0"] * MID + s["k1"] * LOW + F.shiftright(r0, 24)
        r2 = s["k0"] * HIGH + s["k1"] * MID + s["k2"] * LOW + F.shiftright(r1, 24)
        k0, k1, k2 = (r.bitwiseAND(F.lit(m).cast("long")) for r, m in ((r0, 0xFFFFFF), (r1, 0xFFFFFF), (r2, 0xFFFF)))
        top = F.shiftleft(k2, 15) + F.shiftright(k1, 9)
        jump = F.floor((s["j"] + 1) * (F.lit(2147483648.0) / (top + 1).cast("double"))).cast("long")
        moved = F.struct(k0.alias("k0"), k1.alias("k1"), k2.alias("k2"), jump.alias("j"),
                         *[F.when(s["j"] < n, s["j"]).otherwise(s[name]).alias(name) for n, name in zip(shards, names)])
        return F.when(s["j"] < most, moved).otherwise(s)

    end = F.aggregate(F.sequence(F.lit(0), F.lit(most)), begin, step)
    return F.struct(*[end[n].cast("int").alias(n) for n in names])


def assign_shards(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", payload: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard): ``grown_shard`` is the shard among one more."""
    text = F.col("payload").cast("binary")
    rows = pick(docs, key=key, payload=payload).select(
        F.col("key"), (F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"))
    # the last sort column lets the range partitioner cut through repeated keys
    dealt = (rows.withColumn("row", F.monotonically_increasing_id())
             .repartitionByRange("key", "text_crc32", "size", "row")
             .withColumn("jump", jump_hash(F.col("key"), [n_shards, n_shards + 1]))
             .select("key", "size", "text_crc32", "row", F.col(f"jump.s{n_shards}").alias("shard"),
                     F.col(f"jump.s{n_shards + 1}").alias("grown_shard"), F.spark_partition_id().alias("part"))
             .checkpoint())
    counts = dealt.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("part", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("part", "shard").orderBy("key", "text_crc32", "size", "row")
    return (dealt.withColumn("nth", F.row_number().over(inside)).join(shift, ["part", "shard"])
            .select(F.col("key").alias(key), "size", "text_crc32", "shard",
                    (F.col("shift") + F.col("nth") - 1).cast("long").alias("slot"), "grown_shard"))
