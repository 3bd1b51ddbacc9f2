"""Updates of unique columns with the outcome of handling the requests one at a time.

A request sets some unique columns of one row.  It is refused while another
row holds one of its values; accepted, it takes its values and *frees* the old
ones, which later requests may take.  Outcomes therefore depend on the order
of requests that share values, directly or along a chain of rows.

1. Rows and values become numbers (64-bit hashes, found to be different for
   all different rows and values, else hashed anew with another seed).
2. Requests are dealt by range of request_id into slices of ``slice_rows`` in
   request order.  For every row and value of a slice the next slice that
   touches it is found, for all slices at once.
3. Slices are replayed one after another, each by one task in a plain loop
   over small integers.  A slice takes in the pairs of row and held value that
   its requests touch and hands each pair that is held at its end to the next
   slice that touches its row or its value; such pairs wait on disk.  So a
   task holds what its slice touches, whatever the number of requests.

All but the loop is spread over the cluster, and what the loop does for a
request is so little that finding groups of requests that don't touch each
other, to replay them side by side, took far longer than the loop.
"""

from __future__ import annotations

import functools
import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillpoint.session import checkpoint_dir

SLICE_ROWS = 1_000_000
NEVER = (1 << 31) - 1
MARK, TOUCH, PAIR, TURN, TAKEN = range(5)       # what a row of the folder is
EXTRA, STATIC = 1 << 8, 1 << 9                  # beside a pair's column in its flags
LOOP_ROWS = 100_000


def replay_unique(table: DataFrame, requests: DataFrame, key: str, columns: list[str],
                  provided: Column | None = None, acts: Column | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(request_id, taken): the columns whose values another row holds when a request's turn comes, if any.

    ``provided`` names the columns that a request sets (all, if not given); NULL values are free for all.  A
    request with taken columns is refused and changes nothing, nor does one for which ``acts`` is false (its row
    does not exist, say); what would be taken is told of it as well.  Without a row or a request_id none is taken.
    """
    spark = table.sparkSession
    folder = f"{checkpoint_dir(spark)}/replay-{uuid.uuid4()}"
    given = [F.lit(True) if provided is None else F.coalesce(F.array_contains(provided, c), F.lit(False)) for c in columns]
    acts = F.lit(True) if acts is None else F.coalesce(acts, F.lit(False))
    requests_with = requests.filter(F.col("request_id").isNotNull() & F.col(key).isNotNull())
    table = table.filter(F.col(key).isNotNull())
    row = F.concat(F.lit("k:"), F.col(key).cast("string"))
    values = [F.concat(F.lit(f"v:{c}="), F.col(c).cast("string")) for c in columns]
    asked = [F.when(g, v) for g, v in zip(given, values)]
    seed = _seed_without_clash(requests_with.select(F.explode(F.array(row, *asked)).alias("name")).unionByName(
        table.select(F.explode(F.array(row, *values)).alias("name"))))

    # flags: two bits a column, that it is set and that its value is not NULL, and above them whether the request acts
    flags = F.when(acts, F.lit(1 << 2 * len(columns))).otherwise(F.lit(0)).cast("long")
    for i, (g, v) in enumerate(zip(given, values)):
        flags = flags + F.when(g & v.isNotNull(), F.lit(3 << 2 * i)).when(g, F.lit(1 << 2 * i)).otherwise(F.lit(0))
    turns = requests_with.select(F.col("request_id").cast("long").alias("id"), _code(seed, row).alias("k"), flags.alias("flags"),
                                 *[_code(seed, v).alias(f"n{i}") for i, v in enumerate(values)]).filter(
        F.col("flags").bitwiseAND(F.lit((1 << 2 * len(columns)) - 1)) != 0)
    turns.write.parquet(f"{folder}-turns")
    turns = spark.read.schema(turns.schema).parquet(f"{folder}-turns")
    pairs = table.select(_code(seed, row).alias("k"), F.explode(F.array(*[F.struct(
        F.lit(i).cast("long").alias("col"), F.when(v.isNotNull(), _code(seed, v)).alias("n")) for i, v in enumerate(values)])).alias("x")
        ).select("k", "x.col", "x.n").filter(F.col("n").isNotNull())
    of_id = requests.schema["request_id"].dataType
    return (_replayed(turns, pairs, len(columns), folder, slice_rows).groupBy("id").agg(F.bit_or("flags").alias("flags"))
            .select(F.col("id").cast(of_id).alias("request_id"), F.filter(F.array(*[
                F.when(F.col("flags").bitwiseAND(F.lit(1 << columns.index(c))) != 0, F.lit(c)) for c in sorted(columns)]),
                lambda x: x.isNotNull()).alias("taken")))                   # at most one entry per unique column


def _code(seed: int, name: Column) -> Column:
    return F.xxhash64(F.lit(seed), name)


def _seed_without_clash(names: DataFrame) -> int:
    """The first seed with which all names have different codes."""
    names = names.filter(F.col("name").isNotNull()).distinct()
    return next(seed for seed in itertools.count() if names.groupBy(_code(seed, F.col("name")).alias("code")).count()
                .filter("count > 1").isEmpty())


def _replayed(turns: DataFrame, pairs: DataFrame, n: int, folder: str, slice_rows: int) -> DataFrame:
    """(id, flags) of the requests that have taken values when their turn comes, a bit a column, slice by slice."""
    spark = turns.sparkSession
    form = "part int, id long, k long, flags long, next_row int, next_value int, " + ", ".join(f"n{i} long" for i in range(n))
    slices = max(1, -(-turns.count() // slice_rows))
    _handed_on(_rows(turns.repartitionByRange(slices, "id").withColumn("slice", F.spark_partition_id()), form, TURN), folder)

    # the rows (flags 0) and values (1) of each slice, the next slice that touches them and whether (2) none did before
    dealt = spark.read.schema(f"{form}, slice int").parquet(folder)
    asked = [F.when(F.col("flags").bitwiseAND(F.lit(2 << 2 * i)) != 0, F.col(f"n{i}")) for i in range(n)]
    in_order = Window.partitionBy("kind", "h").orderBy("slice")
    touched = (dealt.select("slice", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("k").alias("h")),
                                                       *[F.struct(F.lit(1).alias("kind"), a.alias("h")) for a in asked])).alias("x"))
               .select("slice", "x.kind", "x.h").filter(F.col("h").isNotNull()).distinct()
               .select("*", F.lag("slice").over(in_order).isNull().alias("first"),
                       F.coalesce(F.lead("slice").over(in_order), F.lit(NEVER)).alias("next")).checkpoint())
    first_row = touched.filter("kind = 0 and first").select(F.col("h").alias("k"), F.col("slice").alias("next_row"))
    first_value = touched.filter("kind = 1 and first").select(F.col("h").alias("n"), F.col("slice").alias("next_value"))
    waits = touched.select(F.col("h").alias("k"), F.col("h").alias("n0"), F.col("kind").alias("flags"),
                           F.col("next").alias("next_row"), F.col("next").alias("next_value"), "slice")

    # values that are held at the start and asked for.  Of the rows without requests, one that holds a value tells as
    # much as all; a row that comes more often in the table may hold several values of a column (all but one are extra)
    held = pairs.join(first_value, "n").join(first_row, "k", "left").withColumn("static", F.col("next_row").isNull())
    of_row = Window.partitionBy("k", "col").orderBy("n")
    moving = (held.filter("not static").select("*", F.lag("n").over(of_row).alias("before"))
              .filter(F.col("before").isNull() | (F.col("before") != F.col("n")))
              .withColumn("flags", F.col("col") + F.when(F.col("before").isNull(), 0).otherwise(EXTRA)))
    static = (held.filter("static").groupBy("n", "col", "next_value").agg(F.min("k").alias("k"))
              .withColumn("flags", F.col("col") + STATIC).withColumn("next_row", F.lit(NEVER)))
    begin = moving.select("k", "n", "flags", "next_row", "next_value").unionByName(
        static.select("k", "n", "flags", "next_row", "next_value")).withColumnRenamed("n", "n0").withColumn(
        "slice", F.least("next_row", "next_value"))
    marks = spark.range(-1, slices).select(F.col("id").cast("int").alias("slice"))             # no folder is missing
    _handed_on(_rows(waits, form, TOUCH).unionByName(_rows(begin, form, PAIR)).unionByName(_rows(marks, form, MARK))
               .repartition(slices, "slice"), folder)

    replay = functools.partial(_replay, n)
    for i in range(slices):
        now = spark.read.schema(form).parquet(f"{folder}/slice={i}").coalesce(1)
        _handed_on(now.mapInArrow(replay, f"{form}, slice int"), folder)
    return spark.read.schema(form).parquet(f"{folder}/slice=-1").filter(F.col("part") == TAKEN).select("id", "flags")


def _rows(df: DataFrame, form: str, part: int) -> DataFrame:
    """``df`` as rows of the folder, 0 where it lacks a column."""
    pairs = [x.split(" ") for x in form.split(", ")]
    df = df.withColumn("part", F.lit(part))
    return df.select(*[(F.col(c) if c in df.columns else F.lit(0)).cast(t).alias(c) for c, t in pairs], F.col("slice").cast("int"))


def _handed_on(df: DataFrame, folder: str) -> None:
    """Appends rows to the folder of their slice: what the slice has to know; in -1 what is taken."""
    df.write.mode("append").partitionBy("slice").parquet(folder)


def _replay(n: int, batches):
    """The rows of a slice: turns (requests), what they touch, and the pairs of row and value held when it begins."""
    names = ["part", "id", "k", "flags", "next_row", "next_value", *[f"n{i}" for i in range(n)]]
    batches = list(batches)
    all_rows = {c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches]) for c in names} if batches else {}
    del batches
    if not all_rows:
        return
    of = lambda part: {c: x[all_rows["part"] == part] for c, x in all_rows.items()}
    touch, pair, turn = of(TOUCH), of(PAIR), of(TURN)
    del all_rows
    order = np.argsort(turn["id"], kind="stable")
    if np.any(np.diff(turn["id"][order]) == 0):         # ids that come twice have some order of their own
        order = np.lexsort((*[turn[f"n{i}"] for i in range(n)], turn["flags"], turn["k"], turn["id"]))
    turn = {c: x[order] for c, x in turn.items()}

    # rows and values as places in sorted arrays
    k_of, place = np.unique(np.concatenate([turn["k"], pair["k"]]), return_inverse=True)
    k_turn, k_pair = np.split(place, [len(turn["k"])])
    asks = [turn["flags"] >> 2 * i & 3 for i in range(n)]
    n_of, place = np.unique(np.concatenate([*[turn[f"n{i}"][a == 3] for i, a in enumerate(asks)], pair["n0"]]), return_inverse=True)
    *n_turn, n_pair = np.split(place, np.cumsum([np.count_nonzero(a == 3) for a in asks]))
    next_row, next_value = np.full(len(k_of), NEVER), np.full(len(n_of), NEVER)
    next_row[k_pair], next_value[n_pair] = pair["next_row"], pair["next_value"]
    is_value = touch["flags"] == 1
    next_row[np.searchsorted(k_of, touch["k"][~is_value])] = touch["next_row"][~is_value]
    next_value[np.searchsorted(n_of, touch["n0"][is_value])] = touch["next_value"][is_value]

    # how many rows hold a value, and the value of a row in each column (place k * n + column; -1: none)
    holders = np.bincount(n_pair, minlength=len(n_of)).tolist()
    static, plain = pair["flags"] & STATIC != 0, pair["flags"] < EXTRA
    own = np.full(len(k_of) * n, -1)
    own[k_pair[plain] * n + pair["flags"][plain]] = n_pair[plain]
    own = own.tolist()
    others = ~static & ~plain
    extra = set(zip((k_pair[others] * n + (pair["flags"][others] & ~EXTRA)).tolist(), n_pair[others].tolist()))

    # the value that a request sets in each column (-1: NULL), and the first column that it sets
    wanted = []
    for a, x in zip(asks, n_turn):
        column = np.full(len(a), -1)
        column[a == 3] = x
        wanted.append(column)
    is_set = np.array([a > 0 for a in asks])
    first, several = is_set.argmax(axis=0), is_set.sum(axis=0) > 1
    wanted = np.array(wanted)
    acts = turn["flags"] >> 2 * n & 1

    def out(part, slices, **columns):
        size = len(slices)
        columns |= {"part": np.full(size, part), "slice": slices}
        types = dict(zip(names, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()))) | {"slice": pa.int32()}
        for at in range(0, size, LOOP_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(columns[c][at:at + LOOP_ROWS] if c in columns else np.zeros(
                min(LOOP_ROWS, size - at), "int64")).cast(types.get(c, pa.int64())) for c in [*names, "slice"]], [*names, "slice"])

    def take(s, x):
        old = own[s]
        if old >= 0:
            holders[old] -= 1
        if x >= 0:
            if extra and (s, x) in extra:
                extra.remove((s, x))
                holders[x] -= 1
            holders[x] += 1
        own[s] = x

    for at in range(0, len(acts), LOOP_ROWS):
        part = slice(at, at + LOOP_ROWS)
        told, masks = [], []
        more = [None] * len(first[part])
        some = np.flatnonzero(several[part])
        i, c = np.nonzero(is_set[:, part][:, some].T)
        sets = list(zip((k_turn[part][some][i] * n + c).tolist(), wanted[:, part][c, some[i]].tolist()))
        ends = np.cumsum(np.bincount(i, minlength=len(some))).tolist()
        for i, a, z in zip(some.tolist(), [0, *ends], ends):
            more[i] = sets[a:z]
        for r, s, x, moves, sets in zip(turn["id"][part].tolist(), (k_turn[part] * n + first[part]).tolist(),
                                        wanted[:, part][first[part], np.arange(len(more))].tolist(), acts[part].tolist(), more):
            if sets is None:
                if x >= 0 and (h := holders[x]) and (h > 1 or own[s] != x and not (extra and (s, x) in extra)):
                    told.append(r)
                    masks.append(1 << s % n)
                elif moves and own[s] != x:
                    take(s, x)
                continue
            mask = 0
            for s, x in sets:
                if x >= 0 and (h := holders[x]) and (h > 1 or own[s] != x and not (extra and (s, x) in extra)):
                    mask |= 1 << s % n
            if mask:
                told.append(r)
                masks.append(mask)
            elif moves:
                for s, x in sets:
                    take(s, x)
        yield from out(TAKEN, np.full(len(told), -1), id=np.array(told, "int64"), flags=np.array(masks, "int64"))

    # what is held now and touched later
    own = np.array(own, "int64")
    s = np.concatenate([k_pair[static] * n, np.flatnonzero(own >= 0), np.array([s for s, _ in extra], "int64")])
    ns = np.concatenate([n_pair[static], own[own >= 0], np.array([x for _, x in extra], "int64")])
    flags = np.concatenate([pair["flags"][static], np.flatnonzero(own >= 0) % n, np.array([s % n | EXTRA for s, _ in extra], "int64")])
    ks = s // n
    slices = np.minimum(next_row[ks], next_value[ns])
    later = slices < NEVER
    ks, ns, flags, slices = (x[later] for x in (ks, ns, flags, slices))
    yield from out(PAIR, slices, k=k_of[ks], n0=n_of[ns], flags=flags, next_row=next_row[ks], next_value=next_value[ns])


def last_set(requests: DataFrame, key: str, columns: list[str], provided: Column | None = None) -> DataFrame:
    """One row per key: for every column whether any request sets it (``_s_c``) and the value of the last that does."""
    def given(c: str) -> Column:
        return F.lit(True) if provided is None else F.array_contains(provided, c)
    rows = requests.select("request_id", key, *[F.when(given(c), F.struct(F.col(c).alias("v"))).alias(f"_p_{c}") for c in columns])
    return rows.groupBy(key).agg(*[F.max_by(f"_p_{c}", F.when(F.col(f"_p_{c}").isNotNull(), F.col("request_id"))).alias(f"_p_{c}")
                                   for c in columns]).select(
        key, *[F.col(f"_p_{c}").isNotNull().alias(f"_s_{c}") for c in columns],
        *[F.col(f"_p_{c}.v").alias(f"_n_{c}") for c in columns])
