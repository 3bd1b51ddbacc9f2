"""Hard negatives by slot-decomposed selection.

An anchor's positives are its best rows of the same label.  Each positive has
a window of scores, from ``low`` to ``high`` hundredths of its own; the
windows of one anchor overlap.  Their upper limits, in falling order, cut the
scores into disjoint slots: slot j holds the scores above the limit of
positive j + 1 and up to that of positive j.

1. Every task scores its candidates against the anchors and keeps the best
   ``keep`` of each (anchor, slot) (combiners), so an anchor sends that many
   rows per slot and task, however many candidates tie.
2. The best of each (anchor, slot) over all tasks are found by their order.
3. A positive's window is its own slot and all lower ones, down to its lower
   limit: merging the slots from its own one downwards, the first ``keep``
   scores within the limit are its answer.  The best of each slot are enough,
   as windows reach down without gaps.

Anchors go to the tasks in groups of at most ``GROUP_BYTES`` (with their ids,
labels and limits), the bound of what the driver and the workers hold;
100,000 anchors of 64 components are one group.  Each group takes one pass for
the positives and one for the negatives.

Defined results: rows with a null id, a null label, a null vector or a null or
non-finite component take no part; components become floor(scale * x) and must
then fit 32 bits (an error otherwise); repeated ids are rows of their own, and
a row is never its own positive; a shorter vector counts zeros at its end;
fewer positives or negatives than asked for give all; anchors without
positives give no rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tillpoint.llm.common import pick, record_batch, written
from tillpoint.llm.topk import _scores

GROUP_BYTES = 64 << 20
BLOCK = 1024                # candidates and anchors are scored in blocks of so many of each
ANCHOR = "anchor long, pos int, slot int, row long, id long, score long"


def taking_part(vectors: DataFrame, id_col: str, vec_col: str, label: Column, scale: int) -> DataFrame:
    """(row, id, label, vec array<int>): a number of its own, the integer components."""
    whole = F.transform("vec", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                    & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"),
                          F.col(f"`{vec_col}`").alias("vec"))
    return (rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & fine)
            .select(F.monotonically_increasing_id().alias("row"), "id", "label",
                    F.transform(whole, lambda x: x.cast("int")).alias("vec")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, zeros behind the end of a shorter one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().to_numpy()
    ends = ends.astype(np.int64)
    if len(ends) and (ends == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(ends), width), np.int64)
    row = np.repeat(np.arange(len(ends)), ends)
    at = np.arange(len(values)) - np.repeat(np.cumsum(ends) - ends, ends)
    inside = at < width                             # what goes on beyond every anchor meets zeros
    out[row[inside], at[inside]] = values[inside]
    return out


class Best:
    """The first ``keep`` of each group by falling score, then id, then row."""

    def __init__(self, keep: int):
        self.keep = keep
        self.group, self.score, self.id, self.row = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, group, score, ids, rows) -> None:
        group, score, ids, rows = (np.concatenate(x) for x in zip(
            (self.group, self.score, self.id, self.row), (group, score, ids, rows)))
        order = np.lexsort((rows, ids, -score, group))
        group = group[order]
        nth = np.arange(len(group)) - np.searchsorted(group, group)
        order = order[nth < self.keep]
        self.group, self.score, self.id, self.row = group[nth < self.keep], score[order], ids[order], rows[order]


def best_per_task(cands: DataFrame, group, keep: int, slots: int, wanted) -> DataFrame:
    """Rows (anchor, slot, row, id, score) that a task keeps; ``wanted(scores, labels, rows, block)`` gives the slot
    of each (candidate, anchor) of a block of anchors, or -1."""
    schema = "anchor int, slot int, row long, id long, score long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        held = group.value
        best = Best(keep)
        width = held["vec"].shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                row, ids, labels = (part.column(c).to_numpy() for c in ("row", "id", "label"))
                vec = matrix(part.column("vec"), width)
                for b in range(0, len(held["row"]), BLOCK):
                    block = {k: v[b:b + BLOCK] for k, v in held.items()}
                    score = _scores(vec, block["vec"])
                    slot = wanted(score, labels[:, None], row[:, None], block)
                    c, a = np.nonzero(slot >= 0)
                    if len(c):
                        best.add((a + b) * slots + slot[c, a], score[c, a], ids[c], row[c])
        yield record_batch({"anchor": (best.group // slots).astype(np.int32), "slot": (best.group % slots).astype(np.int32),
                            "row": best.row, "id": best.id, "score": best.score}, arrow)
    return cands.mapInArrow(run, schema)


def first(rows: DataFrame, keep: int, *by: str) -> DataFrame:
    """The first rows of each group, ranked; a group has at most ``keep`` rows per task."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "row")
    return rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= keep)


def hard_negatives(vectors: DataFrame, positives: int = 5, keep: int = 5, low: int = 80, high: int = 100, every: int = 100,
                   id_col: str = "vec_id", vec_col: str = "embedding", label: Column | str = "label", scale: int = 256,
                   group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``; a positive's negatives are the first ``keep`` rows of
    other labels with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    spark = vectors.sparkSession
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    cands = written(taking_part(vectors, id_col, vec_col, label, scale), "vectors")
    anchors = cands.filter(F.pmod("id", F.lit(every)) == 0)
    seen = anchors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    if not seen["n"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")
    row_bytes = 8 * (seen["width"] + 4 + positives)
    groups = -(-seen["n"] * row_bytes // group_bytes)
    out = None
    for g in range(groups):
        part = anchors if groups == 1 else anchors.filter(F.pmod(F.xxhash64("row"), F.lit(groups)) == g)
        part = _of_group(cands, part, seen["width"], positives, keep, low, high)
        if part is not None:
            part = part if groups == 1 else written(part, "negatives")
            out = part if out is None else out.unionByName(part)
    return out


def _of_group(cands: DataFrame, anchors: DataFrame, width: int, positives: int, keep: int, low: int, high: int
              ) -> DataFrame | None:
    spark = cands.sparkSession
    own = anchors.orderBy("row").toArrow()          # one group: GROUP_BYTES on average
    if not own.num_rows:
        return None
    held = {"row": own.column("row").to_numpy(), "id": own.column("id").to_numpy(), "label": own.column("label").to_numpy(),
            "vec": matrix(own.column("vec"), width)}
    group = spark.sparkContext.broadcast(held)

    def alike(score, labels, rows, block):
        return np.where((labels == block["label"]) & (rows != block["row"]), 0, -1)
    found = written(first(best_per_task(cands, group, positives, 1, alike), positives, "anchor").select(
        "anchor", F.col("nth").alias("pos"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
        "positives")
    # limits of the windows, falling; a window of no score is below all
    none = np.iinfo(np.int64).min
    upper = np.full((own.num_rows, positives), none)
    lower = np.full((own.num_rows, positives), np.iinfo(np.int64).max)
    got = found.toArrow()                           # at most ``positives`` rows per anchor of the group
    a, p, s = (got.column(c).to_numpy() for c in ("anchor", "pos", "positive_score"))
    upper[a, p - 1], lower[a, p - 1] = high * s // 100, -(-low * s // 100)
    limits = spark.sparkContext.broadcast(held | {"upper": upper, "lower": lower.min(axis=1)})

    def other(score, labels, rows, block):
        slot = np.full(score.shape, -1, np.int8)
        for j in range(positives):                  # the last limit that a score does not pass is its slot
            slot += score <= block["upper"][:, j]
        return np.where((labels != block["label"]) & (score >= block["lower"]), slot, -1)
    slots = first(best_per_task(cands, limits, keep, positives, other), keep, "anchor", "slot")
    # slot of positive ``pos`` is pos - 1; windows merge it with the lower ones
    merged = (found.join(slots.drop("nth"), "anchor")
              .filter((F.col("slot") >= F.col("pos") - 1) & (100 * F.col("score") <= high * F.col("positive_score"))
                      & (100 * F.col("score") >= low * F.col("positive_score"))))
    names = own.select(["id"]).append_column("anchor", pa.array(np.arange(own.num_rows), pa.int32()))
    ranked = first(merged, keep, "anchor", "pos")
    ids = spark.createDataFrame(names).withColumnRenamed("id", "anchor_id")
    return ranked.join(ids, "anchor").select(
        "anchor_id", "positive_id", F.col("nth").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
