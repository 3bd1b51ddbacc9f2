"""Exact top-k search by distributed histogram selection.

Every (query, candidate) pair is scored in blocks.  For each query the kth
largest score is located by a global histogram of its scores: all tasks count
their scores in equal bins of the query's current interval, Spark sums the
counts, the bin that holds the kth score becomes the next interval, and after
a few rounds the bin is one integer wide.  A last pass keeps the scores above
that value and, of those equal to it, the smallest ids; so at most k rows per
query leave each batch, however many candidates tie.

A task sends only its own top bins of a query: those below the bin where its
own count reaches what is still needed cannot hold the global kth score.

Queries come in blocks of a fixed number of vectors: the driver holds one
block at a time and broadcasts it (block_rows x dimension integers).  What
goes through the driver per round is one row per query of the block.

Defined results: components become floor(scale * x); a vector that is null or
holds a null or non-finite component takes no part; rows that repeat
an id are candidates each, and as queries the smallest of their vectors asks
once; a shorter vector is padded with zeros; a query never finds its own id; fewer candidates than k give all; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tillpoint.llm.common import pick, written

BLOCK_ROWS = 2048
BINS = 1024
SLICE = 2048


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, vec array<bigint>) of the vectors that take part, one row for each of theirs."""
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                    & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = pick(vectors, id=id_col, vec=vec_col).filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & fine)
    whole = F.transform("vec", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return rows.select("id", whole.alias("vec"))


def _matrix(vecs, width: int) -> np.ndarray:
    out = np.zeros((len(vecs), width), np.int64)
    for i, v in enumerate(vecs):
        out[i, : min(width, len(v))] = v[:width]
    return out


def _scores(cand: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products, candidates x queries: in floating point only where every sum is below 2**53."""
    most = float(np.abs(cand).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, query.shape[1])
    if most < 2 ** 53:
        return np.rint(cand.astype(np.float64) @ query.astype(np.float64).T).astype(np.int64)
    return cand @ query.T


def _slices(frames, width: int):
    for pdf in frames:
        for at in range(0, len(pdf), SLICE):
            part = pdf.iloc[at:at + SLICE]
            yield part["id"].to_numpy(np.int64), _matrix(part["vec"].to_list(), width)


def _histograms(block, lo, size, step, need):
    """mapInPandas function: (q, bin, n) of this task's scores in each query's interval [lo, lo + size)."""
    ids, query = block.value

    def run(frames):
        counts = np.zeros((len(ids), BINS), np.int64)
        for cid, cand in _slices(frames, query.shape[1]):
            s = _scores(cand, query)
            bins = (s - lo) // step
            use = (s >= lo) & (s < lo + size) & (cid[:, None] != ids[None, :])
            flat = (np.arange(len(ids)) * BINS + bins)[use]
            counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts     # in higher bins of this task
        q, b = np.nonzero((counts > 0) & (above < need[:, None]))
        yield pd.DataFrame({"q": q.astype(np.int32), "bin": b.astype(np.int32), "n": counts[q, b]})
    return run


def _winners(block, kth, need):
    """mapInPandas function: scores above the kth value, and of those equal to it the smallest ids."""
    ids, query = block.value

    def run(frames):
        for cid, cand in _slices(frames, query.shape[1]):
            s = _scores(cand, query)
            other = cid[:, None] != ids[None, :]
            c, q = np.nonzero((s > kth) & other)
            tc, tq = np.nonzero((s == kth) & other)
            if len(tc):
                order = np.lexsort((cid[tc], tq))
                tc, tq = tc[order], tq[order]
                nth = np.arange(len(tq)) - np.searchsorted(tq, tq)
                keep = nth < need[tq]
                c, q = np.concatenate((c, tc[keep])), np.concatenate((q, tq[keep]))
            yield pd.DataFrame({"query_id": ids[q], "vec_id": cid[c], "score": s[c, q]})
    return run


def _block_top_k(cands: DataFrame, ids: np.ndarray, query: np.ndarray, norm: float, k: int) -> DataFrame:
    spark = cands.sparkSession
    block = spark.sparkContext.broadcast((ids, query))
    # |score| <= |query| * largest |candidate|
    edge = np.ceil(np.sqrt((query.astype(np.float64) ** 2).sum(axis=1)) * norm).astype(np.int64) + 1
    lo, size = -edge, 2 * edge + 1
    need = np.full(len(ids), k, np.int64)
    while True:
        step = np.maximum(1, -(-size // BINS))
        hist = cands.mapInPandas(_histograms(block, lo, size, step, need), "q int, bin int, n long")
        down = Window.partitionBy("q").orderBy(F.desc("bin"))
        needs = spark.createDataFrame(pd.DataFrame({"q": np.arange(len(ids), dtype=np.int32), "need": need}))
        found = (hist.groupBy("q", "bin").agg(F.sum("n").alias("n"))
                 .withColumn("upto", F.sum("n").over(down)).join(needs, "q")
                 .filter(F.col("upto") >= F.col("need")).groupBy("q")
                 .agg(F.max_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("above")), "bin").alias("x"))
                 .select("q", "x.bin", "x.above").collect())       # one row per query of the block
        at, above = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for r in found:                                            # a query with under k candidates keeps all: its lo
            at[r["q"]], above[r["q"]] = r["bin"], r["above"]
        have = np.zeros(len(ids), bool)
        have[[r["q"] for r in found]] = True
        lo = np.where(have, lo + at * step, lo)
        need = need - above
        size = np.where(have, step, 1)
        if (size <= 1).all():
            break
    top = cands.mapInPandas(_winners(block, lo, need), "query_id long, vec_id long, score long")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (top.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = 256, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of each vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    cands = written(integer_vectors(vectors, id_col, vec_col, scale), "vectors")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    queries = cands.filter(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("vec").alias("vec"))
    seen = cands.agg(F.max(F.sqrt(square)).alias("norm")).join(
        queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width"))).first()
    blocks = -(-(seen["n"] or 0) // block_rows)
    out = None
    for b in range(blocks):
        own = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        got = own.orderBy("id").toPandas()
        if len(got):
            part = _block_top_k(cands, got["id"].to_numpy(np.int64), _matrix(got["vec"].to_list(), seen["width"]),
                                seen["norm"] or 0.0, k)
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out
