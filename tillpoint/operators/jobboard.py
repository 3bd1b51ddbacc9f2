"""Open jobs of every job user as bitmaps (D22 for all users at once).

The jobs that a user may apply to are nearly the same list for everyone: the
open jobs without the few that the user applied to.  So there is one shared
bitmap of open jobs, in chunks of ``CHUNK`` job numbers, and a chunk of a
user's own only where an application falls into it: rows follow the number of
applications, not users x jobs.  Words of 64 jobs are built by partially
aggregated ``bit_or``; NOT IN is AND NOT on the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CHUNK, WORD = 1024, 64
WORDS = CHUNK // WORD


def _place(df: DataFrame) -> DataFrame:
    """Chunk, word and bit of each job number."""
    return (df.withColumn("chunk", F.floor(F.col("job_id") / CHUNK).cast("long"))
            .withColumn("word", F.floor(F.pmod("job_id", F.lit(CHUNK)) / WORD).cast("int"))
            .withColumn("bit", F.expr(f"shiftleft(1L, cast(pmod(job_id, {WORD}) as int))")))


def _words(df: DataFrame, *by: str) -> DataFrame:
    """(by, words array<long>): the bitmap of a chunk; a chunk gathers at most ``WORDS`` rows."""
    ored = df.groupBy(*by, "word").agg(F.bit_or("bit").alias("bits"))
    return ored.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m")).select(
        *by, F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)),
                         lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long"))).alias("words"))


def open_job_bits(job_list: DataFrame, job_apply: DataFrame) -> DataFrame:
    """(job_user_id, chunk, words): the open jobs that a user may apply to, by chunk.

    Rows of no user (NULL) are the shared bitmap, which holds for all users in chunks without a row of their own.
    A user with an application to no job (NULL) has one row without chunk and words: NOT IN is unknown for every
    job, so there is none.  An application without a user counts for nobody.
    """
    jobs = _place(job_list.filter((F.col("status") == "open") & F.col("job_id").isNotNull()).select("job_id"))
    shared = _words(jobs, "chunk")
    mine = job_apply.filter(F.col("job_user_id").isNotNull()).select("job_user_id", "job_id")
    blocked = mine.filter(F.col("job_id").isNull()).select("job_user_id").distinct()
    applied = _words(_place(mine.filter(F.col("job_id").isNotNull())
                            .join(jobs.select("job_id"), "job_id", "left_semi")), "job_user_id", "chunk")
    own = (applied.withColumnRenamed("words", "gone").join(shared, "chunk")
           .join(blocked, "job_user_id", "left_anti")
           .select("job_user_id", "chunk", F.zip_with("words", "gone", lambda a, b: a.bitwiseAND(F.bitwise_not(b))).alias("words")))
    kind = dict(job_apply.dtypes)["job_user_id"]
    return (shared.select(F.lit(None).cast(kind).alias("job_user_id"), "chunk", "words").unionByName(own)
            .unionByName(blocked.select("job_user_id", F.lit(None).cast("long").alias("chunk"),
                                        F.expr("cast(null as array<bigint>)").alias("words"))))


def n_jobs(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))


def hex_words(words: Column) -> Column:
    """Words as text, the first one first, 16 digits each."""
    return F.array_join(F.transform(words, lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), "")


def open_jobs_of(users: DataFrame, bits: DataFrame, job_list: DataFrame) -> DataFrame:
    """(job_user_id and the job's columns) for each of the given users."""
    shared = bits.filter(F.col("job_user_id").isNull())
    ends = shared.agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).first()
    asked = users.select("job_user_id").distinct()
    blocked = bits.filter(F.col("chunk").isNull()).select("job_user_id")
    if ends["lo"] is None:
        every = asked.select("job_user_id", F.lit(0).cast("long").alias("chunk")).filter("false")
    else:
        every = asked.select("job_user_id", F.explode(F.sequence(F.lit(ends["lo"]), F.lit(ends["hi"]))).alias("chunk"))
    mine = bits.filter(F.col("job_user_id").isNotNull() & F.col("chunk").isNotNull()).withColumnRenamed("words", "own")
    found = (every.join(blocked, "job_user_id", "left_anti").join(shared.drop("job_user_id"), "chunk")
             .join(mine, ["job_user_id", "chunk"], "left"))
    words = F.explode(F.transform(F.coalesce("own", "words"), lambda w, i: F.struct(i.alias("i"), w.alias("w")))).alias("x")
    jobs = (found.select("job_user_id", "chunk", words)
            .select("job_user_id", "chunk", "x.i", F.explode(F.filter(
                F.sequence(F.lit(0), F.lit(WORD - 1)), lambda p: F.getbit("x.w", p) == 1)).alias("p"))
            .select("job_user_id", (F.col("chunk") * CHUNK + F.col("i") * WORD + F.col("p")).alias("job_id")))
    return jobs.join(job_list, "job_id")
