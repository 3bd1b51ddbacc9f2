"""A corpus pipeline of five of the operators in ``tillpoint.llm``.

Each stage takes what the stage before it kept, (spark, docs, sf_dir), and
returns the columns of ``documents``; the last one returns token ids.

1. language: documents without a letter, which no language is read from, go.
2. near_duplicates: of each component of documents whose sets of 5-word
   shingles are 80 % alike, the one with the smallest id stays, and of several
   texts with that id the one with the smallest digest.
3. decontaminate: passages of 10 or more words that a benchmark item has are
   cut out of the text.
4. secrets: spans of secrets are replaced by a mark.
5. tokens: texts become token ids.

Nulls: null text has no letter and goes in the first stage; null ids, labels
and sources are kept.  Extra columns are handed on by every stage but the
last.  Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillpoint.llm import bpe, decontaminate, jaccard_join, langid, secrets
from tillpoint.llm.common import table, written

NEAR_WORDS, NEAR_PERCENT = 5, 80
LEAST_PHRASE = 1.25     # characters a phrase; letters that no language has are phrases of their own


def others(docs: DataFrame, *names: str) -> list[str]:
    return [c for c in docs.columns if c not in names]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents for which a language is found: their phrases must be longer than strange letters' are."""
    model = langid.fit(docs)
    if not model.labels:        # without any labelled text no language can be found, and none is rejected for it
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    # numbered names, so that no column of the table has the name of a result
    own = docs.toDF(*[f"own_{i}" for i in range(len(docs.columns))])
    at = dict(zip(docs.columns, own.columns))
    seen = langid.predict(own, model, at["doc_id"], at["text"], carry=others(own, at["doc_id"]))
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("phrase_chars") >= LEAST_PHRASE)
    return seen.filter(known).select(*own.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each component; documents without words are in none and stay."""
    # an id may stand for several texts, so a document goes by both; null ids come last
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("of"),
                   F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("digest"))
    found = jaccard_join.jaccard_components(docs.select(own.alias("row"), "text"), NEAR_WORDS, NEAR_PERCENT, 100, "row")
    kept = found.filter(F.col("row") == F.col("component_id")).select("row.*").distinct()
    clash_free = kept.toDF("kept_no_id", "kept_id", "kept_digest")
    mine = own.getField("digest")
    first = docs.join(clash_free, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (mine == F.col("kept_digest")), "left_semi")
    return first.dropDuplicates(["doc_id", "text"])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the passages that the benchmark has."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=others(docs, "doc_id"))
    return _with_text(found, docs, F.coalesce("clean_text", "text"), F.col("clean_text").isNotNull())


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark."""
    found = secrets.findings(docs, secrets.scan_new(docs), paths=docs.columns)
    return _with_text(found, docs, secrets.redacted(F.col("text"), F.col("spans")), F.size("spans") > 0)


def _with_text(found: DataFrame, docs: DataFrame, text, changed) -> DataFrame:
    fresh = {"text": text, "n_chars": F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*[fresh[c].alias(c) if c in fresh else F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, with the source and the language label of each."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = bpe.encode(docs, ranks, public_tokenizers.PATTERN, carry=["lang", "source"])
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated),
          ("secrets", without_secrets), ("tokens", tokens)]

# Language identification and byte-pair merges are no SQL.  The operators of the stages have tests; run() as a whole has none yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
