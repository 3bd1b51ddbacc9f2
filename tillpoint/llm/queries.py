"""The registered queries of the operators, with production parameters, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillpoint.llm import (bpe, collocations, decontaminate, hard_negatives, html_text, jaccard_join, kneser_ney, langid,
                           license_scan, pii, secrets, sharding, topk)
from tillpoint.llm.common import table
from tillpoint.llm.spans import spans_text

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
SECRET_KINDS = [r.kind for r in secrets.BASE_RULES + secrets.MORE_RULES]
PII_KINDS = [*pii.BASE, *pii.GENERATORS]


def fold(modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the windows of 10 words of all benchmark items."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end_word"] - s["start_word"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        sha256(F.array_join("items", ",")).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold(4) != 2)
    return langid.predict(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other vectors of each vector whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of all documents."""
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda b: b["word"])
    base = F.transform("base", lambda b: b["label"])
    every = F.concat(base, F.transform("notices", lambda n: n["label"]))
    best = F.coalesce(F.array_max(F.transform("notices", lambda n: n["similarity"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
                        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
                        F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("labels"),
                        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(best).alias("score"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and the bytes that they decode to."""
    ranks = bpe.read_ranks(VOCABULARY)
    done = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    ids = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256(ids).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets are 85 % alike."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, scanned once per distinct text."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.findings(docs, secrets.scan_new(docs))
    return found.select("doc_id", *kind_counts("spans", ["assign", "access", "hex"]),
                        sha256(spans_text(F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex")),
                                          SECRET_KINDS)).alias("base_sha256"),
                        spans_text(F.col("spans"), SECRET_KINDS).alias("spans"))


def kind_counts(spans: str, kinds: list[str]) -> list[Column]:
    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return [count(k).alias(f"n_{k}") for k in kinds]


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards, and where each would be with 17."""
    return sharding.assign_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram scores of all documents, learned from six sevenths of them."""
    docs = table(spark, sf_dir, "documents")
    model = kneser_ney.train(docs.filter(fold(7) != 2))
    return kneser_ney.score(docs, model).select(
        "doc_id", (fold(7) == 2).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    found = pii.find(table(spark, sf_dir, "documents"))
    every = F.concat("base", F.transform("more", lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return found.select("doc_id", *kind_counts("base", ["email", "ip", "card", "phone"]),
                        sha256(spans_text(F.col("base"), PII_KINDS)).alias("base_sha256"),
                        spans_text(every, PII_KINDS).alias("spans"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of each positive of the vectors whose id is divisible by 100."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label=moved)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of 2 to 5 words of each language, from all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    pages = table(spark, sf_dir, "pages")
    found = html_text.extract(pages, html_text.fit(pages))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op_queries() -> dict:
    own = [op1_decontaminate, op2_language, op3_top_k, op4_licenses, op5_bpe, op6_jaccard, op7_secrets, op8_shards,
           op9_lm_score, op10_pii, op11_hard_negatives, op12_collocations, op13_html_text]
    return {f.__name__: f for f in own}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTER_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACE_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+')"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, {LETTER_WORDS} AS ws FROM documents),
phrase AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(ws), 10) AS n,
         array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS g
  FROM (SELECT item_id, {LETTER_WORDS} AS ws FROM benchmark), unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS r(i)
  WHERE len(ws) > 0),
place AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM phrase), unnest(range(1, greatest(len(ws) - n + 2, 1))) AS r(i)),
hit AS (SELECT DISTINCT doc_id, i, n, item FROM place JOIN phrase USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT DISTINCT doc_id, i, n FROM hit), unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
held AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items
         FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN held USING (doc_id)
"""

OP3_SQL = """
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q
           FROM embeddings
           WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP6_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {SPACE_WORDS} AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 3], ' ')) AS g
      FROM d, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS r(i) WHERE len(ws) > 0),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both
                    FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id) p
  JOIN size m ON m.doc_id = a JOIN size k ON k.doc_id = b WHERE 100 * n_both >= 85 * (m.n + k.n - n_both)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.x, link.b FROM reach JOIN link ON reach.y = link.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, low AS component_id
FROM d LEFT JOIN size USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x) USING (doc_id)
"""


def _spans_sql(rules: list) -> str:
    """Spans of the secret rules: pieces and matches alternate, their lengths add up to the places."""
    parts = []
    for i, r in enumerate(rules):
        pattern = r.pattern.replace("'", "''")
        keep = f"regexp_full_match(m[k], '{r.accept.replace(chr(39), chr(39) * 2)}')" if r.accept else "true"
        parts.append(rf"""
  SELECT rid, {i} AS nth, '{r.kind}' AS kind, a AS start_at, a + length(m[k]) AS end_at FROM (
    SELECT rid, m, k, coalesce(list_sum([length(x) for x in p[1:k]]), 0)
                    + coalesce(list_sum([length(x) for x in m[1:k - 1]]), 0) AS a
    FROM (SELECT rid, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p FROM d),
         unnest(range(1, len(m) + 1)) AS r(k)) WHERE {keep}""")
    return " UNION ALL ".join(parts)


OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({_spans_sql(secrets.BASE_RULES + secrets.MORE_RULES)}),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || CAST(start_at AS BIGINT) || ':' || CAST(end_at AS BIGINT), ',' ORDER BY start_at, nth)
               FILTER (kind IN ('assign', 'access', 'hex')) AS base,
             string_agg(kind || ':' || CAST(start_at AS BIGINT) || ':' || CAST(end_at AS BIGINT), ',' ORDER BY start_at, nth)
               AS spans FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


def _shards_sql() -> str:
    """Jump hashing unrolled over 128-bit integers; crc32 byte by byte with a table made by the polynomial."""
    steps = ["SELECT rid, CAST(0 AS BIGINT) AS j, CAST(0 AS BIGINT) AS s16, CAST(0 AS BIGINT) AS s17, "
             "CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS UBIGINT) AS HUGEINT) AS k FROM d"]
    for _ in range(17):
        steps.append(f"""SELECT rid, CASE WHEN j < 17 THEN CAST(floor((j + 1) * (2147483648.0::DOUBLE
            / CAST((nk >> 33) + 1 AS DOUBLE))) AS BIGINT) ELSE j END AS j, CASE WHEN j < 16 THEN j ELSE s16 END AS s16,
            CASE WHEN j < 17 THEN j ELSE s17 END AS s17, nk AS k FROM (SELECT *,
            (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS nk FROM ({steps[-1]}))""")
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
j AS (SELECT rid, CASE WHEN j < 16 THEN j ELSE s16 END AS shard, CASE WHEN j < 17 THEN j ELSE s17 END AS grown
      FROM ({steps[-1]})),
poly AS (SELECT list(v ORDER BY b) AS crc FROM (SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
      FROM (SELECT unnest(range(0, 256)) AS b))),
c AS (SELECT rid, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes),
      lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1]))) AS crc32
      FROM (SELECT rid, [CAST('0x' || x AS BIGINT) for x in regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] AS bytes
            FROM d), poly)
SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, CAST(crc32 AS BIGINT) AS text_crc32, 'key' AS law,
       CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot,
       CAST(grown AS INTEGER) AS grown_shard
FROM d JOIN j USING (rid) JOIN c USING (rid)
"""


OP8_SQL = _shards_sql()

OP11_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, CAST(vec_id AS BIGINT) AS id,
                  CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (SELECT a.rid AS anchor, a.id AS anchor_id, b.rid, b.id, a.label = b.label AS alike,
             CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.rid <> b.rid AND a.id % 100 = 0),
p AS (SELECT anchor, anchor_id, rid, id AS positive_id, score AS positive_score FROM s WHERE alike
      QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id, rid) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY s.score DESC, s.id, s.rid) AS rank
      FROM p JOIN s ON p.anchor = s.anchor AND NOT s.alike AND 80 * p.positive_score <= 100 * s.score
                   AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 5
"""

OP12_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS MATERIALIZED (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
      FROM w, unnest(range(1, 6)) AS sizes(k), unnest(range(1, greatest(len(ws) - k + 2, 1))) AS places(i) GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 100),
inside AS (SELECT lang, array_to_string(ws[i:j], ' ') AS phrase, max(a) AS longer
           FROM cand, unnest(range(1, k + 1)) AS first(i), unnest(range(i, k + 1)) AS last(j)
           WHERE j - i + 1 < k GROUP BY ALL),
kept AS (SELECT cand.* FROM cand LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
cut AS (SELECT kept.lang, kept.phrase, a, x.f AS l, y.f AS r, n, c,
               (1000 * CAST(a AS HUGEINT) * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
        FROM kept JOIN total USING (lang), unnest(range(1, kept.k)) AS cuts(c)
        JOIN g x ON x.lang = kept.lang AND x.k = c AND x.phrase = array_to_string(ws[1:c], ' ')
        JOIN g y ON y.lang = kept.lang AND y.k = kept.k - c AND y.phrase = array_to_string(ws[c + 1:kept.k], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM low)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 2000
"""

ORACLE = {"op1_decontaminate": OP1_SQL, "op3_top_k": OP3_SQL, "op6_jaccard": OP6_SQL, "op7_secrets": OP7_SQL,
          "op8_shards": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op12_collocations": OP12_SQL}
