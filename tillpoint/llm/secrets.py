"""Secret scans over an incremental ledger of blobs, in DataFrame functions only.

Every version of every file is addressed by the digest of its content (its
blob).  The ledger holds one row per blob and rule version that was scanned,
with the spans found.  A run

1. reduces the versions to distinct blobs (a partial aggregate of digests),
2. leaves out the (blob, rule version) pairs that the ledger has,
3. scans one copy of each blob that is left,
4. joins the findings back to all paths that hold the blob.

A blob that stands a million times is scanned once, and a new rule version
scans old blobs with that rule alone.

Overlapping spans of different kinds all stay.  Only matches that their rule
accepts are kept; rejected ones are dropped, and the search goes on behind
them.

Defined results: null content is the empty blob; repeated versions each get
their findings; empty tables give no rows; other columns of the versions are
handed on only if named in ``paths``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tillpoint.llm.spans import bound, fold, match_spans, slices

SPAN = "array<struct<start: int, kind: string, end: int>>"


@dataclass(frozen=True)
class Rule:
    """A pattern (Java syntax); ``accept``, which a match must satisfy as a whole; ``hint``, which a text must hold."""

    kind: str
    pattern: str
    accept: str | None = None
    hint: str | None = None
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}/{self.version}"


# The base patterns.  The group of an assignment that holds the secret has 6 characters or more.
ASSIGN_NAME = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE_RULES = [
    Rule("assign", ASSIGN_NAME + "[A-Za-z0-9+/_.=-]+", ASSIGN_NAME + "[A-Za-z0-9+/_.=-]{6,}",
         r"(?i:passw|secret|token|api_?key)"),
    Rule("access", "AKIA[A-Z0-9]{16,}", None, "AKIA[A-Z0-9]{16}"),
    Rule("hex", "[0-9a-f]{24,}", None, "[0-9a-f]{24}"),
]
MORE_RULES = [
    Rule("pem", "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", None, "PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", None, "eyJ"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", None, "gh[pousr]_"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", None, "xox[abprs]-"),
    Rule("login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@", None, "://"),
]


def blob_of(content: Column) -> Column:
    return F.sha2(F.coalesce(content.cast("string"), F.lit("")).cast("binary"), 256)


def rule_spans(text: Column, rule: Rule) -> Column:
    spans = match_spans(text, rule.pattern, rule.kind, text.rlike(rule.hint) if rule.hint else None)
    if rule.accept:
        spans = F.filter(spans, lambda s: s["found"].rlike("^(?:" + rule.accept + ")$"))
    return F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], f"blob string, rule string, spans {SPAN}")


def scan_new(versions: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] | None = None,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ledger rows (blob, rule, spans) of the pairs of blobs and rules that ``ledger`` lacks."""
    rules = BASE_RULES + MORE_RULES if rules is None else rules
    rows = versions.select(F.col(f"`{id_col}`").alias("id"),
                           F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
                           blob_of(F.col(f"`{text_col}`")).alias("blob"))
    # one copy of each blob: the row with the smallest id; rows that repeat it meet again in the last aggregate
    blobs = rows.groupBy("blob").agg(F.min("id").alias("id"))
    todo = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        blobs = blobs.withColumn("todo", todo)
    else:
        done = ledger.filter(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(
            F.collect_set("rule").alias("done"))                            # at most one entry per rule
        blobs = (blobs.join(done, "blob", "left")
                 .withColumn("todo", F.array_except(todo, F.coalesce("done", F.expr("cast(array() as array<string>)"))))
                 .filter(F.size("todo") > 0).drop("done"))
    copies = rows.join(blobs.withColumnRenamed("id", "rep").withColumnRenamed("blob", "b"),
                       (F.col("blob") == F.col("b")) & F.col("id").eqNullSafe(F.col("rep")))
    by_rule = [F.when(F.array_contains("todo", r.key),
                      F.struct(F.lit(r.key).alias("rule"), rule_spans(F.col("text"), r).alias("spans"))) for r in rules]
    scanned = copies.select("blob", F.array_compact(F.array(*by_rule)).alias("got"))
    return (scanned.groupBy("blob").agg(F.first("got").alias("got"))
            .select("blob", F.explode("got").alias("x")).select("blob", "x.rule", "x.spans"))


def findings(versions: DataFrame, ledger: DataFrame, rules: list[Rule] | None = None, text_col: str = "text",
             paths: list[str] = ("doc_id",)) -> DataFrame:
    """Every version (its ``paths`` columns) with the spans that the ledger has for its blob under these rules."""
    rules = BASE_RULES + MORE_RULES if rules is None else rules
    hits = (ledger.filter(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
            .groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans")))   # one row per rule and blob
    own = versions.select(blob_of(F.col(f"`{text_col}`")).alias("blob"),
                          *[F.col(f"`{c}`").alias(f"p_{i}") for i, c in enumerate(paths)])
    return own.join(hits, "blob", "left").select(
        *[F.col(f"p_{i}").alias(c) for i, c in enumerate(paths)], "blob",
        F.coalesce("spans", F.expr(f"cast(array() as {SPAN})")).alias("spans"))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced by a mark; overlapping spans share one."""
    # where the kept text in front of each mark lies; a span that begins inside the one before it only moves the end
    place = "array<struct<a: int, b: int>>"

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        cut = F.array(F.struct(at.alias("a"), x["start"].alias("b")))
        return F.greatest(at, x["end"]), F.when(x["start"] >= at, cut).otherwise(F.expr(f"cast(array() as {place})"))

    spans_ = F.array_sort(spans)
    ends = F.array_max(F.transform(spans, lambda s: s["end"]))

    # the pieces of a slice are cut from the text between its first and its last one, not from the whole text
    def pieces(some: Column) -> Column:
        first = F.element_at(some, 1)["a"]
        block = F.substring(text, first + 1, F.element_at(some, -1)["b"] - first)
        return bound(F.struct(first.alias("first"), block.alias("block")), lambda k: F.array_join(F.transform(
            some, lambda p: F.concat(F.substring(k["block"], p["a"] - k["first"] + 1, p["b"] - p["a"]), F.lit(mark))), ""))

    head = F.array_join(F.transform(slices(fold(spans_, F.expr(f"cast(array() as {place})"), step), 512), pieces), "")
    return F.when(F.size(spans) > 0, F.concat(head, F.substring(text, ends + 1, F.length(text)))).otherwise(text)
