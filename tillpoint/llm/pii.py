"""Personal data by candidate gradient boosting, in DataFrame functions and Spark ML only.

Base spans come from strict patterns and checks (``BASE``).  High-recall
generators (``GENERATORS``) propose further spans, which overlap each other
and the base spans.  Boosted trees score proposals by features of their
format and their context.  Only some proposals have a label:

* positive: those that coincide with a base span (at least four fifths of what
  both cover), and codes whose check number is right;
* negative: those that a check rejects (``rejected``: dates, plain numbers,
  numbers of too few or too many digits, parts of an address out of range,
  wrong check numbers, a sign without a domain behind it);
* every other one is a find of the generators alone, and has no label.

No feature tells the trees the outcome of a check.  So that they learn formats
which the strict patterns miss, a written-out sign ("(at)") has the features
of the sign, and a positive number also counts without its leading plus and
with other separators; its forms share the weight of one example.  The
threshold is the lowest one that reaches the wanted precision over all
labelled proposals that the trees were not fitted to, from a histogram of
their scores.  Proposals at or above it that no check rejects and that do not
overlap a base span are added, the higher score first where they overlap each
other.

The trees are fitted to the ``sample`` labelled proposals with the smallest
hashes of their text and context, so that fitting is bounded; all proposals
of all documents are scored.

Defined results: null text is empty; a text without proposals has only its
base spans; without examples of both classes nothing is added; repeated rows
get the same spans; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tillpoint.llm.common import pick, written
from tillpoint.llm.spans import match_spans

SAMPLE = 20_000
PRECISION = 0.9
PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

# The base patterns, leftmost and non-overlapping.  A match can begin only where a run of its
# first characters begins or where the match before ended, which the first group says, so long runs stay cheap.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": "[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]"}
GENERATORS = {
    "mail_like": r"[^\s@<>(),;:\"'|]{1,64} ?(?:@|\(at\)|\[at\]) ?[^\s@<>(),;:\"'|]{3,255}",
    # neither dates nor dotted numbers
    "number_like": r"(?<![0-9.])(?![0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9]++\.[0-9])\+?\(?[0-9](?:[ ().\-/]{0,2}[0-9]){6,30}",
    "dotted_like": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "code_like": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){10,30}\b",
}
GENERATOR_HINTS = {"mail_like": r"@|[\[(]at[\])]", "number_like": "[0-9](?:[ ().\\-/]{0,2}[0-9]){6}",
                   "dotted_like": HINTS["ip"],
                   "code_like": "[A-Z]{2}[0-9]{2} ?[A-Z0-9]"}
KEYWORDS = "(?i:mail|phone|tel|call|fax|card|visa|account|iban|contact|address|ip)[^a-zA-Z]{0,12}$"
SPAN = "array<struct<start: int, kind: string, end: int>>"
WRITTEN_SIGN = r" ?(?:@|\(at\)|\[at\]) ?"
ADDRESS = r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
DATE = r"^\(?(?:[0-9]{1,2}([-/ ])[0-9]{1,2}\1(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}([-/ ])[0-9]{1,2}\2[0-9]{1,2}|(?:19|20)[0-9]{2} ?[-/] ?(?:19|20)[0-9]{2})(?![0-9])"
STEPS = 1000            # of the histogram of scores


def _accepts(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    return {"email": F.lit(True),
            "ip": found.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"),
            "card": F.when((n >= 12) & (n <= 19), F.call_function("luhn_check", digits)).otherwise(False),
            "phone": (n >= 9) & (n <= 15)}[kind]


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of the base kinds."""
    def checked(kind: str) -> Column:
        return F.filter(match_spans(text, BASE[kind], kind, text.rlike(HINTS[kind])), lambda s: _accepts(kind, s["found"]))
    return F.transform(F.concat(*[checked(kind) for kind in BASE]), lambda s: F.struct(s["start"], s["kind"], s["end"]))


def proposals(text: Column) -> Column:
    """Spans of the generators with their text and 24 characters of context on each side."""
    every = F.concat(*[match_spans(text, p, kind, text.rlike(GENERATOR_HINTS[kind])) for kind, p in GENERATORS.items()])
    return F.transform(every, lambda s: F.struct(
        s["start"], s["kind"], s["end"], s["found"],
        F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24))).alias("left"),
        F.substring(text, s["end"] + 1, F.lit(24)).alias("right")))


def features(c: str = "p") -> dict[str, Column]:
    left, right = F.col(f"{c}.left"), F.col(f"{c}.right")
    # a sign that is written out counts as the sign
    found = F.regexp_replace(F.col(f"{c}.found"), WRITTEN_SIGN, "@")

    def count(pattern: str) -> Column:
        return F.length(found) - F.length(F.regexp_replace(found, pattern, ""))

    return {"chars": F.length(found), "digits": count("[0-9]"), "letters": count(r"\p{L}"), "dots": count(r"\."),
            "dashes": count("-"), "blanks": count(" "), "brackets": count(r"[()\[\]]"), "at": count("@"),
            "plus": found.startswith("+").cast("int"), "capitals": count("[A-Z]"),
            "groups": F.size(F.split(found, "[^0-9]+")), "other": count(r"[^0-9\p{L}. ()@+-]"),
            "dots_behind_at": F.length(F.regexp_replace(F.regexp_extract(found, "@(.*)$", 1), r"[^.]", "")),
            "joined_left": left.rlike(r"[\p{L}0-9]$").cast("int"), "joined_right": right.rlike(r"^[\p{L}0-9]").cast("int"),
            "keyword": left.rlike(KEYWORDS).cast("int"), "line_start": left.rlike(r"(?:^|\n)[ \t]*$").cast("int"),
            **{f"by_{g}": (F.col(f"{c}.kind") == g).cast("int") for g in GENERATORS}}


def _code_is_right(found: Column) -> Column:
    """The check number of an account code: its first four characters go last, letters count from 10, modulo 97 is 1."""
    code = F.regexp_replace(found, " ", "")
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n >= 65, F.pmod(rest * 100 + n - 55, F.lit(97))).when(
            n >= 48, F.pmod(rest * 10 + n - 48, F.lit(97))).otherwise(rest)
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def rejected(c: str = "p") -> Column:
    """Proposals that a check rules out; they are real negatives unless they coincide with a base span."""
    kind, found, left = F.col(f"{c}.kind"), F.col(f"{c}.found"), F.col(f"{c}.left")
    digits = F.length(F.regexp_replace(found, "[^0-9]", ""))
    plain = found.rlike("^[0-9]+$") & ~left.rlike(KEYWORDS)
    return (F.when(kind == "mail_like", ~F.regexp_replace(found, WRITTEN_SIGN, "@").rlike(ADDRESS))
            .when(kind == "number_like", ~digits.between(9, 15) & ~_accepts("card", found) | found.rlike(DATE) | plain)
            .when(kind == "dotted_like", ~_accepts("ip", found))
            .otherwise(~_code_is_right(found)))


def label(base: str = "base") -> Column:
    """1 for a positive, 0 for a negative, null for a proposal that only its generator knows."""
    def coincides(b: Column) -> Column:
        both = F.least(b["end"], F.col("p.end")) - F.greatest(b["start"], F.col("p.start"))
        all_ = F.greatest(b["end"], F.col("p.end")) - F.least(b["start"], F.col("p.start"))
        return both * 5 >= all_ * 4
    return (F.when(F.exists(base, coincides), 1.0).when(rejected(), 0.0)
            .when(F.col("p.kind") == "code_like", 1.0))


def forms() -> Column:
    """What a positive number looks like in formats that the strict patterns miss, and as it stands."""
    found = F.col("p.found")
    bare = F.regexp_replace(found, r"^\+", "")
    changed = [F.regexp_replace(bare, r"(?<=[0-9)])[ ().\-/]+(?=[(0-9])", by) for by in (" ", "-", "/")]
    return F.when(F.col("p.kind") == "number_like", F.array_distinct(F.array(found, bare, *changed))).otherwise(F.array(found))


@dataclass
class Fitted:
    model: object
    threshold: float
    precision: float
    examples: int


def fit(candidates: DataFrame, sample: int = SAMPLE, precision: float = PRECISION, seed: int = 7) -> Fitted | None:
    """Trees and threshold from (p, base) rows, or None without examples of both classes."""
    labelled = (candidates.withColumn("label", label()).filter(F.col("label").isNotNull())
                .withColumn("forms", F.when(F.col("label") == 1, forms()).otherwise(F.array("p.found")))
                .select("label", (1 / F.size("forms")).alias("weight"), "p", F.explode("forms").alias("found"))
                .select("label", "weight", F.struct("p.start", "p.kind", "p.end", "found", "p.left", "p.right").alias("p")))
    h = F.xxhash64("p.kind", "p.found", "p.left", "p.right")
    names = list(features())
    # copies are one example
    examples = written(
        labelled.select(h.alias("h"), "label", "weight", *[v.cast("double").alias(k) for k, v in features().items()])
        .groupBy("h").agg(F.max("label").alias("label"), F.max("weight").alias("weight"),
                          *[F.first(n).alias(n) for n in names]), "examples")
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(examples)
    held = F.pmod(F.shiftright("h", 8), F.lit(4)) == 0
    train = written(vectors.select("h", "label", "weight", "features").orderBy("h").limit(sample).coalesce(2), "sample")
    seen = train.agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("last"),
                     F.count_distinct(F.when(~held, F.col("label"))).alias("classes")).first()
    if seen["classes"] < 2:
        return None
    model = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, seed=seed, weightCol="weight").fit(train.filter(~held))
    step = F.floor(vector_to_array("probability")[1] * STEPS)
    steps = (model.transform(vectors.filter(held | (F.col("h") > seen["last"])))
             .groupBy(step.alias("step")).agg(F.sum(F.col("label") * F.col("weight")).alias("yes"),
                                              F.sum("weight").alias("all")).collect())       # at most STEPS + 1 rows
    best, yes, every = None, 0.0, 0.0
    for r in sorted(steps, key=lambda r: -r["step"]):
        yes, every = yes + r["yes"], every + r["all"]
        if yes >= precision * every:
            best = Fitted(model, r["step"] / STEPS, yes / every, seen["n"])
    return best


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE,
         precision: float = PRECISION) -> DataFrame:
    """(id, base, more): base spans, and those that the trees add (kinds are the generators'), with scores."""
    own = pick(docs, id=id_col, text=text_col).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = written(own.select("id", base_spans(F.col("text")).alias("base"), proposals(F.col("text")).alias("props"))
                    .withColumn("row", F.monotonically_increasing_id()), "spans")
    candidates = found.select("row", "base", F.explode("props").alias("p"))
    fitted = fit(candidates, sample, precision)
    none = F.expr("cast(array() as array<struct<start: int, kind: string, end: int, score: double>>)")
    if fitted is None:
        return found.select(F.col("id").alias(id_col), "base", none.alias("more"))
    fresh = candidates.filter(~F.exists("base", lambda b: _overlaps(b, F.col("p"))) & ~rejected())
    names = list(features())
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(
        fresh.select("row", "p", *[v.cast("double").alias(k) for k, v in features().items()])).select("row", "p", "features")
    scored = fitted.model.transform(ready).select(
        "row", F.struct((-vector_to_array("probability")[1]).alias("minus"), F.col("p.start").alias("start"),
                        F.col("p.kind").alias("kind"), F.col("p.end").alias("end")).alias("s"))
    chosen = scored.filter(-F.col("s.minus") >= fitted.threshold)
    # the spans of one document: best first, each that overlaps none before it
    greedy = F.aggregate(F.array_sort(F.collect_list("s")), none, lambda out, s: F.when(
        F.exists(out, lambda o: _overlaps(o, s)), out).otherwise(F.concat(out, F.array(F.struct(
            s["start"], s["kind"], s["end"], (-s["minus"]).alias("score"))))))
    more = chosen.groupBy("row").agg(greedy.alias("more"))
    return found.join(more, "row", "left").select(F.col("id").alias(id_col), "base", F.coalesce("more", none).alias("more"))
