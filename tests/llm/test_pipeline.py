"""Stages of the pipeline against plain versions on small tables."""

import corpus_pipeline
from tests.conftest import SF_SMALL


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_near_duplicates(rows):
    """Rows (id, text): one of each component stays, those without words all do; repeated rows once."""
    rows = list(dict.fromkeys(rows))
    sets = [shingle_set(t) for _, t in rows]
    comp = list(range(len(rows)))

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                comp[top(i)] = top(j)
    groups = {}
    for i, (d, t) in enumerate(rows):
        groups.setdefault(top(i), []).append((d, t))
    return groups.values()


def test_near_duplicates_keep_rows_and_not_ids(spark):
    words = [f"w{i}" for i in range(60)]
    a, near = " ".join(words), " ".join(words[:58] + ["x", "y"])
    b, c = " ".join(f"b{i}" for i in range(30)), "two words"
    rows = [(3, a), (5, a), (5, b), (9, near), (5, b), (None, b), (None, "only here without any id at all"), (7, c), (8, c),
            (11, None), (12, ""), (11, ""), (13, " \n"), (4, near), (None, "only here without any id at all")]
    real = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").selectExpr("doc_id + 1000", "text").collect()]
    docs = spark.createDataFrame(rows + real, "doc_id long, text string").selectExpr(
        "doc_id", "text", "'en' as lang", "'s' as source", "1L as n_chars", "2 as row", "3 as kept_id_", "4 as `of`")
    out = corpus_pipeline.near_duplicates(spark, docs, SF_SMALL)
    assert out.columns == docs.columns
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect())
    want = []
    for group in plain_near_duplicates(rows + real):
        least = min((d is None, d or 0) for d, _ in group)
        want.append([g for g in group if (g[0] is None, g[0] or 0) == least])
    # of several texts with the smallest id any one may stay; here there is one
    assert all(len(w) == 1 for w in want)
    assert got == sorted((str(w[0][0]), str(w[0][1])) for w in want)
    assert corpus_pipeline.near_duplicates(spark, docs.filter("false"), SF_SMALL).count() == 0


def test_language_rejects_strange_letters_and_keeps_the_rest(spark):
    real = spark.read.parquet(f"{SF_SMALL}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "lang")
    thai, greek = "".join(chr(0xE01 + i * 7 % 40) for i in range(80)), "\u03b1\u03b2 \u03b3\u03b4\u03b5 \u03b6\u03b7\u03b8 \u03b9\u03ba"
    odd = [(1, thai, None), (2, greek, None), (3, None, "en"), (4, "", "en"), (5, "12 34 !!", "en"), (6, "A.", "en"),
           (7, "All rights reserved.", None), (8, "xq", None), (8, "xq", None), (None, "the end of it", None)]
    docs = real.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string")).selectExpr(
        "doc_id", "text", "lang", "1.5 as cost", "'x' as lang_pred", "2 as phrase_chars", "3 as own_0")
    out = corpus_pipeline.language(spark, docs, SF_SMALL)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"], r["lang"], r["lang_pred"]) for r in out.collect()]
    want = [(r["doc_id"], r["text"], r["lang"], "x") for r in real.collect() if any(c.isalpha() for c in r["text"] or "")]
    want += [(i, t, l, "x") for i, t, l in odd if i not in (1, 2, 3, 4, 5)]
    assert sorted(got, key=str) == sorted(want, key=str)
    blank = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert corpus_pipeline.language(spark, blank, SF_SMALL).count() == len(want) + 2
    assert corpus_pipeline.language(spark, docs.filter("false"), SF_SMALL).count() == 0


def test_language_learns_from_whole_bounded_texts(spark):
    from tillpoint.llm import langid
    rows = [(f"{i} " + "en glish words " * 300, "en") for i in range(99)] + [("z" * 9000, "de"), ("y" * 8000, "de")]
    model = langid.fit(spark.createDataFrame(rows * 2, "text string, lang string"), chars=10_000)
    # whole texts of 4,5xx characters, two of them fit; of texts that are too long only the shortest is learnt
    assert model.labels == ["de", "en"] and "y" in model.symbol and "z" not in model.symbol
    # the automata stand for "y" * 8000 and a gap, and for two texts
    assert round(2 ** model.bits[0]) == 8001 and 8000 < 2 ** model.bits[1] <= 10_000
