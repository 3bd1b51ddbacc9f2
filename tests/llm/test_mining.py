"""Hard negatives, collocations and main texts against plain versions."""

import html
import re
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest

from tillpoint.llm import collocations, hard_negatives, html_text
from tests.conftest import SF_SMALL

# --- hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, row string, score int, slot int, anchor int"


def vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 8], int(rng.integers(0, 3))) for i in range(90)]
    rows += [(100, rows[3][1], 0), (100, rows[3][1], 0), (200, [0.5] * 6, 1), (300, [1.0] * 3, 2), (-100, [0.1] * 8, 0)]
    rows += [(200 + i, [0.5] * 6, i % 2) for i in range(1, 40)]             # ties, and many copies of one vector
    rows += [(400, None, 1), (None, [1.0] * 6, 1), (500, [0.5, None], 1), (600, [float("nan")] * 6, 1), (700, [0.5] * 6, None),
             (800, [float("inf")] * 6, 1), (900, [], 0)]
    return [r + ("x", 1, 2, 3) for r in rows]


def plain_hard_negatives(rows, positives, keep, low, high, every):
    held = []
    for vec_id, vec, label, *_ in rows:
        if vec_id is None or vec is None or label is None or any(x is None or not np.isfinite(x) for x in vec):
            continue
        held.append((vec_id, [int(np.floor(256 * x)) for x in vec], label))
    out = Counter()
    for a, (anchor, x, own) in enumerate(held):
        if anchor % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, b, label) for b, (i, y, label) in enumerate(held) if b != a)
        for s, positive, _, _ in [t for t in scored if t[3] == own][:positives]:
            fit = [t for t in scored if t[3] != own and low * -s <= 100 * -t[0] <= high * -s][:keep]
            out.update((anchor, positive, n, t[1], -s, -t[0]) for n, t in enumerate(fit, 1))
    return out


@pytest.mark.parametrize("args", [(5, 5, 80, 100, 100), (3, 2, 50, 120, 100), (4, 7, 10, 90, 25)])
@pytest.mark.parametrize("group_bytes", [1 << 20, 300])
def test_hard_negatives(spark, args, group_bytes):
    rows = vectors(spark)
    positives, keep, low, high, every = args
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, VECTORS).repartition(5), positives, keep, low, high, every,
                                        group_bytes=group_bytes)
    assert Counter(tuple(r) for r in got.collect()) == plain_hard_negatives(rows, *args)


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame(vectors(spark), VECTORS)
    assert hard_negatives.hard_negatives(df.filter("false")).collect() == []
    assert hard_negatives.hard_negatives(df.filter("vec_id = 100")).collect() == []


# --- collocations

def plain_collocations(rows, least, longest, keep, share):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", folded):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {g: c for g, c in counts.items() if len(g) > 1 and c >= least}
        inside = Counter()
        for g, c in cand.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    inside[g[i:i + k]] = max(inside[g[i:i + k]], c)
        scored = []
        for g, a in cand.items():
            if g in inside and 100 * inside[g] >= share * a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            scored.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s)
                for i, (s, a, p, left, right) in enumerate(sorted(scored)[:keep], 1)]
    return sorted(out)


TEXTS = [("Aa bb Aa bb cc. aa bb\tcc dd ee ff", "x"), (None, "x"), ("", None), (" .,;", "x"), ("aa bb Cc!aa bb cc dd ee ff gg", None),
         ("one\x00two a\x01 b\x00 a\x01 b\x00 c a\x01\x01 b a\x01 b\x00", "x"), ("É É é Ünï 漢字 😀 漢字 😀 漢字", "x"),
         ("ab " * 4000, "y"), ("p q\x0br s\x0cp q\rr s\np q", "y"), ("no pause " * 50, "z"), ("x\x1fy x\x1fy\xa0z x\x1fy", "z")]


@pytest.mark.parametrize("args", [(2, 5, 50, 100), (3, 4, 2000, 100), (2, 3, 2000, 60), (2, 2, 2000, 100)])
@pytest.mark.parametrize("part_bytes", [collocations.PART_BYTES, 40])
def test_collocations(spark, monkeypatch, args, part_bytes):
    monkeypatch.setattr(collocations, "PART_BYTES", part_bytes)
    rows = TEXTS + TEXTS[:3]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "text string, lang string, n int, phrase string").repartition(3)
    least, longest, keep, share = args
    got = sorted(tuple(r) for r in collocations.collocations(df, least, longest, keep, share).collect())
    assert got == plain_collocations(rows, *args)


def test_collocations_of_documents(spark, monkeypatch):
    monkeypatch.setattr(collocations, "RANGE_BYTES", 1 << 14)       # phrases go over the ends of many ranges
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = sorted(tuple(r) for r in collocations.collocations(df, 12, 5, 300).collect())
    assert got and got == plain_collocations([(r["text"], r["lang"]) for r in df.collect()], 12, 5, 300, 100)
    assert collocations.collocations(df.filter("false")).collect() == []


def grams_of(spark, texts, least=2):
    rows = spark.createDataFrame([(t, "x") for t in texts], "text string, lang string").coalesce(1)
    share, slots = spark.sparkContext.broadcast, collocations.FEWEST_SLOTS
    bits = share(collocations.frequent_slots(rows, least, slots, 1, 5))
    long_bits = share(collocations.frequent_slots(rows, least, slots, 1, 5, bits))
    return [tuple(r) for r in collocations.longest_grams(rows, bits, long_bits, slots, 5).collect()]


def test_a_task_sends_each_gram_once(spark, monkeypatch):
    """However many parts its texts are cut into; with little room a gram is sent more than once, its counts are the same."""
    texts = ["aa bb cc dd. ee ff\nee gg " * 3] * 20
    monkeypatch.setattr(collocations, "PART_BYTES", 60)
    once = grams_of(spark, texts)
    assert len({r[:2] for r in once}) == len(once)
    sums = {r[:2]: r[2] for r in once}
    assert sums["x", b""] == 8 * 3 * 20 and sums["x", b"aa\0bb\0cc\0dd\0"] == 60
    monkeypatch.setattr(collocations, "HELD_BYTES", 300)
    again = grams_of(spark, texts)
    assert len(again) > len(once)
    got = Counter()
    for lang, gram, n in again:
        got[lang, gram] += n
    assert got == sums


def test_gram_rows_do_not_grow_with_the_splits_of_the_table(spark, monkeypatch):
    """A gram is sent once a core at most, in however many splits the texts are read."""
    sent = []

    def counted(df, what, *args, **options):
        out = written(df, what, *args, **options)
        if what == "grams":
            sent.append((out.count(), out.select("lang", "gram").distinct().count()))
        return out
    written = collocations.written
    monkeypatch.setattr(collocations, "written", counted)
    cores = spark.sparkContext.defaultParallelism
    texts = [("aa bb cc dd. ee ff\nee gg " * 3, "x")] * 8 * cores
    found = [sorted(map(tuple, collocations.collocations(
        spark.createDataFrame(texts, "text string, lang string").repartition(splits), 10).collect()))
        for splits in (cores, 5 * cores)]
    assert found[0] == found[1] and found[0]
    assert all(grams > 1 and rows <= cores * grams for rows, grams in sent) and len(sent) == 2
    # tables beyond TASK_BYTES a core have more tasks
    monkeypatch.setattr(collocations, "TASK_BYTES", 100)
    again = collocations.collocations(spark.createDataFrame(texts, "text string, lang string").repartition(5 * cores), 10)
    assert sorted(map(tuple, again.collect())) == found[0]
    assert sent[2][0] > cores * sent[2][1]


def test_grams_that_do_not_fit_in_memory_are_sent_once(spark, monkeypatch):
    """With no room for more than a few grams in memory they wait in files, and rows and counts are the same."""
    texts = [f"aa bb. w{i} v{i}. " * 3 for i in range(60)]
    once = sorted(grams_of(spark, texts))
    assert len({r[:2] for r in once}) == len(once) and ("x", b"aa\0bb\0", 180) in once
    monkeypatch.setattr(collocations, "ROOM_BYTES", 2000, raising=False)
    monkeypatch.setattr(collocations, "PART_BYTES", 60)
    assert sorted(grams_of(spark, texts)) == once


def test_grams_in_files(tmp_path):
    grams, sums = collocations.Grams(1000, str(tmp_path)), Counter()
    rng = np.random.default_rng(3)
    for _ in range(50):
        words = [b"%d\0" % w for w in set(rng.integers(0, 300, 20).tolist())]
        lang = "abé"[int(rng.integers(0, 3))]
        grams.add(lang, words, [2] * len(words))
        for w in words:
            sums[lang, w] += 2
    assert len(grams.files) > 10 and grams.size <= 1000 < grams.waiting
    sent = [row for part in grams.sent() for row in zip(part["lang"], part["gram"], part["n"])]
    assert len(sent) == len(sums) and {r[:2]: r[2] for r in sent} == sums
    assert not list(tmp_path.iterdir()) and not list(grams.sent())


# --- main texts

LONG = " ".join(["some words of a paragraph that goes on"] * 4)
PAGES = [
    (f"<body><div id='header'>Site name</div><div class='menu'><a href=a>Home</a> <a href=b>News</a></div><div class=content>"
     f"<h1>Title</h1><p>{LONG}</p><p>Short.<p>See <a href=x>the link</a> in {LONG}</p><div class='ad-box'>Buy {LONG}</div>"
     f"<p>{LONG} end</p><ul><li>one<li>two</ul></div><div id=comments><p>{LONG}</p></div><div class=footer>Imprint</div>",
     ["Title", LONG, "Short.", f"See the link in {LONG}", f"{LONG} end", "one", "two"]),
    (f"<body class='no-sidebar'><header><h1>Site</h1></header><main><article><header><h1>A &amp;amp; B</h1></header><p>{LONG}"
     f"<aside>{LONG}</aside><p>x&nbsp;\n y<br>z &lt;b&gt;<form>Mail <input></form><section class=comments><article class=comment>"
     f"<p>{LONG}</article></section><footer>me</footer></article></main><div class='cookie-notice'>{LONG}{LONG}</div>",
     ["A &amp; B", LONG, "x y z <b>"]),
    (f"<form action=x><div id=nav><a>1</a></div><article><h1>T</h1><p>{LONG}</p></article></form>", ["T", LONG]),
    (f"<p>{LONG}<script>'<p>no</p>'</script><style>p{{}}</style><!-- <p>no</p> --><p>{LONG}<!-- open <p>{LONG}", [LONG, LONG]),
    (f"<p title='a > b' hidden=until-found>{LONG}</p><p hidden>{LONG}</p><p style='display: none'>{LONG}", [LONG]),
    ("only   text\n no tags", ["only text no tags"]), ("a < b &am; c &copy d &amp;lt;", ["a < b &am; c © d &lt;"]),
    (None, []), ("", []), ("<p></p><div> </div>", []), ("<", ["<"]), ("<p", []), ("&", ["&"]),
]


@pytest.fixture(scope="module")
def weights(spark):
    return html_text.fit(spark.read.parquet(f"{SF_SMALL}/../sf0.01/pages.parquet"), sample=150)


def test_main_texts_of_made_pages(spark, weights):
    rows = [(i, "u", h, "t", 1) for i, (h, _) in enumerate(PAGES)] + [(None, None, PAGES[0][0], "t", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, c_0 int")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df, weights).collect()}
    assert len(got) == len(rows) and got.pop(None) == got[0]
    for i, (_, want) in enumerate(PAGES):
        assert got[i] == "\n\n".join(want), PAGES[i]
    assert html_text.extract(df.filter("false"), weights).collect() == []
    assert html_text.fit(df.filter("false")) == {}


def test_main_texts_of_pages(spark, weights):
    """The weights of 150 pages find the article of all pages, by a plain reading of its marks."""
    df = spark.read.parquet(f"{SF_SMALL}/../sf0.01/pages.parquet")
    for r in html_text.extract(df, weights, ["page_id", "html"]).collect():
        article = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " " if "<br>" in b else "", b)).split())
                  for b in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


def test_articles_without_marks(spark, weights):
    """Without its article element a page gives the same text: the weights decide."""
    df = spark.read.parquet(f"{SF_SMALL}/../sf0.01/pages.parquet")
    for r in df.collect():
        own = html_text.Weights(weights)
        bare = r["html"].replace("<article>", "<div>").replace("</article>", "</div>")
        assert html_text.main_text(bare, own) == html_text.main_text(r["html"], own)


def test_best_region_is_the_largest_sum():
    rng = np.random.default_rng(2)
    for _ in range(300):
        scores = [float(x) for x in rng.integers(-4, 5, rng.integers(0, 12))]
        sums = [0.0, *accumulate(scores)]
        every = [(sums[b] - sums[a], a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        a, b = html_text.best_region(scores)
        assert sums[b] - sums[a] == max([0.0, *(s for s, _, _ in every)])


def test_long_and_odd_pages_take_linear_time(weights):
    own = html_text.Weights(weights)
    for odd in ('<p a="', "<", "<div>", "<!--", "<script>", "<p>word ", "<article>x", "<main><article>", "<nav>", "<b>", "</x>"):
        html_text.main_text(odd * 20_000, own)
    assert html_text.main_text("<p>word</p>" * 20_000, own).count("word") == 20_000
