"""Language-model scoring: an interpolated modified Kneser-Ney bigram model counted in Spark.

A text is its words and one end token; the token before the first word is a
start token, which is never predicted.

Counting: every task hashes the tokens of its documents, adds up equal
bigrams and words of a batch, and sends them, cut by ranges of their hash and
packed, to the task of that range.  A bigram has at most one entry per batch,
so a frequent one makes no hot group, and ranges of a hash are even.

1. Tasks by ranges of the bigram hash merge the counts, write the range's
   sorted hash array and its counts, and send on, for each first word, how
   many bigrams occur once, twice and more often, and for each second word,
   how many different words precede it.
2. Tasks by ranges of the word hash merge these with the words' own counts
   and write the range's sorted word hashes with five counts each.

The arrays are files in the folder named by spark.checkpoint.dir, which must
be mounted on all workers (``mount`` maps its URI to a local path if it isn't
a file path).  Scoring tasks map the arrays into memory and look up the
sorted distinct hashes of a batch, range by range.  A file is written under
another name and then moved, so a repeated task leaves the same file.

Probabilities (Chen and Goodman, modified Kneser-Ney), with the discounts
D1, D2, D3+ from the counts of counts n1..n4 of each order:
  p(w|u) = max(c(uw) - D(c(uw)), 0) / c(u.) + (D1 N1(u.) + D2 N2(u.) + D3 N3+(u.)) / c(u.) * p(w)
  p(w)   = max(a(w) - D'(a(w)), 0) / A + (D1' m1 + D2' m2 + D3' m3+) / A / (V + 1)
with a(w) the number of different words before w, A their sum, V the number of
different tokens, and one share of the last term for all unknown words.  A
first word that was never seen leaves p(w).

Words are known by 64-bit hashes, bigrams by the upper 48 bits of their two
words' hashes, mixed to 64 bits.

Defined results: null text is empty and has only its end; without training
text all counts are 0, the base score is that of the formula and the model is
uniform; repeated rows count and are scored each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import io
import os
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tillpoint.llm.common import encoded, local_path, map_batches, pick, shared_folder, texts

END_TOKEN, START_TOKEN = b" end", b" start"        # no word holds a space
RANGE_TOKENS = 4_000_000
PART_CHARS = 4_000_000         # characters scored at a time


def hash_words(words: list[bytes]) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(words, dtype=object), categorize=True)


END, START = (int(x) for x in hash_words([END_TOKEN, START_TOKEN]))


def mix(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit hash of pairs of 48-bit hashes."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + second
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= first << np.uint64(16)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(16)


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """Number of the range of a 64-bit hash; it never falls as the hash grows."""
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Equally long arrays of integers, compressed; hashes byte by byte, as sorted ones differ in few bytes."""
    raw = io.BytesIO()
    raw.write(np.array([len(arrays[0])], "<i8").tobytes())
    for a in arrays:
        raw.write(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(raw.getvalue())


def unpack(data: bytes, arrays: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    out = []
    for i in range(arrays):
        planes = np.frombuffer(raw, np.uint8, n * 8, 8 + i * n * 8).reshape(8, n)
        out.append(np.ascontiguousarray(planes.T).view("<u8").ravel())
    return out


def grouped(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct keys, sorted by the first and then the others, with the sums of their values."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(new)
    sums = [np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values]
    return [k[at] for k in keys], sums


def cut(h: np.ndarray, ranges: int) -> list[tuple[int, slice]]:
    """(range, slice) of the parts of a sorted hash array."""
    r = range_of(h, ranges)
    at = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, int)
    return [(int(r[a]), slice(a, b)) for a, b in zip(at, np.append(at[1:], len(r)))]


def save(folder: str, name: str, array: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(draft, "wb") as f:
        np.save(f, array)
    os.replace(draft, f"{folder}/{name}.npy")


def tokens(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of some texts, each with its end, and the texts' lengths."""
    hashes, lengths = [np.zeros(0, np.uint64)], []
    words: list[bytes] = []
    for i, t in enumerate(docs):
        own = encoded(t).lower().split()        # bytes split at \x20 and \x09-\x0D alone
        words += own
        words.append(END_TOKEN)
        lengths.append(len(own) + 1)
        if len(words) >= 500_000 or i == len(docs) - 1:
            hashes.append(hash_words(words))
            words = []
    return np.concatenate(hashes), np.array(lengths, np.int64)


def before(h: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The token before each token."""
    out = np.empty_like(h)
    out[1:] = h[:-1]
    out[np.cumsum(lengths) - lengths] = np.uint64(START)
    return out


def _count_bigrams(ranges: int):
    def work(batch):
        h, lengths = tokens(texts(batch))
        u, w = short(before(h, lengths)), short(h)
        key = mix(u, w)
        order = np.argsort(key)
        key, u, w = key[order], u[order], w[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
        n = np.diff(np.append(at, len(key))).astype(np.uint64)
        key, u, w = key[at], u[at], w[at]
        for r, part in cut(key, ranges):
            by = np.lexsort((w[part], u[part]))
            yield {"kind": ["bigram"], "part": [r], "data": [pack(u[part][by], w[part][by], n[part][by])]}
    return work


def _count_words(ranges: int):
    def work(batch):
        h, lengths = tokens(texts(batch))
        (word,), (c,) = grouped([h], [np.ones(len(h), np.uint64)])
        for r, part in cut(word, ranges):
            yield {"kind": ["word"], "part": [r], "data": [pack(word[part], c[part])]}
        yield {"kind": ["texts"], "part": [0], "data": [pack(np.array([len(lengths)]))]}
    return work


def _merge_bigrams(folder: str, word_ranges: int):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        got = [unpack(x.as_py(), 3) for x in table.column("data")]
        u, w, n = (np.concatenate(x) for x in zip(*got))
        (u, w), (n,) = grouped([u, w], [n])
        key = mix(u, w)
        order = np.argsort(key)
        home = f"{folder}/bigrams/{part}"
        small = np.minimum(n[order], 255).astype(np.uint8)
        save(home, "hash", key[order])
        save(home, "count", small)
        save(home, "large_at", np.flatnonzero(small == 255))
        save(home, "large", n[order][small == 255])
        one = np.ones(len(n), np.uint64)
        (first,), by = grouped([u], [one * (n == 1), one * (n == 2), one * (n > 2)])
        (second,), (a,) = grouped([w], [one])
        rows = {"kind": [], "part": [], "data": []}

        def add(kind, r, *arrays):
            rows["kind"].append(kind), rows["part"].append(r), rows["data"].append(pack(*arrays))
        for r, s in cut(first << np.uint64(16), word_ranges):
            add("first", r, first[s], *[x[s] for x in by])
        for r, s in cut(second << np.uint64(16), word_ranges):
            add("second", r, second[s], a[s])
        add("count", 0, np.array([(n == k).sum() for k in (1, 2, 3, 4)]))
        return pa.table(rows, schema=pa.schema([("kind", pa.string()), ("part", pa.int32()), ("data", pa.binary())]))
    return run


def _merge_words(folder: str):
    schema = pa.schema([("name", pa.string()), ("value", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        by: dict[str, list] = {}
        for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
            by.setdefault(kind, []).append(data)

        def merged(kind: str, arrays: int):
            got = [unpack(x, arrays) for x in by.get(kind, [])] or [[np.zeros(0, np.uint64)] * arrays]
            key, *values = (np.concatenate(x) for x in zip(*got))
            (key,), values = grouped([key], values)
            return key, values
        out: dict[str, int] = {"texts": sum(int(unpack(x, 1)[0][0]) for x in by.get("texts", []))}
        for x in by.get("count", []):
            for k, v in enumerate(unpack(x, 1)[0].tolist()):
                out[f"n{k + 1}"] = out.get(f"n{k + 1}", 0) + v
        word, (c,) = merged("word", 2)
        first, n = merged("first", 4)
        second, (a,) = merged("second", 2)
        columns = np.zeros((5, len(word)), np.int64)        # count, N1, N2, N3+, a
        columns[0] = c
        for keys, values, at in ((first, n, 1), (second, [a], 4)):
            where = np.searchsorted(keys, short(word))
            hit = where < len(keys)
            hit[hit] = keys[where[hit]] == short(word)[hit]
            for i, v in enumerate(values):
                columns[at + i, hit] = v[where[hit]]
        start = first == short(np.array([START], np.uint64))[0]
        if start.any():
            for i, v in enumerate(n):
                out[f"start{i + 1}"] = int(v[start][0])
        a = columns[4]
        out |= {"tokens": int(columns[0].sum()), "words": len(word), "types": int(a.sum()), "m3+": int((a > 2).sum())}
        out |= {f"m{k}": int((a == k).sum()) for k in (1, 2, 3, 4)}
        save(f"{folder}/words/{part}", "hash", word)
        save(f"{folder}/words/{part}", "counts", columns)
        return pa.table({"name": list(out), "value": list(out.values())}, schema=schema)
    return run


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of entries with counts 1 to 4; where these are too few, 0.5, 1 and 1.5."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.0), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


class Model:
    """Where the arrays are, how many ranges there are, and the totals."""

    def __init__(self, folder: str, bigram_ranges: int, word_ranges: int, totals: dict[str, int]):
        get = lambda k: totals.get(k) or 0
        self.folder, self.bigram_ranges, self.word_ranges = folder, bigram_ranges, word_ranges
        self.tokens, self.words, self.types, self.texts = (get(k) for k in ("tokens", "words", "types", "texts"))
        self.d2 = np.array([0.0, *discounts([get(f"n{k}") for k in (1, 2, 3, 4)])])
        self.d1 = np.array([0.0, *discounts([get(f"m{k}") for k in (1, 2, 3, 4)])])
        self.start = [get(f"start{k}") for k in (1, 2, 3)]
        held = self.d1[1] * get("m1") + self.d1[2] * get("m2") + self.d1[3] * get("m3+")
        self.rest = (held / self.types if self.types else 1.0) / (self.words + 1)

    def lookup(self, kind: str, part: int, names: list[str]) -> list[np.ndarray] | None:
        home = f"{self.folder}/{kind}/{part}"
        if not os.path.exists(f"{home}/hash.npy"):
            return None
        return [np.load(f"{home}/{n}.npy", mmap_mode="r") for n in names]

    def word_counts(self, h: np.ndarray) -> np.ndarray:
        """Five counts of each of some sorted distinct word hashes."""
        out = np.zeros((5, len(h)), np.int64)
        for part, s in cut(h, self.word_ranges):
            got = self.lookup("words", part, ["hash", "counts"])
            if got is not None and len(got[0]):
                at = np.minimum(np.searchsorted(got[0], h[s]), len(got[0]) - 1)
                out[:, s] = np.where(got[0][at] == h[s], got[1][:, at], 0)
        return out

    def bigram_counts(self, key: np.ndarray) -> np.ndarray:
        out = np.zeros(len(key), np.int64)
        for part, s in cut(key, self.bigram_ranges):
            got = self.lookup("bigrams", part, ["hash", "count", "large_at", "large"])
            if got is not None and len(got[0]):
                at = np.minimum(np.searchsorted(got[0], key[s]), len(got[0]) - 1)
                n = np.where(got[0][at] == key[s], got[1][at], 0).astype(np.int64)
                big = n == 255
                n[big] = got[3][np.searchsorted(got[2], at[big])]
                out[s] = n
        return out

    def log10(self, h: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability and count of every token."""
        prev = before(h, lengths)
        distinct, back = np.unique(np.concatenate((h, prev)), return_inverse=True)
        counts = self.word_counts(distinct)
        at_start = distinct == np.uint64(START)
        counts[0, at_start] = self.texts
        counts[1:4, at_start] = np.array(self.start)[:, None]
        w, u = counts[:, back[: len(h)]], counts[:, back[len(h):]]
        keys, which = np.unique(mix(short(prev), short(h)), return_inverse=True)
        c = self.bigram_counts(keys)[which]
        low = np.maximum(w[4] - self.d1[np.minimum(w[4], 3)], 0) / max(1, self.types) + self.rest
        total = np.maximum(u[0], 1)
        gamma = (self.d2[1] * u[1] + self.d2[2] * u[2] + self.d2[3] * u[3]) / total
        high = np.maximum(c - self.d2[np.minimum(c, 3)], 0) / total
        p = np.where(u[0] > 0, high + gamma * low, low)
        return np.log10(p), w[0]


def train(docs: DataFrame, text_col: str = "text", mount: dict[str, str] | None = None,
          range_tokens: int = RANGE_TOKENS) -> Model:
    """Count and write the model of all texts."""
    spark = docs.sparkSession
    own = pick(docs, text=text_col)
    folder = local_path(shared_folder(spark, "bigram-model"), mount)
    chars = own.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(1, chars // (6 * range_tokens))
    rows = "kind string, part int, data binary"
    bigrams = map_batches(own, lambda: _count_bigrams(ranges), rows)
    words = map_batches(own, lambda: _count_words(ranges), rows)
    merged = bigrams.groupBy("part").applyInArrow(_merge_bigrams(folder, ranges), rows)
    stats = words.unionByName(merged).groupBy("part").applyInArrow(_merge_words(folder), "name string, value long")
    totals = {r["name"]: r["value"] for r in stats.groupBy("name").agg(F.sum("value").alias("value")).collect()}
    return Model(folder, ranges, ranges, totals)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, perplexity): log10 probabilities by add-one words and by the model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = pick(docs, id=id_col, text=text_col)

    def start():
        m = shared.value
        floor = np.log10(float(m.tokens + m.words + 1))

        def work(batch):
            docs, at = texts(batch), 0
            while at < len(docs):
                end, n = at, 0
                while end < len(docs) and (end == at or n + len(docs[end]) <= PART_CHARS):
                    n += len(docs[end])
                    end += 1
                h, lengths = tokens(docs[at:end])
                first = np.cumsum(lengths) - lengths
                logp, c = m.log10(h, lengths)
                total = np.add.reduceat(logp, first)
                yield {"id": batch.column("id").slice(at, end - at), "n_tokens": lengths,
                       "n_known": np.add.reduceat((c > 0).astype(np.int64), first),
                       "base_score": np.add.reduceat(np.log10(c + 1.0) - floor, first), "score": total,
                       "perplexity": 10 ** (-total / lengths)}
                at = end
        return work

    return map_batches(own, start, f"id {own.dtypes[0][1]}, n_tokens long, n_known long, base_score double,"
                       " score double, perplexity double").withColumnRenamed("id", id_col)
