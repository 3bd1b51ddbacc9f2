"""Benchmark decontamination with an FM-index per shard of training text.

A test phrase is a window of ``n`` consecutive words of a benchmark item (an
item of fewer words is one phrase).  Each task cuts its documents into shards,
indexes every shard and looks up all phrases at once:

* symbols are the words of the benchmark's vocabulary; a run of other words,
  and the end of a document, is one separator (no phrase can cross it);
* the suffixes of the shard are sorted, separators by position, which gives
  the Burrows-Wheeler transform, kept as a wavelet matrix of prefix counts;
* backward search takes a phrase's words from last to first and narrows the
  interval of suffixes by two ranks per word, for all phrases together;
* an occurrence is located by stepping back to the next sampled position: one
  in ``SAMPLE`` and the first word of every run, so a step never meets a
  separator;
* occurrences become word spans, overlapping and touching spans are merged.

The benchmark is read in blocks of at most about ``block_chars`` characters;
the driver holds and broadcasts one block's phrases at a time.  Every block is
one more pass over the documents inside the same stage, with no shuffle.

Defined results: null text has no words; a null item id counts as 'null';
items without words have no phrase; repeated items and rows are each looked
up; an empty benchmark leaves all clean; an empty table gives no rows; extra
columns are ignored, or handed on if named in ``carry``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tillpoint.llm.common import ddl, map_batches, pick, texts, word_char_spans, words

SAMPLE = 8
SHARD_SYMBOLS = 1 << 18
PIECE_BYTES = 4 << 20           # of a batch that a task looks at at a time


def sorted_order(*keys: np.ndarray) -> np.ndarray:
    """Stable order by non-negative integer keys, the first one leading: packed in one integer where they fit."""
    n = len(keys[0])
    sizes = [int(k.max(initial=0)).bit_length() for k in keys]
    tail = max(1, n - 1).bit_length()
    if sum(sizes) + tail > 63:
        return np.lexsort(keys[::-1])
    packed = np.zeros(n, np.int64)
    for k, bits in zip(keys, sizes):
        packed = packed << bits | k
    return np.sort(packed << tail | np.arange(n)) & ((1 << tail) - 1)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes; each 0 is a separator of its own that ends a suffix, separators sorted by position."""
    n = len(symbols)
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    depth = min(n, max(1, (63 - n.bit_length()) // bits))
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for d in range(depth):
        ahead = np.zeros(n, np.int64)
        ahead[: n - d] = symbols[d:]
        key = key << bits | np.where(alive, ahead, 0)
        alive &= ahead != 0
    order = sorted_order(key)
    rank = np.empty(n, np.int64)
    # one rank for suffixes that agree so far; those that met a separator are told apart by position already
    new = np.ones(n, bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | ~alive[order][1:]
    while True:
        start = np.flatnonzero(new)
        rank[order] = np.repeat(start, np.diff(np.append(start, n)))
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        who = order[at]
        behind = rank[np.minimum(who + depth, n - 1)]
        by = sorted_order(rank[who], behind)
        order[at] = who[by]
        r, b = rank[who][by], behind[by]
        new[at] = np.append(True, (r[1:] != r[:-1]) | (b[1:] != b[:-1]))
        depth *= 2


class FMIndex:
    """Counts and places of symbol sequences in one text; 0 is the separator and is never searched."""

    def __init__(self, symbols: np.ndarray):
        order = suffix_array(symbols)
        n = len(symbols)
        before = symbols[order - 1]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=int(symbols.max(initial=0)) + 2))))
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.zeros, self.zero_total = [], []
        for level in range(self.bits - 1, -1, -1):
            one = (before >> level & 1).astype(bool)
            self.zeros.append(np.concatenate(([0], np.cumsum(~one, dtype=np.int32))))
            self.zero_total.append(int(self.zeros[-1][-1]))
            before = np.concatenate((before[~one], before[one]))
        run_start = np.ones(n, bool)
        run_start[1:] = symbols[:-1] == 0
        kept = (run_start | (np.arange(n) % SAMPLE == 0))[order]
        self.sample_rank = np.concatenate(([0], np.cumsum(kept, dtype=np.int32)))
        self.samples = order[kept]

    def _down(self, level: int, bit: np.ndarray, at: np.ndarray) -> np.ndarray:
        zeros = self.zeros[level][at]
        return np.where(bit, self.zero_total[level] + at - zeros, zeros)

    def ranks(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before row ``at`` of the transform."""
        low = np.zeros_like(at)
        for level in range(self.bits):
            bit = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            low, at = self._down(level, bit, low), self._down(level, bit, at)
        return at - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of suffixes of each phrase (rows of equal length); empty where low >= high."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.zeros[0].size - 1, np.int64)
        live = np.arange(len(phrases))
        for word in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, word]
            known = c < len(self.first) - 1
            low[live[~known]] = high[live[~known]] = 0
            live, c = live[known], c[known]
            low[live] = self.first[c] + self.ranks(c, low[live])
            high[live] = self.first[c] + self.ranks(c, high[live])
            live = live[low[live] < high[live]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order."""
        out, steps = np.empty(len(rows), np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.sample_rank[rows + 1] > self.sample_rank[rows]
            out[todo[hit]] = self.samples[self.sample_rank[rows[hit]]] + steps
            todo, rows = todo[~hit], rows[~hit]
            symbol, at, low = np.zeros_like(rows), rows, np.zeros_like(rows)
            for level in range(self.bits):
                bit = self.zeros[level][at + 1] == self.zeros[level][at]
                symbol = symbol << 1 | bit
                at, low = self._down(level, bit, at), self._down(level, bit, low)
            rows = self.first[symbol] + at - low
            steps += 1
        return out


class Phrases:
    """Distinct windows of some benchmark items, by length, with the items that hold them."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            w = words(text)
            for i in range(max(1, len(w) - n + 1) if w else 0):
                owners.setdefault(tuple(w[i:i + n]), set()).add(item)
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for p in owners for w in p}))}
        self.owners = [sorted(o) for o in owners.values()]
        by_length: dict[int, list[int]] = {}
        listed = list(owners)
        for i, p in enumerate(listed):
            by_length.setdefault(len(p), []).append(i)
        self.groups = [(np.array([[self.vocabulary[w] for w in listed[i]] for i in which], np.int64), np.array(which))
                       for which in by_length.values()]


def shard_hits(shard: list[list[bytes]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, length, phrase) of every occurrence; positions count words of the shard and one gap per document."""
    known = phrases.vocabulary.get
    ids = np.zeros(sum(map(len, shard)) + len(shard) + 1, np.int64)
    at = 1
    for doc in shard:
        ids[at:at + len(doc)] = np.fromiter((known(w, 0) for w in doc), np.int64, len(doc))
        at += len(doc) + 1
    kept = np.flatnonzero((ids != 0) | (np.append(1, ids[:-1]) != 0))       # a run of separators becomes one
    symbols = ids[kept]
    if not symbols.any():
        return (np.zeros(0, np.int64),) * 3
    index = FMIndex(symbols)
    found = [(np.zeros(0, np.int64),) * 3]
    for group, numbers in phrases.groups:
        low, high = index.search(group)
        count = np.maximum(high - low, 0)
        rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        where = kept[index.locate(rows)] - 1
        found.append((where, np.full(len(where), group.shape[1]), np.repeat(numbers, count)))
    return tuple(np.concatenate(x) for x in zip(*found))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _lookup(phrases, last: bool):
    """map_batches function of one block of phrases; the last block adds character spans and the cleaned text."""
    def work(batch):
        docs = texts(batch)
        spans = [[(s["start_word"], s["end_word"]) for s in x] for x in batch.column("_spans").to_pylist()]
        items = [set(x) for x in batch.column("_items").to_pylist()]
        n_words = []
        shard, base, size = [], 0, 0

        def search():
            where, length, phrase = shard_hits(shard, phrases.value)
            starts = np.cumsum([0] + [len(d) + 1 for d in shard])
            doc = np.searchsorted(starts, where, side="right") - 1
            for d, w, n, p in zip(doc.tolist(), (where - starts[doc]).tolist(), length.tolist(), phrase.tolist()):
                spans[base + d].append((w, w + n))
                items[base + d].update(phrases.value.owners[p])

        for i, text in enumerate(docs):
            w = words(text)
            n_words.append(len(w))
            if shard and size + len(w) >= SHARD_SYMBOLS:
                search()
                shard, base, size = [], i, 0
            shard.append(w)
            size += len(w) + 1
        if shard:
            search()
        out_spans, clean = [], []
        for text, s in zip(docs, spans):
            s = merged(s)
            begin, end = [0] * len(s), [0] * len(s)
            if s and last:
                begin = word_char_spans(text, np.array([a for a, _ in s]))[0].tolist()
                end = word_char_spans(text, np.array([b - 1 for _, b in s]))[1].tolist()
            out_spans.append([{"start_word": a, "end_word": b, "start": x, "end": y}
                              for (a, b), x, y in zip(s, begin, end)])
            clean.append("".join(text[a:b] for a, b in zip([0, *end], [*begin, len(text)])) if s and last else None)
        yield ({n: batch.column(n) for n in batch.schema.names} | {
            "_n_words": n_words, "_spans": out_spans, "_items": [sorted(x) for x in items], "_clean": clean})
    return work


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", block_chars: int = 1 << 24,
                  carry: list[str] = ()) -> DataFrame:
    """(id, n_words, spans, items, clean_text) and the ``carry`` columns.

    spans: array<struct<start_word, end_word, start, end>>, merged, in words and code points, ends exclusive.
    items: ids of the items with an occurring phrase.  clean_text: the text without the spans; null if it has none.
    """
    sc = docs.sparkSession.sparkContext
    bench = pick(benchmark, item=item_col, text=item_text).select(
        F.coalesce(F.col("item").cast("string"), F.lit("null")).alias("item"), "text")
    blocks = max(1, -(-(bench.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    own = {"id": id_col, "text": text_col} | {f"c_{i}": c for i, c in enumerate(carry)}
    out = pick(docs, **own)
    schema = ddl(out) + (", _n_words long, _spans array<struct<start_word: long, end_word: long, start: long, end: long>>,"
                         " _items array<string>, _clean string")
    out = out.selectExpr("*", "cast(0 as long) _n_words", "cast(array() as array<struct<start_word: long, end_word: long,"
                         " start: long, end: long>>) _spans", "cast(array() as array<string>) _items",
                         "cast(null as string) _clean")
    for b in range(blocks):
        items = bench.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        phrases = sc.broadcast(Phrases([(r["item"], r["text"]) for r in items], n))
        out = map_batches(out, lambda p=phrases, last=b == blocks - 1: _lookup(p, last), schema, PIECE_BYTES)
    return out.select(F.col("id").alias(id_col), F.col("_n_words").alias("n_words"), F.col("_spans").alias("spans"),
                      F.col("_items").alias("items"), F.col("_clean").alias("clean_text"),
                      *[F.col(f"c_{i}").alias(c) for i, c in enumerate(carry)])
