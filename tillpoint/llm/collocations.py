"""Phrase collocations from a weighted de Bruijn graph of the corpus.

Texts are lower-cased, cut into pieces and words.  The graph of a language has
the phrases of ``longest - 1`` words as nodes and the phrases of ``longest``
words as edges between the overlapping nodes, weighted by their occurrences.

1. **Edges.**  Every word position sends the longest gram that begins there:
   an edge, or a shorter gram where the piece ends (the piece-end correction).
   Equal grams of a task are counted before they leave it, those that do not
   fit in memory by way of sorted files, and there is one task a core: with one
   a file split, a corpus of n times the text would have n times the frequent
   grams and send each from n times the tasks.
2. **Node flow.**  A phrase occurs as often as grams begin with it, so the
   count of a node is the flow of its out-edges and its piece ends, and so on
   down to single words.  The grams are dealt and sorted by range: a phrase's
   grams then stand side by side, and one scan sums up all levels.  Phrases
   that go on in the next range are added up afterwards, so a phrase that a
   third of all positions begin with is spread over many ranges.
3. **Unary paths.**  A node whose flow goes on whole (or to the given part)
   through one longer phrase, before or behind it, lies on a unary path and is
   compacted into it.  It is enough to look one word further: counts fall with
   length, so what lies between a phrase and a longer one with this share of
   its count has this share as well.

A phrase can be frequent only if its words and its shorter phrases are.  A
first pass counts words and pairs in a table of hashed slots (saturating
bytes, summed over all tasks); its slots that reach the least count become a
bit table.  A second pass counts the longer phrases whose pairs all have their
bit in a table of its own.  A gram then ends where its next longer one has no
bit, as at a piece end.  Slots never count too little, so no count of a
frequent phrase changes; slots that are full by accident only cost time.  The
tables grow with the corpus up to ``MOST_SLOTS`` (16 MB of bits each to the
driver and to the workers at any size of the corpus).

Defined results: null text is empty; a null language is ``und``; a text of
separators alone has no words; repeated rows count each; an empty table, or
one without frequent phrases, gives no rows; other columns are ignored.  A
piece is held by one task at a time, a text is cut into parts between pieces.
"""

from __future__ import annotations

import heapq
import os
import tempfile
import uuid
import zlib
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tillpoint.llm.common import encoded, pick, record_batch, written

# What separates pieces and words.  A-Z become a-z, separators of pieces one line end each.
PIECE_ENDS, WORD_ENDS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
TABLE = bytes(10 if b in PIECE_ENDS else 32 if b in WORD_ENDS else b + 32 if 65 <= b <= 90 else b for b in range(256))
UNKNOWN = "und"

PART_BYTES = 4_000_000          # of text that a task looks at at a time
EMIT_ROWS = 50_000
ROOM_BYTES = 32 << 20           # of grams that a task counts in memory; more wait in sorted files
HELD_BYTES = 4 << 30            # of grams, in memory and in files, that a task counts before it sends them
FILE_ROWS = 5_000               # of a file that are in memory at a time
TASK_BYTES = 1 << 30            # of text for one task, where that makes more tasks than there are cores
FEWEST_SLOTS, MOST_SLOTS, SLOT_CHARS, CHUNK_SLOTS = 1 << 20, 1 << 27, 32, 1 << 17
RANGE_BYTES = 32 << 20          # of text behind one range of grams


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def parts_of(batch: pa.RecordBatch):
    """(language, bytes) of a batch: folded texts of one language, parted by line ends, cut between pieces."""
    langs = batch.column("lang").to_pylist()
    texts = batch.column("text")
    by_lang: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        by_lang.setdefault(UNKNOWN if lang is None else lang, []).append(i)
    for lang, rows in by_lang.items():
        held, size = [], 0
        for i in rows:
            text = texts[i].as_py()
            if not text:
                continue
            data = encoded(text).translate(TABLE)
            if size and size + len(data) > PART_BYTES:
                yield lang, b"\n".join(held)
                held, size = [], 0
            while len(data) > PART_BYTES:
                cut = data.find(b"\n", PART_BYTES)
                if cut < 0:
                    break
                yield lang, data[:cut]
                data = data[cut + 1:]
            held.append(data)
            size += len(data)
        if held:
            yield lang, b"\n".join(held)


class Part:
    """Words of a part by number, and the hashes that slots are taken from."""

    def __init__(self, lang: str, data: bytes):
        self.words = data.split()                   # space and line end are the only white space left
        raw = np.frombuffer(data, np.uint8)
        end = raw == 10
        blank = end | (raw == 32)
        begins = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1]))) if len(raw) else np.zeros(0, np.int64)
        piece = np.cumsum(end)[begins] if len(raw) else begins
        self.joined = piece[1:] == piece[:-1]       # word i and word i + 1 stand in one piece
        self.code, self.distinct = pd.factorize(np.array(self.words, dtype=object))
        self.code = self.code.astype(np.int64)
        salt = np.uint64(zlib.crc32(encoded(lang)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        self.hashes = mixed(pd.util.hash_array(self.distinct, categorize=False) ^ salt) if len(self.words) else np.zeros(0, np.uint64)

    def gram_hashes(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the grams of k words that begin at these places."""
        h = self.hashes[self.code[at]]
        for i in range(1, k):
            h = mixed(h * np.uint64(3) + self.hashes[self.code[at + i]] + np.uint64(1))
        return h

    def known_pairs(self, bits: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words, and which pairs with the next word of the piece, have their bit."""
        known = bit(bits, slot(self.hashes, slots))[self.code]
        pair = np.append(self.joined & known[:-1] & known[1:], False)
        at = np.flatnonzero(pair)
        pair[at] = bit(bits, slot(self.gram_hashes(at, 2), slots))
        return known, pair


def slot(hashes: np.ndarray, slots: int) -> np.ndarray:
    return (hashes % np.uint64(slots)).astype(np.int64)


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow with a function from batches to dicts of columns."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def out(batches):
        for columns in run(batches):
            yield record_batch(columns, arrow)
    return df.mapInArrow(out, schema)


def frequent_slots(rows: DataFrame, least: int, slots: int, tasks: int, longest: int, bits=None) -> np.ndarray:
    """Bit table of the slots that words and pairs fill ``least`` times or more; given that one, that of longer grams."""
    top = min(least, 127)               # bytes saturate above it; slots that reach ``top`` count as full

    def count(batches):
        table = np.zeros(slots, np.uint8)

        def add(hashes: np.ndarray) -> None:
            at, n = np.unique(slot(hashes, slots), return_counts=True)
            table[at] = np.minimum(table[at] + n, top).astype(np.uint8)
        for batch in batches:
            for lang, data in parts_of(batch):
                part = Part(lang, data)
                if not part.words:
                    continue
                if bits is None:
                    add(part.hashes[part.code])
                    add(part.gram_hashes(np.flatnonzero(part.joined), 2))
                    continue
                pair = part.known_pairs(bits.value, slots)[1]
                more = pair
                for k in range(3, longest + 1):
                    more = more[:-1] & pair[k - 2:]         # places where k words go on by known pairs
                    add(part.gram_hashes(np.flatnonzero(more), k))
        pack = zstandard.ZstdCompressor(level=1).compress
        for i, chunk in enumerate(table.reshape(-1, CHUNK_SLOTS)):
            if chunk.any():
                yield {"chunk": [i], "counts": [pack(chunk.tobytes())]}

    def total(batches):
        """Chunks arrive in order, those of one number together: one chunk is held at a time."""
        unpack = zstandard.ZstdDecompressor().decompress
        now, table = None, None
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
                if chunk != now:
                    if now is not None:
                        yield {"chunk": [now], "bits": [np.packbits(table >= top).tobytes()]}
                    now, table = chunk, np.zeros(CHUNK_SLOTS, np.uint16)
                table = np.minimum(table + np.frombuffer(unpack(counts.as_py()), np.uint8), top)
        if now is not None:
            yield {"chunk": [now], "bits": [np.packbits(table >= top).tobytes()]}
    sums = arrow_map(arrow_map(rows, count, "chunk int, counts binary").repartition(tasks, "chunk")
                     .sortWithinPartitions("chunk"), total, "chunk int, bits binary")
    bits = np.zeros(slots // 8, np.uint8)
    for chunk, data in sums.collect():                      # MOST_SLOTS / 8 bytes at most
        bits[chunk * CHUNK_SLOTS // 8:(chunk + 1) * CHUNK_SLOTS // 8] = np.frombuffer(data, np.uint8)
    return bits


def bit(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def escaped(words: list[bytes]) -> list[bytes]:
    """A word never holds the bytes 0 and 1 bare, so that 0 ends it and grams sort word by word."""
    return [w.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1") if b"\0" in w or b"\1" in w else w for w in words]


def plain(word: bytes) -> bytes:
    return word.replace(b"\1\1", b"\0").replace(b"\1\2", b"\1") if b"\1" in word else word


class Grams:
    """Counts of the grams of a task; beyond ``room`` bytes they wait in sorted files, and are merged when they are sent."""

    def __init__(self, room: int, folder: str):
        self.room, self.folder = room, folder
        self.held: dict[str, dict[bytes, int]] = {}
        self.files: list[str] = []
        self.size = self.waiting = 0        # bytes in memory and, at the same measure, in files

    def add(self, lang: str, grams: list[bytes], counts: list[int]) -> None:
        own = self.held.setdefault(lang, {})
        get, before = own.get, len(own)
        for gram, n in zip(grams, counts):
            own[gram] = get(gram, 0) + n
        if len(own) > before:           # at the mean length of these grams; each has its count and its place beside it
            self.size += (len(own) - before) * (128 + sum(map(len, grams)) // len(grams))
        if self.size > self.room:
            self._to_file()

    def _in_order(self):
        for lang in sorted(self.held):
            own = self.held[lang]
            for gram in sorted(own):
                yield lang, gram, own[gram]

    def _to_file(self) -> None:
        path = os.path.join(self.folder, uuid.uuid4().hex)
        schema = pa.schema([("lang", pa.string()), ("gram", pa.binary()), ("n", pa.int64())])
        rows = self._in_order()
        with pa.OSFile(path, "wb") as file, pa.ipc.new_stream(file, schema, options=pa.ipc.IpcWriteOptions(
                compression="zstd")) as out:
            while some := list(islice(rows, FILE_ROWS)):
                out.write_batch(record_batch(dict(zip(schema.names, zip(*some))), schema))
        self.files.append(path)
        self.waiting += self.size
        self.held, self.size = {}, 0

    @staticmethod
    def _of_file(path: str):
        with pa.OSFile(path) as file:
            for batch in pa.ipc.open_stream(file):
                yield from zip(*[c.to_pylist() for c in batch.columns])

    def sent(self):
        """Columns of all grams and their counts, each gram once; nothing is held then."""
        whole = groupby(heapq.merge(self._in_order(), *map(self._of_file, self.files)), itemgetter(0, 1))
        rows = ((*gram, sum(n for *_, n in same)) for gram, same in whole)
        while some := list(islice(rows, EMIT_ROWS)):
            yield dict(zip(("lang", "gram", "n"), zip(*some)))
        for path in self.files:
            os.remove(path)
        self.held, self.files, self.size, self.waiting = {}, [], 0, 0


def longest_grams(rows: DataFrame, bits, long_bits, slots: int, longest: int) -> DataFrame:
    """(lang, gram, n): the longest gram from every position, counted per task; and, under an empty gram, all words.

    A task that has more than ``HELD_BYTES`` of grams sends what it has counted and begins anew.
    """
    room, most = min(ROOM_BYTES, HELD_BYTES), HELD_BYTES

    def run(batches):
        with tempfile.TemporaryDirectory(prefix="grams-") as folder:
            yield from counted(batches, Grams(room, folder))

    def counted(batches, grams):
        for batch in batches:
            for lang, data in parts_of(batch):
                part = Part(lang, data)
                total = len(part.words)
                if not total:
                    continue
                grams.add(lang, [b""], [total])
                code, many = part.code, len(part.distinct)
                known, pair = part.known_pairs(bits.value, slots)
                words = escaped(part.words)
                at = np.flatnonzero(known)
                node = code[at]                         # numbers of the grams of k words that begin at ``at``
                for k in range(1, longest + 1):
                    on = np.zeros(len(at), bool)            # whether a gram of k words goes on
                    if k < longest:
                        on = pair[at + k - 1]
                        if k > 1:
                            go = np.flatnonzero(on)
                            on[go] = bit(long_bits.value, slot(part.gram_hashes(at[go], k + 1), slots))
                    gone = ~on
                    ends, found = pd.factorize(node[gone])
                    counts = np.bincount(ends, minlength=len(found))
                    some = np.zeros(len(found), np.int64)
                    some[ends] = at[gone]               # a place where each gram stands
                    for a in range(0, len(some), EMIT_ROWS):
                        grams.add(lang, [b"\0".join(words[i:i + k]) + b"\0" for i in some[a:a + EMIT_ROWS].tolist()],
                                  counts[a:a + EMIT_ROWS].tolist())
                        if grams.size + grams.waiting > most:
                            yield from grams.sent()
                    if k == longest or not on.any():
                        break
                    at, node = at[on], node[on]
                    node, found = pd.factorize(node * many + code[at + k])
        yield from grams.sent()
    return arrow_map(rows, run, "lang string, gram binary, n long")


def flow(grams: DataFrame, least: int, longest: int, ranges: int) -> DataFrame:
    """(lang, words array<binary>, f) of the phrases with ``least`` occurrences or more; empty words: all of them."""
    def run(batches):
        """Grams in order: the counts of the phrases that the present gram begins with are kept, one per length."""
        out: list[tuple] = []
        lang, now, counts = None, [], []
        first: list | None = None       # what the range's first gram begins with may belong to the range before

        def leave(depth: int, last: bool = False) -> None:
            while len(now) > depth:
                n, k = counts.pop(), len(now)
                # a phrase that the first or the last gram begins with may go on in another range
                if n >= least or last or first[:k + 1] == [lang, *now]:
                    out.append((lang, list(now), n))
                now.pop()

        def rows():
            found = {"lang": [r[0] for r in out], "words": [[plain(w) for w in r[1]] for r in out], "n": [r[2] for r in out]}
            out.clear()
            return found
        for batch in batches:
            for own, gram, n in zip(batch.column("lang").to_pylist(), batch.column("gram").to_pylist(),
                                    batch.column("n").to_pylist()):
                if not gram:
                    out.append((own, [], n))
                    continue
                words = gram[:-1].split(b"\0")
                if first is None:
                    first = [own, *words]
                if own != lang:
                    leave(0)
                    lang = own
                same = 0
                for x, y in zip(now, words):
                    if x != y:
                        break
                    same += 1
                if same < len(now):
                    leave(same)
                for w in words[same:]:
                    now.append(w)
                    counts.append(0)
                for k in range(len(words)):
                    counts[k] += n
            if len(out) >= EMIT_ROWS:
                yield rows()
        leave(0, last=True)
        yield rows()
    dealt = grams.repartitionByRange(ranges, "lang", "gram").sortWithinPartitions("lang", "gram")
    return (arrow_map(dealt, run, "lang string, words array<binary>, n long").groupBy("lang", "words")
            .agg(F.sum("n").alias("f")).filter((F.col("f") >= least) | (F.size("words") == 0)))


def phrase_counts(docs: DataFrame, least: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang"
                  ) -> DataFrame:
    """(lang, words array<binary>, f): phrases of 1 to ``longest`` words that occur ``least`` times or more.

    The row with no words counts all words of the language.
    """
    rows = pick(docs, text=text_col, lang=lang_col).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    spark = docs.sparkSession
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = min(MOST_SLOTS, max(FEWEST_SLOTS, 1 << (chars // SLOT_CHARS).bit_length()))
    ranges = max(1, chars // RANGE_BYTES)
    tasks = min(64, ranges)
    # what a task sends, a table of slots or its grams, grows with the corpus: so the tasks must not, as long as they fit
    rows = rows.coalesce(max(spark.sparkContext.defaultParallelism, chars // TASK_BYTES))
    bits = spark.sparkContext.broadcast(frequent_slots(rows, least, slots, tasks, longest))
    long_bits = spark.sparkContext.broadcast(frequent_slots(rows, least, slots, tasks, longest, bits))
    grams = written(longest_grams(rows, bits, long_bits, slots, longest), "grams")
    return flow(grams, least, longest, ranges)


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, keep: int = 2000, share: int = 100,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``keep`` best phrases of each language.

    A phrase inside a longer one with ``share`` hundredths of its count is compacted into that one.
    """
    found = written(phrase_counts(docs, least, longest, text_col, lang_col), "phrases")
    totals = found.filter(F.size("words") == 0).select(F.col("lang").alias("t_lang"), F.col("f").alias("n"))
    counts = found.filter(F.size("words") > 0).select("lang", _joined("words").alias("phrase"), "words", "f")
    phrases = counts.filter(F.size("words") > 1)
    # the largest count of a phrase one word longer, behind or before
    size = F.size("words")
    behind = phrases.filter(size > 2).select("lang", _joined(F.slice("words", 1, size - 1)).alias("phrase"), "f")
    before = phrases.filter(size > 2).select("lang", _joined(F.slice("words", 2, size - 1)).alias("phrase"), "f")
    longer = behind.unionByName(before).groupBy("lang", "phrase").agg(F.max("f").alias("more"))
    ends = (phrases.join(longer, ["lang", "phrase"], "left")
            .filter(F.col("more").isNull() | (100 * F.col("more") < share * F.col("f"))))
    # every cut of a phrase into two, with the counts of both
    cut = F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(
        k.alias("k"), _joined(F.slice("words", F.lit(1), k)).alias("left"),
        _joined(F.slice("words", k + 1, F.size("words"))).alias("right"))))
    cuts = ends.select("lang", "phrase", F.col("f").alias("a"), cut.alias("c")).select(
        "lang", "phrase", "a", "c.k", "c.left", "c.right")
    lefts = counts.select(F.col("lang").alias("l_lang"), F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = counts.select(F.col("lang").alias("r_lang"), F.col("phrase").alias("right"), F.col("f").alias("r"))
    whole = "decimal(38,0)"             # 1000 a n and l r pass 64 bits
    scored = (cuts.join(lefts.withColumnRenamed("l_lang", "lang"), ["lang", "left"])
              .join(rights.withColumnRenamed("r_lang", "lang"), ["lang", "right"])
              .join(totals.withColumnRenamed("t_lang", "lang"), "lang")
              .withColumn("score", F.expr(f"(cast(1000 as {whole}) * a * n) div (cast(l as {whole}) * r)")))
    best = (scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"),
                                                 F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)
            .select("lang", F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"),
                    "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")))


def _joined(words: str | Column) -> Column:
    """Words joined by spaces, as bytes, so that any bytes stay as they are and compare by value."""
    return F.array_join(F.transform(words, lambda w: w.cast("string")), " ").cast("binary")
