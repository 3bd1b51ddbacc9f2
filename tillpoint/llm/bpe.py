"""Byte-level BPE encoding and decoding with a global shuffle of distinct words.

Encoding merges bytes inside one pre-token at a time, so a pre-token has the
same ids wherever it stands.  Documents are read in blocks:

1. each block is split into pre-tokens once; it lists its distinct ones, most
   frequent first, and packs the order they stand in, with the lengths and the
   columns of its documents, into a file of its task in the shared folder;
2. the distinct words are dealt by a hash of the word into parts, packed one
   row per block and part, so all uses of a word in the corpus meet in one
   task, which encodes it once and hands the ids to each block;
3. the ids of a block's words meet in one task, which reads the order back
   from the file and puts the ids together by position.

A word is sent once per block that holds it, so the most frequent word of all
is no more than one entry per block.  The parts grow in number with the
corpus, so that a part has about ``part_chars`` characters of text behind it.
A block's words fit in memory (``block_chars`` characters, or one document if
that is longer).

A block goes by the place of its order, a file that no other task has written
and the bytes in it, so blocks of the same copies have names of their own and
a hot group of copies is spread over the tasks.  Texts are read once: input
whose rows come in another order when a task runs again is no harm, the new
task has a new file.  The shared folder must be mounted on all workers
(``mount`` maps its URI to a local path if it isn't one).

Pre-tokens: the pattern is applied to distinct chunks only.  A chunk is a run
of spaces and line ends with the run of other characters behind it; no match
of the pattern goes over the end of a chunk, and what follows a chunk never
changes the matches inside.  Texts with other white space take the pattern as
a whole.

Decoding joins ids with the table of token bytes, which is as large as the
vocabulary file and is broadcast.

Defined results: null text is empty and has no ids; repeated rows are encoded
each; an empty table gives no rows; extra columns are ignored, or handed on
if named in ``carry``.  An id that is not in the vocabulary raises an error.
"""

from __future__ import annotations

import base64
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tillpoint.llm.common import ddl, local_path, map_batches, pick, record_batch, shared_folder, texts

CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
# White space other than the space and the line end.
ODD_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
BLOCK_CHARS = 4_000_000
PART_CHARS = 16_000_000
DECODE_IDS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file (a few MB; read on the driver)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Numbers(dict):
    """Numbers of distinct keys in order of appearance."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def pretokens(chunks: list[str], pattern) -> tuple[list[str], np.ndarray]:
    """All matches of the pattern in some distinct chunks, in order, and the number of them in each chunk.

    Chunks that begin with white space and end with another character are matched as one text: what follows
    such a chunk begins with white space again, so matches end where chunks end.
    """
    joins = [c[0] in " \n" and c[-1] not in " \n" for c in chunks]
    found: list[str] = []
    counts = np.zeros(len(chunks), np.int64)
    at = 0
    while at < len(chunks):
        end = at
        while end < len(chunks) and joins[end]:
            end += 1
        if end > at:
            got = pattern.findall("".join(chunks[at:end]))
            stops = np.cumsum([len(c) for c in chunks[at:end]])
            counts[at:end] = np.diff(np.searchsorted(np.cumsum([len(g) for g in got]), stops, side="right"), prepend=0)
            found += got
            at = end
        if at < len(chunks) and not joins[at]:
            got = pattern.findall(chunks[at])
            counts[at] = len(got)
            found += got
            at += 1
    return found, counts


class Block:
    """Documents of a block as numbers of distinct pre-tokens, the most frequent first."""

    def __init__(self, docs: list[str], pattern):
        chunks, odd = Numbers(), []
        runs = []
        for i, text in enumerate(docs):
            if ODD_SPACE.search(text):
                odd.append(i)
                runs.append(np.zeros(0, np.int32))
            else:
                pieces = CHUNK.findall(text)
                runs.append(np.fromiter(map(chunks.__getitem__, pieces), np.int32, len(pieces)))
        numbers = Numbers()
        found, size = pretokens(list(chunks), pattern)
        flat = np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))
        begin = np.cumsum(size) - size
        orders = []
        for run in runs:
            n = size[run]
            orders.append(flat[np.repeat(begin[run] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        for i in odd:
            got = pattern.findall(docs[i])
            orders[i] = np.fromiter(map(numbers.__getitem__, got), np.int32, len(got))
        self.lengths = [len(o) for o in orders]
        order = np.concatenate(orders) if orders else np.zeros(0, np.int32)
        rank = np.empty(len(numbers), np.int64)
        rank[np.argsort(-np.bincount(order, minlength=len(numbers)), kind="stable")] = np.arange(len(numbers))
        self.order = rank[order].astype(np.uint32)
        self.words = [b""] * len(numbers)
        for w, r in zip(numbers, rank.tolist()):
            self.words[r] = w.encode("utf-8", "surrogatepass")

    def parts(self, parts: int) -> np.ndarray:
        """The part of each word; the words of a part keep their order."""
        return np.fromiter(map(zlib.crc32, self.words), np.int64, len(self.words)) % parts


def pack(numbers: np.ndarray, rest: bytes = b"") -> bytes:
    """32-bit numbers byte by byte, so that small ones compress well, and some more bytes."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(len(numbers).to_bytes(8, "little") + planes.tobytes() + rest)


def unpack(data: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(raw, np.uint8, 4 * n, 8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel(), raw[8 + 4 * n:]


def blocks_of(batch: pa.RecordBatch, block_chars: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of the blocks of a batch; one block's texts are held at a time."""
    sizes = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
    at = 0
    while at < len(sizes):
        end, size = at, 0
        while end < len(sizes) and (end == at or size + sizes[end] <= block_chars):
            size += sizes[end]
            end += 1
        yield at, texts(batch.slice(at, end - at))
        at = end


class OrderFile:
    """What a task keeps of its blocks for the time after the shuffle of words: one file in the shared folder."""

    def __init__(self, folder: str):
        os.makedirs(folder, exist_ok=True)
        self.name = uuid.uuid4().hex
        self.file = open(f"{folder}/{self.name}", "xb")

    def add(self, order: np.ndarray, parts: np.ndarray, docs: pa.RecordBatch) -> str:
        """Name of a block: file, first byte and number of bytes."""
        table = pa.BufferOutputStream()
        with pa.ipc.new_stream(table, docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            to.write_batch(docs)
        blobs = [pack(order), pack(parts), table.getvalue().to_pybytes()]
        head = b"".join(len(b).to_bytes(8, "little") for b in blobs)
        begin = self.file.tell()
        self.file.write(head + b"".join(blobs))
        self.file.flush()               # the block's rows leave the task after this
        return f"{self.name}:{begin}:{self.file.tell() - begin}"


def kept_order(folder: str, block: str) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    """Order, parts and documents of a block that a task has kept."""
    name, begin, size = block.split(":")
    with open(f"{folder}/{name}", "rb") as f:
        f.seek(int(begin))
        data = f.read(int(size))
    ends = 24 + np.cumsum(np.frombuffer(data, "<u8", 3).astype(np.int64))
    order, parts, docs = (data[a:b] for a, b in zip([24, *ends], ends))
    return unpack(order)[0], unpack(parts)[0], pa.ipc.open_stream(docs).read_all()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text",
           carry: list[str] = (), block_chars: int = BLOCK_CHARS, part_chars: int = PART_CHARS,
           mount: dict[str, str] | None = None) -> DataFrame:
    """(id, ids array<int>) and the ``carry`` columns."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    rows = pick(docs, **{"id": id_col, "text": text_col} | {f"c_{i}": c for i, c in enumerate(carry)})
    kept = [c for c in rows.columns if c != "text"]
    types = dict(rows.dtypes)
    folder = local_path(shared_folder(docs.sparkSession, "word-order"), mount)
    parts = max(1, (rows.agg(F.sum(F.length("text"))).first()[0] or 0) // part_chars)
    tasks = max(parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def list_words():
        compiled, file = regex.compile(pattern), OrderFile(folder)

        def work(batch):
            for at, own in blocks_of(batch, block_chars):
                block = Block(own, compiled)
                part = block.parts(parts)
                docs_of = pa.RecordBatch.from_arrays(
                    [pa.array(block.lengths, pa.int64()), *[batch.column(c).slice(at, len(own)) for c in kept]],
                    names=["lengths", *kept])
                name = file.add(block.order, part, docs_of)
                order = np.argsort(part, kind="stable")
                # a block without any word is sent as well, for its documents
                for p, begin in zip(*np.unique(part[order], return_index=True)) if len(order) else [(0, 0)]:
                    some = [block.words[i] for i in order[begin:np.searchsorted(part[order], p, side="right")]]
                    yield {"part": [p], "block": [name],
                           "words": [pack(np.array([len(w) for w in some], np.uint32), b"".join(some))]}
        return work

    def encode_part(table: pa.Table) -> pa.Table:
        merges = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        known: dict[bytes, list[int]] = {}          # each distinct word is encoded once
        out = []
        for data in table.column("words"):
            sizes, raw = unpack(data.as_py())
            ends = np.cumsum(sizes).tolist()
            got = []
            for a, b in zip([0, *ends], ends):
                w = raw[a:b]
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = merges._encode_single_piece(w)
                got.append(ids)
            flat = np.array([i for ids in got for i in ids], np.uint32)
            out.append(pack(np.concatenate((np.array([len(x) for x in got], np.uint32), flat)),
                            len(got).to_bytes(8, "little")))
        return pa.table({"block": table.column("block"), "part": table.column("part"), "ids": pa.array(out, pa.binary())})

    # as many tasks as parts or more: they grow with the corpus, so that no task takes more than some parts or blocks
    word_ids = (map_batches(rows, list_words, "part int, block string, words binary").repartition(tasks, "part")
                .groupBy("part").applyInArrow(encode_part, "block string, part int, ids binary"))
    out_schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", ids array<int>"
    out_arrow = to_arrow_schema(StructType.fromDDL(out_schema))

    def assemble(words_of: pa.Table) -> pa.Table:
        packed = dict(zip(words_of.column("part").to_pylist(), words_of.column("ids").to_pylist()))
        sizes, flats = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for p in sorted(packed):
            numbers, tail = unpack(packed[p])
            n = int.from_bytes(tail, "little")
            sizes.append(numbers[:n].astype(np.int64))
            flats.append(numbers[n:].astype(np.int32))
        listed, flat = np.concatenate(sizes), np.concatenate(flats)
        order, part, docs_of = kept_order(folder, words_of.column("block")[0].as_py())
        by = np.argsort(part, kind="stable")        # the words as the parts list them
        size, begin = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
        size[by], begin[by] = listed, np.cumsum(listed) - listed
        ends = np.concatenate(([0], np.cumsum(size[order])))
        at = np.concatenate(([0], np.cumsum(docs_of.column("lengths").to_numpy())))
        tokens = np.empty(int(ends[-1]), np.int32)
        for a in range(0, len(order), DECODE_IDS):
            o = order[a:a + DECODE_IDS]
            lo, hi = int(ends[a]), int(ends[a + len(o)])
            tokens[lo:hi] = flat[np.repeat(begin[o] - ends[a:a + len(o)] + lo, size[o]) + np.arange(hi - lo)]
        return pa.Table.from_batches([record_batch({c: docs_of.column(c) for c in kept} | {
            "ids": pa.ListArray.from_arrays(pa.array(ends[at].astype(np.int32)), pa.array(tokens))}, out_arrow)])

    out = word_ids.repartition(tasks, "block").groupBy("block").applyInArrow(assemble, out_schema)
    return out.selectExpr(f"id `{id_col}`", "ids", *[f"c_{i} `{c}`" for i, c in enumerate(carry)])


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids; null ids are null."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    def start():
        by_id = sorted((i, b) for b, i in shared.value.items())
        data = np.frombuffer(b"".join(b for _, b in by_id), np.uint8)
        size = np.zeros(by_id[-1][0] + 1, np.int64)
        size[[i for i, _ in by_id]] = [len(b) for _, b in by_id]
        begin = np.cumsum(size) - size

        def one(ids: np.ndarray) -> bytes:
            out = []
            for a in range(0, len(ids), DECODE_IDS):
                part = ids[a:a + DECODE_IDS]
                n = size[part]
                if not n.all():
                    raise ValueError(f"ids that are not in the vocabulary: {part[n == 0][:5].tolist()}")
                out.append(data[np.repeat(begin[part] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes())
            return b"".join(out)

        def work(batch):
            column = batch.column(ids_col)
            values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            decoded = [None if null else one(values[a:b])
                       for a, b, null in zip(ends, ends[1:], column.is_null().to_pylist())]
            yield {n: batch.column(n) for n in batch.schema.names} | {out_col: decoded}
        return work
    return map_batches(encoded, start, ddl(encoded) + f", `{out_col}` binary")
