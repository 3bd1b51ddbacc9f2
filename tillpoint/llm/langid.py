"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built from a sample of labelled text.
A text is parsed against an automaton into the longest phrases that occur in
the sample (a character that the sample lacks is a phrase of its own); few
phrases mean that the sample predicts the text well.  The cost in bits per
character, phrases * log2(sample length) / characters, makes samples of
unequal length comparable (Ziv and Merhav, "A measure of relative entropy
between individual sequences").  The language of the lowest cost wins, ties go
to the label that sorts first.

The parse steps through many pieces of text at once: whole texts are cut into
pieces of ``PIECE`` characters, and one step moves all pieces of a batch one
character ahead in all automata.  A phrase ends at the end of its piece.

Fitting takes a bounded sample of whole texts: per label the distinct texts of
at most ``longest`` characters with the smallest hashes, ``rows`` of them and
``chars`` characters together at most; a label that has longer texts only is
learnt from its shortest one.  The automata are as large as that sample,
labels x chars, and are broadcast.

Defined results: null text and text without a letter are ``und`` with score 0;
without any labelled text everything is ``und``; repeated rows are predicted
each; labels that are null take no part; an empty table gives no rows; extra
columns are ignored, or handed on if named in ``carry``.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tillpoint.llm.common import ddl, map_batches, pick, texts

SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_LONGEST = 48, 38_400, 4_800
SAMPLE_PARTS = 64       # of a label, whose smallest hashes are found side by side
PIECE = 512
PART_CHARS = 4_000_000         # characters parsed at a time
UNKNOWN = "und"
GAP = 1             # symbol of a run of characters that aren't letters; 0 is a letter that no sample has


def is_letter(c: str) -> bool:
    return unicodedata.category(c)[0] == "L"


def fold(c: str) -> str:
    low = c.lower()
    return low if len(low) == 1 else c


def transitions(symbols: list[int]) -> list[dict[int, int]]:
    """Suffix automaton: the transitions of each state; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """The same as a full table (states x width) for a small alphabet; entry 0 is no transition."""
    step = transitions(symbols)
    table = np.zeros((len(step), width), np.int32)
    for s, moves in enumerate(step):
        for c, t in moves.items():
            table[s, c] = t
    return table


class Sparse:
    """Targets by key (row offset + symbol), 0 where there is none: open addressing, at most half full.

    It is as large as the number of transitions, however many symbols there are.
    """

    def __init__(self, keys: np.ndarray, targets: np.ndarray):
        self.bits = max(1, int(2 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.int64)         # no key is 0
        self.targets = np.zeros(1 << self.bits, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.targets[slot[put]] = keys[put], targets[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, targets, slot = keys[left], targets[left], (slot[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        flat = np.ascontiguousarray(keys, np.int64).ravel()
        slot = self._slot(flat)
        held = self.keys[slot]
        out = np.where(held == flat, self.targets[slot], 0)
        on = np.flatnonzero((held != flat) & (held != 0))
        while len(on):
            slot_on = slot[on] = (slot[on] + 1) & (len(self.keys) - 1)
            held = self.keys[slot_on]
            hit = held == flat[on]
            out[on[hit]] = self.targets[slot_on[hit]]
            on = on[~hit & (held != 0)]
        return out.reshape(keys.shape)


class Model:
    """Automata of all labels in one table of row offsets; offset 0 is a row without transitions."""

    def __init__(self, samples: dict[str, list[str]]):
        self.labels = sorted(samples)
        letters = sorted({fold(c) for ts in samples.values() for t in ts for c in t if is_letter(c)})
        self.symbol = symbol = {c: i + 2 for i, c in enumerate(letters)}
        self.width = len(symbol) + 2
        self.bits, self.roots = [], []
        keys, targets, at = [], [], 1
        for label in self.labels:
            seq: list[int] = []
            for t in samples[label]:
                for c in t + " ":
                    s = symbol[fold(c)] if is_letter(c) else GAP
                    if s != GAP or (seq and seq[-1] != GAP):
                        seq.append(s)
            step = transitions(seq)
            for n, moves in enumerate(step, at):
                keys += [n * self.width + c for c in moves]
                targets += [(at + t) * self.width for t in moves.values()]
            self.roots.append(at * self.width)
            self.bits.append(np.log2(max(2, len(seq))))
            at += len(step)
        self.table = Sparse(np.array(keys, np.int64), np.array(targets, np.int64))

    def code_table(self) -> np.ndarray:
        """Symbol of each code point; 0 for letters without one."""
        out = np.full(0x110000, GAP, np.min_scalar_type(self.width))
        for i in range(0x110000):
            c = chr(i)
            if is_letter(c):
                out[i] = self.symbol.get(fold(c), 0)
        return out


def phrases(model: Model, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Phrases (labels x pieces) of the pieces of a symbol sequence; pieces sorted by falling length."""
    roots = np.array(model.roots, np.int64)[:, None]
    state = np.broadcast_to(roots, (len(roots), len(starts))).copy()
    count = np.zeros(state.shape, np.int32)
    live = len(starts)
    for t in range(int(lengths.max(initial=0))):
        while live and lengths[live - 1] <= t:
            live -= 1
        s = symbols[starts[:live] + t]
        now = state[:, :live]
        ahead = model.table[now + s]
        row, col = np.nonzero(ahead == 0)
        root = roots[row, 0]
        fresh = model.table[root + s[col]]
        count[row, col] += (now[row, col] != root).astype(np.int32) + (fresh == 0)
        ahead[row, col] = np.where(fresh == 0, root, fresh)
        state[:, :live] = ahead
    return count + (state != roots)


def _predict(model: Model):
    codes = model.code_table()
    labels, bits = np.array(model.labels + [UNKNOWN], object), np.array(model.bits)

    def costs(docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bits per character (labels x texts), which texts have a letter, and their characters."""
        data = np.frombuffer("\n".join([*docs, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = codes[data]
        ends = np.cumsum([len(d) + 1 for d in docs])
        keep = np.append(True, (symbols[1:] != GAP) | (symbols[:-1] != GAP))
        keep[ends[:-1]] = True                          # a document starts afresh
        kept = np.concatenate((np.zeros(1, np.int32), np.cumsum(keep, dtype=np.int32)))
        symbols = symbols[keep]
        first = kept[np.concatenate(([0], ends[:-1]))]
        size = kept[ends] - first
        letters = np.concatenate((np.zeros(1, np.int32), np.cumsum(symbols != GAP, dtype=np.int32)))
        has = letters[first + size] > letters[first]
        pieces = np.where(has, -(-size // PIECE), 0)
        doc = np.repeat(np.arange(len(docs)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = first[doc] + nth * PIECE
        lengths = np.minimum(PIECE, size[doc] - nth * PIECE)
        order = np.argsort(-lengths, kind="stable")
        got = phrases(model, symbols, starts[order], lengths[order])
        total = np.array([np.bincount(doc[order], weights=n, minlength=len(docs)) for n in got])
        return total.reshape(len(bits), len(docs)) * bits[:, None] / np.maximum(size, 1), has, size

    def parts(docs: list[str]):
        at = 0
        while at < len(docs):
            end, n = at, 0
            while end < len(docs) and (end == at or n + len(docs[end]) <= PART_CHARS):
                n += len(docs[end])
                end += 1
            yield docs[at:end]
            at = end

    def work(batch):
        found, lang, score, lowest, mean = texts(batch), [], [], [], []
        for docs in parts(found):
            cost, has, size = costs(docs)
            if not len(bits):
                best, low, sure, has = np.zeros(len(docs), int), np.zeros(len(docs)), np.zeros(len(docs)), has & False
                many = np.ones(len(docs))
            else:
                by = np.sort(cost, axis=0)
                best, low = np.argmin(cost, axis=0), by[0]
                sure = 1 - low / np.maximum(by[1], 1e-300) if len(bits) > 1 else np.ones(len(docs))
                many = np.rint(low * size / bits[best])
            lang += labels[np.where(has, best, len(bits))].tolist()
            score += np.where(has, np.clip(sure, 0, 1), 0.0).tolist()
            lowest += np.where(has, low, 0.0).tolist()
            # the end of a text cuts its last phrase
            mean += np.where(has, size / np.maximum(many - 1, 1), 0.0).tolist()
        yield {n: batch.column(n) for n in batch.schema.names} | {
            "_lang": lang, "_score": score, "_cost": lowest, "_mean": mean}
    return work


def fit(docs: DataFrame, train: Column | None = None, text_col: str = "text", lang_col: str = "lang",
        rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, longest: int = SAMPLE_LONGEST) -> Model:
    """Automata from whole labelled texts (rows where ``train`` holds); at most ``rows`` and ``chars`` a label."""
    labelled = docs if train is None else docs.filter(train)
    own = pick(labelled, lang=lang_col, text=text_col).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    # texts that are too long come last, by length; no more than one of them is taken
    size = F.length("text")
    found = own.select("lang", "h", F.when(size > longest, size).otherwise(0).alias("over")).distinct()
    for near in (["lang", F.pmod("h", F.lit(SAMPLE_PARTS))], ["lang"]):
        nth = F.row_number().over(Window.partitionBy(*near).orderBy("over", "h"))
        found = found.withColumn("nth", nth).filter((F.col("nth") <= rows) & ((F.col("over") == 0) | (F.col("nth") == 1)))
    sample = (own.join(F.broadcast(found.select("lang", "h")), ["lang", "h"]).groupBy("lang", "h")
              .agg(F.min("text").alias("text")).collect())          # labels x rows x longest
    by: dict[str, list[str]] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["h"])):
        taken = by.setdefault(r["lang"], [])
        if not taken or sum(map(len, taken)) + len(r["text"]) <= chars:
            taken.append(r["text"])
    return Model(by)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
            carry: list[str] = ()) -> DataFrame:
    """(id, lang_pred, score, cost, phrase_chars) and the ``carry`` columns.

    score: 1 - lowest cost / second lowest cost.  cost: bits per character of the winner.  phrase_chars: characters
    (a run of others than letters is one) for each phrase of the winner but the last; near 1 where no sample has the
    text's letters, and 0 without a language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = pick(docs, **{"id": id_col, "text": text_col} | {f"c_{i}": c for i, c in enumerate(carry)})
    out = map_batches(own, lambda: _predict(shared.value), ddl(own) + ", _lang string, _score double, _cost double, _mean double")
    return out.select(F.col("id").alias(id_col), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"),
                      F.col("_cost").alias("cost"), F.col("_mean").alias("phrase_chars"), *[F.col(f"c_{i}").alias(c) for i, c in enumerate(carry)])
