"""License scans: fuzzy search of short notices.

A notice is found with up to ``errors`` edits (insertions, deletions,
substitutions of characters).  It is cut into errors + 1 pieces; a text within
that many edits holds at least one piece unchanged (pigeonhole), so exact
searches for the pieces give every candidate place.  Only the window around a
candidate goes to the ``regex`` library, whose bounded-error matching decides
and reports the span and the number of edits.

Base phrases are searched exactly, as consecutive words.

Both searches run on the text's words joined by single spaces, so line breaks
and punctuation inside a notice do not count as edits.  Whole texts are read.

Defined results: null text is empty; a text without words has no places;
repeated rows are scanned each; an empty table gives no rows; extra columns
are ignored.  Overlapping places of one phrase all count.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame

from tillpoint.llm.common import map_batches, pick, texts, word_char_spans, words

# Phrases whose exact places are the base result.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Notices searched with edits, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "gnu lesser general public license version 3": "lgpl-3",
    "gnu affero general public license version 3": "agpl-3",
    "mozilla public license version 2 0": "mpl-2",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "creative commons attribution 4 0 international license": "cc-by",
}


def seeds(notice: bytes, errors: int) -> list[tuple[int, bytes]]:
    """(offset, piece) of errors + 1 pieces whose lengths differ by one at most."""
    cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def occurrences(data: bytes, what: bytes) -> list[int]:
    out, at = [], data.find(what)
    while at >= 0:
        out.append(at)
        at = data.find(what, at + 1)
    return out


def digits(data: bytes) -> bytes:
    return bytes(b for b in data if 0x30 <= b <= 0x39)


class Scanner:
    """Places of the base phrases and of the notices in one text."""

    def __init__(self, phrases: dict, notices: dict, errors: int):
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        self.errors = errors
        self.notices = []
        self.by_seed: dict[bytes, list[tuple[int, int]]] = {}
        for i, (n, label) in enumerate(notices.items()):
            raw = n.encode()
            self.notices.append((raw, label, regex.compile(b"(?be)(?:" + regex.escape(raw) + b"){e<=%d}" % errors)))
            for offset, piece in seeds(raw, errors):
                self.by_seed.setdefault(piece, []).append((i, offset))

    def base(self, norm: bytes) -> list[tuple[int, int, str]]:
        """(first word, words, label) of every place."""
        return [(norm.count(b" ", 0, at + 1) - 1, p.count(b" ") - 1, label)
                for p, label in self.phrases for at in occurrences(norm, p)]

    def fuzzy(self, norm: bytes) -> list[tuple[int, int, str, int, int]]:
        """(first word, words, label, edits, length of the notice) of the best match round each candidate.

        Digits of a notice (its version) must stand unchanged.  Of matches that overlap, the one with the
        fewest edits stays, then the longer notice.
        """
        near: dict[int, set[int]] = {}
        for piece, uses in self.by_seed.items():
            for at in occurrences(norm, piece):
                for i, offset in uses:
                    near.setdefault(i, set()).add(at - offset)
        found = set()
        for i, starts in near.items():
            raw, label, pattern = self.notices[i]
            for start in starts:
                m = pattern.search(norm, max(0, start - self.errors), min(len(norm), start + len(raw) + self.errors))
                if m and digits(m[0]) == digits(raw):
                    found.add((sum(m.fuzzy_counts), -len(raw), m.start(), m.end(), label))
        kept: list[tuple[int, int]] = []
        out = []
        for edits, size, a, b, label in sorted(found):
            if all(b <= x or a >= y for x, y in kept):
                kept.append((a, b))
                first = norm.count(b" ", 0, a + 1 + (norm[a:a + 1] == b" ")) - 1
                out.append((first, len(norm[a:b].split()), label, edits, -size))
        return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict | None = None,
         notices: dict | None = None, errors: int = 2) -> DataFrame:
    """One row per document: id, n_words, base places and fuzzy notices with words and character spans.

    ``base`` is array<struct<word, words, label, start, end>>; ``notices`` has the edits and a similarity
    1 - edits / notice length as well.  start and end are code points of the text, end exclusive.
    """
    args = (BASE_PHRASES if phrases is None else phrases, NOTICES if notices is None else notices, errors)

    def start():
        scanner = Scanner(*args)

        def work(batch):
            n_words, bases, fuzzies = [], [], []
            for text in texts(batch):
                split = words(text)
                norm = b" " + b" ".join(split) + b" "
                base, fuzzy = sorted(scanner.base(norm)), scanner.fuzzy(norm)
                first = np.array([x[0] for x in [*base, *fuzzy]], np.int64)
                last = np.minimum(first + [x[1] for x in [*base, *fuzzy]], len(split)) - 1 if len(first) else first
                begin, end = (word_char_spans(text, first)[0], word_char_spans(text, last)[1]) if len(first) else ([], [])
                n_words.append(len(split))
                bases.append([{"word": w, "words": n, "label": lb, "start": s, "end": e}
                              for (w, n, lb), s, e in zip(base, begin, end)])
                fuzzies.append([{"word": w, "words": n, "label": lb, "edits": k, "similarity": 1 - k / size,
                                 "start": s, "end": e}
                                for (w, n, lb, k, size), s, e in zip(fuzzy, begin[len(base):], end[len(base):])])
            yield {"id": batch.column("id"), "n_words": n_words, "base": bases, "notices": fuzzies}
        return work

    docs = pick(docs, id=id_col, text=text_col)
    found = map_batches(docs, start, f"""id {docs.dtypes[0][1]}, n_words long,
        base array<struct<word: long, words: long, label: string, start: long, end: long>>,
        notices array<struct<word: long, words: long, label: string, edits: int, similarity: double,
                             start: long, end: long>>""")
    return found.withColumnRenamed("id", id_col)
