"""Spans of regular expressions in DataFrame functions.

Spark returns the matches of a pattern but not their places.  The text is
split at the pattern as well: the lengths of the pieces and of the matches add
up to the starts and ends, in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


# An array grows by being copied, and a slice copies its array first, so long arrays are put together from slices of slices.
SLICES = (4096, 64)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(items: Column, size: int) -> Column:
    """The array in slices of ``size`` entries, the last one shorter; an empty array has one empty slice."""
    return bound(items, lambda every: F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.size(every), F.lit(1)) - 1) / size).cast("int")),
        lambda i: F.slice(every, i * size + 1, F.lit(size))))


def fold(items: Column, none: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What each item puts out, joined, while a number ``at`` goes from 0 over the items.

    ``step`` takes ``at`` and an item and returns the next ``at`` and an array of the type of the empty array ``none``.
    """
    def one(s: Column, x: Column) -> Column:
        at, out = step(s["at"], x)
        return F.struct(at.alias("at"), F.concat(s["out"], out).alias("out"))

    def run(some: Column, at: Column, sizes: tuple[int, ...]) -> Column:
        if not sizes:
            return F.aggregate(some, F.struct(at.alias("at"), none.alias("out")), one)
        begin = F.struct(at.alias("at"), F.slice(F.array(none), 1, 0).alias("out"))

        def part(s: Column, x: Column) -> Column:
            return bound(run(x, s["at"], sizes[1:]), lambda d: F.struct(
                d["at"].alias("at"), F.concat(s["out"], F.array(d["out"])).alias("out")))
        return F.aggregate(slices(some, sizes[0]), begin, part,
                           lambda s: F.struct(s["at"].alias("at"), F.flatten(s["out"]).alias("out")))

    return run(items, F.lit(0), SLICES)["out"]


def match_spans(text: Column, pattern: str, kind: str, maybe: Column | None = None) -> Column:
    """array<struct<start, kind, end, found>> of the leftmost non-overlapping matches, none of them empty.

    ``maybe`` is a cheap test without which a text has no match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), found.alias("found"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["found"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"),
                               x["found"].alias("found")))
        # the piece behind the last match has no match to it
        return end, F.when(x["found"].isNotNull(), one).otherwise(_empty())

    spans = F.when(F.size(found) > 0, fold(zipped, _empty(), step)).otherwise(_empty())
    return spans if maybe is None else F.when(maybe, spans).otherwise(_empty())


def _empty() -> Column:
    return F.expr("cast(array() as array<struct<start: int, kind: string, end: int, found: string>>)")


def spans_text(spans: Column, order: list[str]) -> Column:
    """kind:start:end, comma-joined, by start and then by the place of the kind in ``order``."""
    kinds = F.array(*[F.lit(k) for k in order])
    sorted_spans = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(kinds, s["kind"]).alias("nth"), s["end"].alias("end"),
        s["kind"].alias("kind"))))
    return F.array_join(F.transform(sorted_spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
