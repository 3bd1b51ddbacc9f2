"""String helpers with the reference database's semantics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def pg_concat(*cols: Column | str) -> Column:
    """PostgreSQL CONCAT: NULL arguments count as ''. (Spark's concat returns NULL.)"""
    parts = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols]
    return F.concat(*parts)


def js_template(*parts: Column | str) -> Column:
    """JS template string: literal text as str, values as Column; null prints 'null'."""
    out = []
    for p in parts:
        out.append(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")))
    return F.concat(*out)


def first_label(host: Column) -> Column:
    """First DNS label of a host name, trimmed and lower-cased (split('.')[0])."""
    return F.lower(F.trim(F.split_part(host, F.lit("."), F.lit(1))))


def conflict_labels(pairs: list[tuple[Column, str]]) -> Column:
    """', '-joined names of the conditions that hold (conflict text)."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs])), ", ")
