"""Retry-stable identifiers.

A random UUID changes when a lost task runs again or a plan is evaluated
twice.  An id made from the table's name and the request's id is the same in
every run: the name-based UUID of RFC 9562 (version 5), in column expressions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_DNS, "tillpoint")


def name_uuid(table: str, *parts: Column) -> Column:
    """UUID (version 5) of ``table/part/part...`` in the library's namespace; a null part counts as empty."""
    name = F.concat_ws("/", F.lit(table), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    h = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE.hex)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
                    variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
