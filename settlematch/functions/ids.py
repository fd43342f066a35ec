"""Content-derived identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def match_id(link_type: Column, payment_id: Column, counterparts: Column, rule: Column) -> Column:
    return F.concat(F.lit("m_"), F.substring(F.sha1(F.concat_ws("|", link_type, payment_id, F.array_join(F.sort_array(counterparts), ","), rule).cast("binary")), 1, 12))


def exception_id(subject_type: Column, subject_id: Column, link_type: Column, reason: Column) -> Column:
    """Not a key: two open legs of one payment share it. A null link counts as the word None."""
    return F.concat(F.lit("x_"), F.substring(F.sha1(F.concat_ws("|", subject_type, subject_id, F.coalesce(link_type, F.lit("None")), reason).cast("binary")), 1, 12))


def content_key(*parts: Column) -> Column:
    """First 20 hex digits of the SHA-256 of the parts joined by NUL."""
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit("\x00"), p)
    return F.substring(F.sha2(joined.cast("binary"), 256), 1, 20)
