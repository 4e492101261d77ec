"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(row: Column) -> Column:
    """Hash of a whole source row written as text."""
    return F.sha2(row, 256)


def row_id(jurisdiction: Column, source_record_id: Column, row_digest: Column) -> Column:
    """Id of a payment line: the same source row gives the same id on every run.

    A source record id may cover several lines, so the hash of the whole row is part of it.
    """
    return F.concat_ws(":", jurisdiction, source_record_id, row_digest)


def slug(c: Column) -> Column:
    """Lowercase words joined by dashes; ``unknown`` when there are none."""
    dashed = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    trimmed = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("unknown"))


def _hash60(c: Column, start: int) -> Column:
    """Fifteen hex digits of an MD5 as a non-negative long."""
    return F.conv(F.substring(F.md5(c), start, 15), 16, 10).cast("bigint")


def set_fingerprint(member: Column) -> Column:
    """Aggregate: fingerprint of a set of distinct strings, in any order.

    Built from an exclusive-or and a sum, so it combines on the map side; the members of
    a large set are never brought together.
    """
    parts = F.concat_ws(
        "|",
        F.count(member).cast("string"),
        F.bit_xor(_hash60(member, 1)).cast("string"),
        F.sum(_hash60(member, 16).cast("decimal(20,0)")).cast("string"),
    )
    return F.substring(F.sha2(parts, 256), 1, 12)


def source_link(template: str | None, record_id: Column) -> Column:
    """The template with its first ``{id}`` replaced; a missing id becomes empty."""
    if template is None:
        return F.lit(None).cast("string")
    head, mark, tail = template.partition("{id}")
    if not mark:
        return F.lit(template)
    return F.concat(F.lit(head), F.coalesce(record_id, F.lit("")), F.lit(tail))


def transaction_event_key(kind: Column, jurisdiction: Column, watch: Column, txn: Column) -> Column:
    return F.concat_ws(":", kind, jurisdiction, watch, txn)


def spike_event_key(jurisdiction: Column, scope: Column, month: Column) -> Column:
    return F.concat_ws(":", F.lit("spending-spike"), jurisdiction, scope, month)
