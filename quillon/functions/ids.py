"""Content-addressed ids and keys, as columns. Formulas and separators are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(*parts: Column, sep: str = "|") -> Column:
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])


def event_id(ws: Column, processor: Column, txn: Column, kind: Column) -> Column:
    return F.sha2(_joined(ws, processor, txn, kind), 256)


def processor_id(ws: Column, processor: Column, kind: Column, txn: Column) -> Column:
    return F.sha2(_joined(ws, processor, F.lower(kind), txn), 256)


def accounting_id(ws: Column, source: Column, object_type: Column, object_id: Column) -> Column:
    return F.sha2(_joined(ws, source, F.lower(object_type), object_id, F.lit("observed")), 256)


def idempotency_key(operation: str, ws: Column, processor: Column, external: Column) -> Column:
    return _joined(F.lit(operation), F.lit("ws"), ws, processor, external, sep=":")


def ids_hash(ids: Column) -> Column:
    """The hash of an array of ids as a JSON list, sorted, with ", " between."""
    return F.sha2(F.when(F.size(ids) == 0, "[]").otherwise(F.concat(F.lit('["'), F.array_join(F.array_sort(ids), '", "'), F.lit('"]'))), 256)


def lock_number(ws: Column) -> Column:
    """The first 64 bits of the hash as a signed number."""
    return F.conv(F.substring(F.sha2(ws, 256), 1, 16), 16, -10).cast("long")
