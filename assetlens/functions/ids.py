"""Deterministic identity: kind:hex of the SHA-256 of the parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(part: Column | str | int) -> Column:
    return part if isinstance(part, Column) else F.lit(str(part))


def stable_id(kind: str, *parts: Column | str) -> Column:
    """kind + ':' + 32 hex digits over the parts, each ended by NUL. The kind itself is not hashed."""
    pieces: list[Column] = []
    for p in parts:
        pieces += [as_column(p).cast("string"), F.char(F.lit(0))]
    return F.concat(F.lit(kind.strip() + ":"), F.substring(F.sha2(F.concat(*pieces), 256), 1, 32))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the canonical JSON of the columns; only equality matters."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
