"""Stable identifiers: a prefix and the head of the SHA-256 of a canonical JSON array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """Identifier of string or null parts, equal to hashing json.dumps(parts) without spaces."""
    text = F.to_json(F.array(*[p.cast("string") for p in parts]))
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(text, 256), 1, length))


def finding_id(rule: str, sheet: Column | str, location: Column, discriminator: Column | None = None) -> Column:
    return stable_id("finding", F.lit(rule), F.lit(sheet), location, discriminator if discriminator is not None else F.lit(None))
