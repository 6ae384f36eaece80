"""Deterministic keys that replace seeded random generators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed: int | str | Column, *cols: str | Column) -> Column:
    """32 hex characters that depend only on the seed and the row's own key.

    The order they give is the same under any partitioning, unlike ``rand``.
    """
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", head, *[F.col(c) if isinstance(c, str) else c for c in cols]))


def key_to_long(key: Column) -> Column:
    """First 32 bits of a hex key as a non-negative integer."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
