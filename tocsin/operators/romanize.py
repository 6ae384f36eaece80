"""Romanised copy of a message table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.functions.romanize import romanize_latin, romanize_malayalam


def romanize_table(
    df: DataFrame, mapping: Mapping[str, str] | None = None, col: str = "text", out: str = "romanized"
) -> DataFrame:
    """Add a romanised copy of ``col``: Malayalam by default, else a character mapping.

    A narrow projection; no character is ever a row of its own.
    """
    text = romanize_malayalam(F.col(col)) if mapping is None else romanize_latin(F.col(col), mapping)
    return df.withColumn(out, text)
