"""Joins to a table with unique keys that no frequent key can slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.session import materialize

HOT_KEYS = 1000


def hot_keys(counts: DataFrame, key: str, count: str, most: int = HOT_KEYS) -> DataFrame:
    """Keys with more than one in ``most`` of all counted rows, so fewer than ``most`` keys whatever the data."""
    total = counts.agg(F.sum(count)).scalar()
    return materialize(counts.filter(F.col(count) * most > total).select(key), "hot")


def join_hot(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Left join to a table with one row per key at most.

    Rows of hot keys stay where they are and meet a broadcast of at most
    :data:`HOT_KEYS` rows; what is left over has no frequent key and is
    shuffled as usual. A null key finds nothing.
    """
    hot = F.broadcast(hot)
    few = F.broadcast(right.join(hot, key, "left_semi"))
    at_home = left.join(hot, key, "left_semi").join(few, key, "left")
    return at_home.unionByName(left.join(hot, key, "left_anti").join(right, key, "left"))
