"""What the two text classifiers share: labelled samples, hashing and a full-batch optimiser."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
EMPTY = 0  # bucket of absent features; its weight stays 0


def bucket(feature: bytes) -> int:
    return crc32(feature) % (BUCKETS - 1) + 1


def labelled_sample(
    docs: DataFrame, labels: DataFrame, key: str, text: str, target: Column, per_class: int
) -> tuple[pa.Table, dict[int, int]]:
    """Texts of at most ``per_class`` labelled rows of every class, and the size of every class.

    ``target`` is an integer over the columns of ``labels``; null means
    unlabelled. Of several label rows of one key the largest class counts.
    Rows are chosen by a digest of the key, so the choice is repeatable and
    not tied to the order of keys; of several rows of one key the text with the
    smallest digest counts. What is broadcast and what comes to the driver is
    bounded by ``per_class`` rows for each class.
    """
    marked = labels.select(F.col(key).alias("_key"), target.cast("int").alias("class"))
    marked = marked.filter(F.col("_key").isNotNull() & F.col("class").isNotNull())
    marked = marked.groupBy("_key").agg(F.max("class").alias("class"))
    present = marked.join(docs.select(F.col(key).alias("_key")).distinct(), "_key", "left_semi")
    sizes = {r["class"]: r["n"] for r in present.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    narrow = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tables = []
    for value in sorted(sizes):
        order = F.md5(F.concat(F.lit("sample"), F.col("_key").cast("string")).cast("binary"))
        chosen = present.filter(F.col("class") == value).orderBy(order, "_key").limit(per_class)
        tables.append(chosen)
    if not tables:
        return pa.table({"text": pa.array([], pa.string()), "class": pa.array([], pa.int32())}), {}
    chosen = tables[0]
    for t in tables[1:]:
        chosen = chosen.unionByName(t)
    rows = narrow.join(F.broadcast(chosen), "_key")
    # One text of every key, whatever the number of its rows; tasks cut their own rows first.
    first = F.min(F.struct(F.md5(F.col("text").cast("binary")).alias("mark"), "text")).alias("first")
    one = rows.groupBy("_key", "class").agg(first)
    return one.orderBy("_key").select(F.col("first.text").alias("text"), "class").toArrow(), sizes


class Adam:
    """Full-batch steps with running moments."""

    def __init__(self, rate: float):
        self.rate, self.turn = rate, 0
        self.first: dict[str, np.ndarray] = {}
        self.second: dict[str, np.ndarray] = {}

    def step(self, values: dict[str, np.ndarray], gradient: dict[str, np.ndarray]) -> None:
        self.turn += 1
        for name, g in gradient.items():
            m = self.first.setdefault(name, np.zeros_like(g))
            v = self.second.setdefault(name, np.zeros_like(g))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            move = (m / (1 - 0.9**self.turn)) / (np.sqrt(v / (1 - 0.99**self.turn)) + 1e-8)
            values[name] -= self.rate * move


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)

