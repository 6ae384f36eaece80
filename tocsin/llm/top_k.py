"""Exact inner-product search over buckets of vectors of similar length.

Vectors are rounded down to integers, sorted by length and cut into buckets. A
product is |q| |v| cos(q, v), so with the score a query must beat, each bucket
turns into a cosine threshold: the beaten score over |q| and the bucket's
largest length. Above 1 the bucket is skipped. Otherwise one of two prunings
is chosen per query and bucket: by length, where the bucket's lengths alone
decide (all vectors from a sorted position on are too short), or by
coordinate, where the threshold is high enough for single coordinates to
decide: a vector with cosine t to q has its i-th direction coordinate between
q_i t -/+ sqrt((1 - t^2)(1 - q_i^2)). Survivors are verified by their integer product.

The score to beat starts from the bucket of longest vectors, which every query
sees first, and rises from bucket to bucket. Queries travel in blocks to
groups of buckets; nothing of the size of queries times rows is stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tocsin.llm.arrow import Batches, groups
from tocsin.session import materialize

SCALE = 256
K = 5
BUCKET = 2048  # vectors in a bucket
QUERY_BLOCK = 256
GROUP = 16  # buckets that one task holds at once
PART = 16  # query blocks that visit them there
FOCUS = 4  # coordinates looked at, those where the query is largest
COORDINATE_FROM = 0.7  # local cosine threshold from which coordinates prune more than lengths
SLACK = 1e-9
EXACT = 2.0**53  # up to here products of doubles are exact integers


def usable(vector: Column) -> Column:
    """Not null, not empty, every component a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _blocks(rows: int):
    """Consecutive rows as one row, packed and longest first; dimensions are never mixed."""

    def pack(ids: list, numbers: list) -> tuple:
        matrix = np.array(numbers, "<i8")
        length = np.linalg.norm(matrix.astype(np.float64), axis=1)
        order = np.argsort(-length, kind="stable")
        packed = np.array(ids, "<i8")[order].tobytes(), matrix[order].tobytes()
        return *packed, len(ids), matrix.shape[1], float(length.max())

    kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.float64())

    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        ids, numbers = [], []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(pack(ids, numbers), kinds)], NAMES)

        for batch in batches:
            for i, x in zip(batch.column("id").to_pylist(), batch.column("numbers").to_pylist()):
                if ids and (len(ids) == rows or len(x) != len(numbers[0])):
                    yield block()
                    ids, numbers = [], []
                ids.append(i)
                numbers.append(x)
        if ids:
            yield block()

    return task


NAMES = ["ids", "numbers", "n", "dims", "longest"]
BLOCK = "ids binary, numbers binary, n int, dims int, longest double"


class Bucket:
    """Vectors sorted by length, with their directions."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.whole = np.frombuffer(row["numbers"], "<i8").reshape(row["n"], row["dims"])
        self.dims, self.longest = row["dims"], row["longest"]
        self.real = self.whole.astype(np.float64)
        self.largest = float(np.abs(self.real).max())
        self.length = np.linalg.norm(self.real, axis=1)
        self.direction = self.real / np.where(self.length > 0, self.length, 1)[:, None]
        self.by_coordinate = np.ascontiguousarray(self.direction.T)

    def products(self, query: "Bucket", at: int, rows: np.ndarray | slice) -> np.ndarray:
        if self.largest * query.largest * self.dims < EXACT:
            return (self.real[rows] @ query.real[at]).astype(np.int64)
        exact = self.whole[rows].astype(object) @ query.whole[at].astype(object)
        return np.array(exact, np.int64)

    def survivors(self, query: "Bucket", at: int, beat: float) -> np.ndarray | slice:
        """Positions of the vectors that can reach the score ``beat`` with a query."""
        norm = query.length[at]
        if beat <= 0 or norm == 0:
            return slice(None)
        needed = beat / norm * (1 - SLACK)  # product <= |q| |v|
        if needed > self.longest:
            return slice(0, 0)
        least = needed / self.longest
        if least < COORDINATE_FROM:
            return slice(0, int(np.searchsorted(-self.length, -needed, side="right")))
        q = query.direction[at]
        focus = np.argsort(-np.abs(q))[:FOCUS]
        spread = np.sqrt((1 - least * least) * np.maximum(0, 1 - q[focus] ** 2)) + SLACK
        # where the cone around q holds the pole of a coordinate, that end is open
        high = np.where(q[focus] >= least, 2.0, q[focus] * least + spread)
        low = np.where(-q[focus] >= least, -2.0, q[focus] * least - spread)
        rows = np.arange(len(self.ids))
        for f, a, b in zip(focus, low, high):
            column = self.by_coordinate[f][rows]
            rows = rows[(column >= a) & (column <= b)]
        return rows


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best: highest score, then smallest id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= cut)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], -scores[kept]))][:k]


class Search:
    """The best so far of one block of queries, bucket after bucket."""

    def __init__(self, query: Bucket, k: int, beat: np.ndarray):
        self.query, self.k = query, k
        self.beat = beat.astype(np.float64).copy()
        self.scores = [np.empty(0, np.int64) for _ in query.ids]
        self.found = [np.empty(0, np.int64) for _ in query.ids]

    def visit(self, bucket: Bucket) -> None:
        if bucket.dims != self.query.dims:
            return
        for i, own in enumerate(self.query.ids):
            rows = bucket.survivors(self.query, i, self.beat[i])
            ids = bucket.ids[rows]
            if not len(ids):
                continue
            scores = bucket.products(self.query, i, rows)
            good = (scores >= self.beat[i]) & (ids != own)
            if not good.any():
                continue
            scores = np.concatenate([self.scores[i], scores[good]])
            ids = np.concatenate([self.found[i], ids[good]])
            top = best(scores, ids, self.k)
            self.scores[i], self.found[i] = scores[top], ids[top]
            if len(top) == self.k:
                self.beat[i] = max(self.beat[i], float(scores[top[-1]]))


def _first_scores(first, k: int):
    """Add the k-th best score of every query of a block over the bucket of longest vectors."""

    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        bucket = Bucket(first.value) if first.value else None
        for batch in batches:
            beats = []
            for row in batch.to_pylist():
                search = Search(Bucket(row), k, np.full(row["n"], -np.inf))
                if bucket is not None:
                    search.visit(bucket)
                beats.append(search.beat.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(beats, pa.binary())], [*batch.schema.names, "beat"])

    return task


def _search(k: int):
    """Per group its query blocks over its buckets, longest first; each query's k best of the group."""

    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        for table, offsets in groups(batches, "grp", "part"):
            for start, end in zip(offsets[:-1], offsets[1:]):
                rows = table.slice(start, end - start).to_pylist()
                buckets = sorted((Bucket(r) for r in rows if r["beat"] is None), key=lambda b: -b.longest)
                for row in rows:
                    if row["beat"] is None:
                        continue
                    search = Search(Bucket(row), k, np.frombuffer(row["beat"], np.float64))
                    for bucket in buckets:
                        search.visit(bucket)
                    counts = [len(x) for x in search.found]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(search.query.ids, counts)),
                            pa.array(np.concatenate(search.found)),
                            pa.array(np.concatenate(search.scores)),
                        ],
                        ["query_id", "vec_id", "score"],
                    )

    return task


def top_k(
    df: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    scale: int = SCALE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of every query, all if there are fewer.

    Components are ``floor(scale * x)``, the score is their integer product,
    ties go to the smaller id. A row is no candidate of a query with its own
    id, and a repeated query id is searched once, with its smallest vector;
    repeated candidates stay. Null or empty vectors, those with a null or
    non-finite component and rows with a null key take no part; vectors of
    different dimensions do not meet. Scores must fit 64 bits. Other columns
    are not read. No query or no candidate gives an empty table.
    """
    spark = df.sparkSession
    rows = df.filter(usable(F.col(vector)) & F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), integers(F.col(vector), scale).alias("numbers"), is_query.alias("asks")
    )
    square = F.aggregate("numbers", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = rows.select("id", "numbers", F.size("numbers").alias("dims"), square.alias("square"))
    buckets = materialize(
        sized.repartitionByRange(n, "dims", F.col("square").desc(), "id")
        .sortWithinPartitions("dims", F.col("square").desc(), "id")
        .select("id", "numbers")
        .mapInArrow(_blocks(BUCKET), BLOCK)
        .withColumn("nth", F.monotonically_increasing_id()),
        "buckets",
    )
    asked = rows.filter("asks").groupBy("id").agg(F.min("numbers").alias("numbers"))
    blocks = asked.withColumn("dims", F.size("numbers")).repartition(n, "dims", F.pmod(F.xxhash64("id"), F.lit(n)))
    blocks = materialize(
        blocks.sortWithinPartitions("dims")
        .select("id", "numbers")
        .mapInArrow(_blocks(QUERY_BLOCK), BLOCK)
        .withColumn("nth", F.monotonically_increasing_id()),
        "query-blocks",
    )
    first = buckets.orderBy(F.col("longest").desc(), "nth").first()  # one bucket
    first = spark.sparkContext.broadcast(first.asDict() if first else None)
    asking = blocks.mapInArrow(_first_scores(first, k), f"{BLOCK}, nth long, beat binary")

    # Groups of buckets times parts of the query blocks: a grid whose cells are tasks' work.
    n_groups = max(1, min(buckets.count(), max(n, -(-buckets.count() // GROUP))))
    n_parts = max(1, -(-blocks.count() // PART))
    spread = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    cells = (
        buckets.withColumn("beat", F.lit(None).cast("binary"))
        .withColumn("grp", spread("nth", n_groups))
        .withColumn("part", every(n_parts))
        .unionByName(asking.withColumn("grp", every(n_groups)).withColumn("part", spread("nth", n_parts)))
    )
    found = (
        cells.repartition(n, "grp", "part")
        .sortWithinPartitions("grp", "part")
        .mapInArrow(_search(k), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
