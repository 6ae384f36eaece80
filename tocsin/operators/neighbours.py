"""Neighbour graph of all vectors of a table, by descent over neighbours of neighbours.

Every row starts with neighbours from a few random cuts: rows on the same side
of random directions meet, in blocks of bounded size. Then, round by round,
the neighbours of a row are introduced to one another, because the neighbours
of a neighbour are likely to be near. While it runs a row keeps ``WIDTH`` times
the ``k`` asked for. Work per round is rows times that number squared, never rows times rows.

The graph is not exact; :func:`recall` measures it against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin.operators.embeddings import nearest
from tocsin.operators.tables import top_n_per_group
from tocsin.session import materialize

K = 10
WIDTH = 3  # times k neighbours are kept while the descent runs
ORDERS = 4
ROUNDS = 4
BLOCK = 64  # rows that meet at once
SEED = 42


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def _meet(k: int):
    """Rows of a group are compared with one another; each keeps its ``k`` best there.

    A row comes with the neighbours it has (``has``) and the similarity of the
    last of them (``least``). What it has already, or could not take its
    place among them, is not handed on.
    """

    def one(ids: np.ndarray, vectors: np.ndarray, least: np.ndarray, has: list[np.ndarray]):
        ids, first = np.unique(ids, return_index=True)
        unit = _unit(vectors[first])
        near = unit @ unit.T
        np.fill_diagonal(near, -np.inf)
        known = np.concatenate([np.empty(0, ids.dtype), *[has[i] for i in first]])
        at = np.minimum(np.searchsorted(ids, known), len(ids) - 1)
        here = ids[at] == known
        near[np.repeat(np.arange(len(ids)), [len(has[i]) for i in first])[here], at[here]] = -np.inf
        most = min(k, len(ids) - 1)
        best = np.argpartition(-near, most - 1, axis=1)[:, :most] if most else np.empty((len(ids), 0), int)
        close = np.take_along_axis(near, best, 1)
        # Products of one pair in two groups can differ in their last bits.
        new = (close > -np.inf) & (close >= least[first][:, None] - 1e-9)
        return np.repeat(ids, new.sum(axis=1)), ids[best][new], close[new]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column("members"):
                if len(members) < 2:
                    continue
                rows = members.values
                ids = rows.field("id").to_numpy()
                vectors = np.stack(rows.field("vector").to_numpy(zero_copy_only=False)).astype(np.float64)
                least = rows.field("least").to_numpy()
                a, b, near = one(ids, vectors, least, rows.field("has").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(near)], ["id", "other", "similarity"])

    return task


def _best(met: DataFrame, k: int) -> DataFrame:
    """The ``k`` most similar of all that a row has met; ties go to the smaller id."""
    # Products of one pair in two groups can differ in their last bits. Dealt by id, once for both steps.
    once = met.repartition("id").groupBy("id", "other").agg(F.max("similarity").alias("similarity"))
    return top_n_per_group(once, ["id"], [F.desc("similarity"), F.asc("other")], k).drop("rn")


def _compared(groups: DataFrame, k: int) -> DataFrame:
    """``groups`` has (key, block, id, vector, least, has); the rows of one key and block meet."""
    gathered = groups.groupBy("key", "block").agg(F.collect_list(F.struct("id", "vector", "least", "has")).alias("members"))
    return gathered.select("members").mapInArrow(_meet(k), "id long, other long, similarity double")


def _random_cuts(vectors: DataFrame, size: int, rows: int, k: int, orders: int) -> DataFrame:
    """First neighbours: cells of rows that lie together along random directions.

    A row's cell is the sign pattern of its products with random directions,
    enough of them to leave about ``BLOCK`` rows in a cell; larger cells are
    dealt into blocks by a hash of the id.
    """
    bits = max(1, int(np.ceil(np.log2(max(rows / BLOCK, 2)))))
    draw = np.random.default_rng(SEED)
    cells = []
    for _ in range(orders):
        directions = draw.standard_normal((bits, size)).tolist()
        sides = [
            F.when(_product(F.col("vector"), d) > 0, F.lit(1 << n)).otherwise(F.lit(0)).cast("long")
            for n, d in enumerate(directions)
        ]
        cells.append(sum(sides[1:], sides[0]))
    posted = vectors.select("id", "vector", F.posexplode(F.array(*cells)).alias("order", "cell"))
    posted = posted.select("id", "vector", F.xxhash64("order", "cell").alias("key"))
    alone = {"least": F.lit(float("-inf")), "has": F.array().cast("array<bigint>")}
    return _compared(_blocks(posted).withColumns(alone), k)


def _product(vector, direction: list[float]):
    pairs = F.zip_with(vector, F.array(*map(F.lit, direction)), lambda a, b: a * b)
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def _blocks(posted: DataFrame) -> DataFrame:
    """Keys with many rows are dealt into blocks of about ``BLOCK``, so no group grows with the table."""
    sizes = posted.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    large = sizes.filter("blocks > 1")
    dealt = posted.join(large, "key", "left")
    return dealt.select("key", "id", "vector", F.pmod(F.xxhash64("id", "key"), F.coalesce("blocks", F.lit(1))).alias("block"))


def _introduce(graph: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Neighbours of a row, in either direction, meet at that row.

    A row that very many others name as their neighbour holds several groups;
    its own neighbours are in each of them.
    """
    named = graph.select(F.col("other").alias("key"), "id")
    own = graph.select(F.col("id").alias("key"), F.col("other").alias("id"))
    counts = named.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("long").alias("blocks"))
    counts = materialize(counts, "named")
    dealt = named.join(counts, "key").select("key", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).alias("block"), "id")
    spread = own.join(counts, "key", "left").select(
        "key", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"), "id"
    )
    held = graph.groupBy("id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("similarity")).otherwise(F.lit(float("-inf"))).alias("least"),
        F.collect_list("other").alias("has"),
    )
    rows = vectors.join(held, "id", "left").withColumns({
        "least": F.coalesce("least", F.lit(float("-inf"))), "has": F.coalesce("has", F.array().cast("array<bigint>")),
    })
    groups = dealt.unionByName(spread).distinct().join(rows, "id")
    return _compared(groups, k)


def neighbour_graph(
    df: DataFrame,
    k: int = K,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    rounds: int = ROUNDS,
    orders: int = ORDERS,
    width: int = WIDTH,
) -> DataFrame:
    """(id, other, similarity): for every vector the ``k`` most similar ones found.

    Ids are integers, each on one row. Vectors that are null, empty, or hold a
    null are left out; zero vectors have similarity 0 to all. Vectors have one
    size. An empty table gives an empty graph. The result is the same on every run.
    """
    usable = (F.size(vec_col) > 0) & ~F.exists(vec_col, lambda x: x.isNull())
    vectors = df.filter(F.col(id_col).isNotNull() & usable)
    # Single precision stays as it is: what travels with every meeting is half as large.
    stored = F.col(vec_col) if df.schema[vec_col].dataType == T.ArrayType(T.FloatType()) else F.col(vec_col).cast("array<double>")
    vectors = materialize(vectors.select(F.col(id_col).cast("long").alias("id"), stored.alias("vector")), "vectors")
    shape = vectors.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("vector")).alias("size")).first()
    wide = width * k
    met = _random_cuts(vectors, shape["size"] or 1, shape["rows"], wide, orders)
    graph = materialize(_best(met, wide), "graph")
    for _ in range(rounds):
        met = _introduce(graph, vectors, wide).unionByName(graph)
        graph = materialize(_best(met, wide), "graph")
    return _best(graph, k)


def recall(graph: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours (id, other, similarity) for which the graph has one as near.

    Counted by similarity to nine decimals, so that either of two equally near rows will do:
    a row of the graph counts if it is no farther than the farthest exact neighbour of its id.
    """
    reach = exact.groupBy("id").agg(F.min("similarity").alias("least"), F.count(F.lit(1)).alias("wanted"))
    hits = (
        graph.join(reach, "id", "right")
        .groupBy("id", "wanted")
        .agg(F.count_if(F.col("similarity") >= F.col("least") - 1e-9).alias("found"))
    )
    return hits.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("wanted").alias("n_wanted"),
        (F.sum(F.least("found", "wanted")) / F.sum("wanted")).alias("recall"),
    )


def exact_neighbours(df: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, other, similarity) of the ``k`` most similar other rows of each query row, for measuring on a sample."""
    asked = queries.select(F.col(id_col).alias("id"), F.col(vec_col).alias("query_vec"))
    rows = df.select(F.col(id_col).alias("other"), F.col(vec_col).alias("vector"))
    found = nearest(rows, asked, k + 1, id_col="other", vec_col="vector", query_id="id")
    others = found.filter(F.col("id") != F.col("other")).drop("rn")
    return top_n_per_group(others, ["id"], [F.desc("similarity"), F.asc("other")], k).drop("rn")
