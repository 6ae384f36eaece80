"""Near-duplicate vectors through spherical-cap filters from a random product code.

A filter is a direction: one random unit vector per half of the (rotated)
coordinates, so ``n`` code words per half make ``n * n`` filters, and a
vector's products with all of them are sums of two short lists. A vector is
stored at its best filter and looks for partners at every filter whose product
exceeds a threshold.

The threshold makes the search exact. If x is stored at c with product s, the
angle between x and c is acos(s); a vector y within the angle t of x is then
within acos(s) + t of c. A pair needs to be found from one end only, so y
looks for partners that are stored no worse than itself: it decodes the
filters with product at least cos(acos(max(s_y, worst in c)) + t). Pairs that
meet at a filter are verified by the cosine of the original numbers in double
precision.

Vectors that are equal number by number are one entry with a multiplicity.
A filter that holds many entries is cut into salted parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.arrow import Batches, forest, groups
from tocsin.llm.components import components
from tocsin.session import materialize

MIN_COSINE = 0.98
SEED = 20
PER_FILTER = 1024  # entries aimed at per filter; more filters mean more copies on the way, fewer more products
MAX_WORDS = 256  # per half; the table of filters has at most the square of it per dimension
PART = 2048  # entries of a filter compared in one task with one part of those that look there
MAX_CUTS = 64  # cuts of the looking side
SLACK = 1e-9
CHUNK = 512


@lru_cache(maxsize=8)
def code(dims: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Code words of both halves, mapped back to the original coordinates and scaled so that a sum is a cosine."""
    draw = np.random.default_rng([SEED, dims, words])
    turn = np.linalg.qr(draw.standard_normal((dims, dims)))[0]
    halves = [h for h in np.array_split(np.arange(dims), 2) if len(h)]
    out = []
    for half in halves:
        c = draw.standard_normal((words, len(half)))
        c /= np.linalg.norm(c, axis=1, keepdims=True)
        out.append(c @ turn[half] / np.sqrt(len(halves)))
    return out[0], out[1] if len(out) > 1 else np.zeros((1, dims))


def _unit(rows: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), dtype).astype(np.float64).reshape(len(rows), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _entries(dtype: str):
    """(id, label, dims, digest, vector) of the vectors that can be compared; others have a null digest."""

    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, vectors, dims = [], [], []
            for numbers, label in zip(batch.column("vector"), batch.column("label").is_valid().to_pylist()):
                x = None
                if label and numbers.is_valid and len(numbers) and not numbers.values.null_count:
                    x = numbers.values.to_numpy(zero_copy_only=False).astype(dtype) + np.array(0, dtype)  # no -0
                    norm = np.linalg.norm(x.astype(np.float64))
                    x = x if np.isfinite(norm) and norm > 0 else None
                digests.append(None if x is None else blake2b(x.tobytes(), digest_size=16).digest())
                vectors.append(None if x is None else x.tobytes())
                dims.append(None if x is None else len(x))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("label"),
                    pa.array(dims, pa.int32()),
                    pa.array(digests, pa.binary()),
                    pa.array(vectors, pa.binary()),
                ],
                ["id", "label", "dims", "digest", "vector"],
            )

    return task


def _by_dims(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dims").to_numpy(zero_copy_only=False)
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield int(d), batch if len(at) == len(dims) else batch.take(pa.array(at))


def _store(words: int, dtype: str):
    """Add the best filter of every entry and the product with it."""

    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, part in _by_dims(batch) if batch.num_rows else ():
                x = _unit(part.column("vector").to_pylist(), dtype)
                first, second = code(dims, words)
                a, b = x @ first.T, x @ second.T
                filters = a.argmax(axis=1) * words + b.argmax(axis=1)
                best = a.max(axis=1) + b.max(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(filters.astype(np.int32)), pa.array(best)],
                    [*part.schema.names, "filter", "best"],
                )

    return task


def threshold(product: np.ndarray, min_cosine: float) -> np.ndarray:
    """Least product of a vector with a filter at which a partner within the angle is stored with ``product``."""
    s = np.clip(product, -1, 1)
    turned = s * min_cosine - np.sqrt(1 - s * s) * np.sqrt(1 - min_cosine * min_cosine)
    return np.where(s <= -min_cosine, -1.0, turned) - SLACK


def _cells(filters: np.ndarray, node: np.ndarray, fixed: np.ndarray, every: np.ndarray, swap: bool):
    """(row, cell) of the grid cells of filters: one index is drawn from the node, the other takes all values.

    A filter's entries are cut into parts, those that look there into cuts;
    the number of a cell holds part, filter and cut.
    """
    times = every[filters]
    row = np.repeat(np.arange(len(filters)), times)
    other = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    own = (node % fixed[filters])[row]
    part, cut = (other, own) if swap else (own, other)
    return row, (part << 24) | (filters[row] << 7) | cut


def _look(words: int, dtype: str, min_cosine: float, table):
    """Entries in the cells of their own filter, and in those of the filters at which they look for partners."""

    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dims, whole in _by_dims(batch) if batch.num_rows else ():
                first, second = code(dims, words)
                floor, parts, cuts = table.value[dims]
                for at in range(0, whole.num_rows, CHUNK):
                    batch_part = whole.slice(at, CHUNK)
                    x = _unit(batch_part.column("vector").to_pylist(), dtype)
                    best, node = batch_part.column("best").to_numpy(), batch_part.column("node").to_numpy()
                    a, b = x @ first.T, x @ second.T
                    least = threshold(best, min_cosine)
                    rows, filters = [], []
                    for i in range(len(x)):
                        # code words that reach the threshold with the best of the other half
                        left = np.flatnonzero(a[i] >= least[i] - b[i].max())
                        right = np.flatnonzero(b[i] >= least[i] - a[i].max())
                        names = left[:, None] * words + right
                        need = np.maximum(least[i], threshold(floor[names], min_cosine))
                        found = names[(a[i][left][:, None] + b[i][right] >= need) & np.isfinite(floor[names])]
                        rows.append(np.full(len(found), i))
                        filters.append(found)
                    rows, filters = np.concatenate(rows), np.concatenate(filters)
                    own = batch_part.column("filter").to_numpy().astype(np.int64)
                    kept, kept_cell = _cells(own, node, parts, cuts, swap=False)
                    some, some_cell = _cells(filters, node[rows], cuts, parts, swap=True)
                    lean = batch_part.drop_columns(["filter"])
                    for at_row, cell, stored in ((kept, kept_cell, True), (rows[some], some_cell, False)):
                        yield pa.RecordBatch.from_arrays(
                            [*lean.take(pa.array(at_row)).columns, pa.array(cell), pa.array(np.full(len(cell), stored))],
                            [*lean.schema.names, "cell", "stored"],
                        )

    return task


def _verify(dtype: str, min_cosine: float):
    """Per group one label and one cell: count and join pairs of stored and looking entries."""

    def task(batches: Batches) -> Iterator[pa.RecordBatch]:
        for table, offsets in groups(batches, "label", "dims", "cell"):
            ids, stored = table.column("node").to_numpy(), table.column("stored").to_numpy(zero_copy_only=False)
            best, copies = table.column("best").to_numpy(), table.column("copies").to_numpy()
            vectors = table.column("vector").to_pylist()
            for start, end in zip(offsets[:-1], offsets[1:]):
                rows = np.arange(start, end)
                kept, looking = rows[stored[start:end]], rows[~stored[start:end]]
                if not len(kept) or not len(looking):
                    continue
                x = _unit([vectors[i] for i in kept], dtype)
                near = np.zeros(end - start, np.int64)
                ends_a, ends_b = [], []
                for at in range(0, len(looking), CHUNK):
                    some = looking[at : at + CHUNK]
                    y = _unit([vectors[i] for i in some], dtype)
                    hit = (y @ x.T >= min_cosine) & (best[kept][None, :] >= best[some][:, None])
                    i, j = np.nonzero(hit)
                    other = ids[some[i]] != ids[kept[j]]
                    a, b = some[i[other]] - start, kept[j[other]] - start
                    np.add.at(near, a, copies[b + start])
                    # equally good entries find each other from both ends
                    one = best[a + start] < best[b + start]
                    np.add.at(near, b[one], copies[a[one] + start])
                    ends_a.append(a)
                    ends_b.append(b)
                a, b = np.concatenate(ends_a), np.concatenate(ends_b)
                if not len(a):
                    continue
                label = forest(a, b, end - start)
                at = np.flatnonzero((near > 0) | (label != np.arange(end - start)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at + start]), pa.array(near[at]), pa.array(ids[label[at] + start])],
                    ["node", "near", "other"],
                )

    return task


def near_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", min_cosine: float = MIN_COSINE
) -> DataFrame:
    """One row per row: the key, ``n_links``, ``component_id`` and ``kept``.

    Two vectors are linked if their labels are equal and not null, they have
    as many components, and their cosine in double precision is at least
    ``min_cosine`` (above 0). ``n_links`` counts other rows linked directly,
    ``component_id`` is the smallest key that links reach, ``kept`` marks the
    row that has it. A vector that is null, empty, zero, or holds a null or
    non-finite component links with nothing and is kept, as is one with a null
    label. Repeated rows are linked to each other like any equal vectors;
    a null key counts and is counted, but names no component, and is kept only
    where no key does. Other columns are not read. An empty table stays empty.
    """
    if not 0 < min_cosine <= 1:
        raise ValueError("the cosine must be in (0, 1]")
    spark = df.sparkSession
    dtype = "<f8" if "double" in df.schema[vector].dataType.simpleString() else "<f4"
    id_kind, label_kind = (df.schema[c].dataType.simpleString() for c in (key, label))
    narrow = df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    entries = materialize(
        narrow.mapInArrow(_entries(dtype), f"id {id_kind}, label {label_kind}, dims int, digest binary, vector binary"),
        "vectors",
    )
    usable = entries.filter("digest IS NOT NULL")
    same = usable.groupBy("label", "dims", "digest").agg(
        F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"), F.any_value("vector").alias("vector")
    )
    words = max(4, min(MAX_WORDS, round((usable.count() / PER_FILTER) ** 0.5)))
    schema = f"label {label_kind}, dims int, digest binary, copies long, least {id_kind}, vector binary, node long"
    stored = materialize(
        same.withColumn("node", F.monotonically_increasing_id()).mapInArrow(
            _store(words, dtype), f"{schema}, filter int, best double"
        ),
        "stored",
    )
    # One row per filter in use: at most MAX_WORDS squared for each number of components.
    held = stored.groupBy("dims", "filter").agg(F.min("best").alias("worst"), F.count(F.lit(1)).alias("n"))
    table: dict[int, tuple] = {}
    for row in held.toLocalIterator():
        size = words * words
        own = table.setdefault(row.dims, (np.full(size, np.inf), np.ones(size, np.int64), np.ones(size, np.int64)))
        for values, value in zip(own, (row.worst, -(-row.n // PART), min(-(-row.n // PART), MAX_CUTS))):
            values[row["filter"]] = value
    # A large filter becomes a grid: a stored entry lies in one of its parts and meets every cut
    # of the looking side there; a looking entry lies in one cut and goes to every part.
    looking = stored.select("label", "dims", "copies", "vector", "node", "best", "filter").mapInArrow(
        _look(words, dtype, min_cosine, spark.sparkContext.broadcast(table)),
        f"label {label_kind}, dims int, copies long, vector binary, node long, best double, cell long, stored boolean",
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(
        looking.repartition(n, "label", "dims", "cell")
        .sortWithinPartitions("label", "dims", "cell")
        .mapInArrow(_verify(dtype, min_cosine), "node long, near long, other long"),
        "near",
    )
    counts = found.groupBy("node").agg(F.sum("near").alias("near"))
    roots = components(found.select("node", "other"), "node", "other").withColumnRenamed("node", "member")
    rooted = (
        stored.select("label", "dims", "digest", "node", "copies", "least")
        .join(counts, "node", "left")
        .join(roots, F.col("node") == F.col("member"), "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    known = rooted.join(named, "root").select(
        F.col("label").alias("_label"),
        F.col("dims").alias("_dims"),
        F.col("digest").alias("_digest"),
        (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links"),
        "component",
    )
    match = (F.col("label") == F.col("_label")) & (F.col("dims") == F.col("_dims")) & (F.col("digest") == F.col("_digest"))
    out = entries.select("id", "label", "dims", "digest").join(known, match, "left")
    component = F.when(F.col("_digest").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias(key),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )
