"""Similarity and projection of dense embeddings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin.functions.vectors import cosine
from tocsin.operators.tables import top_n_per_group


def _vector(col: str) -> Column:
    return array_to_vector(F.col(col).cast("array<double>"))


def cosine_pairs(pairs: DataFrame, a: str = "vec_a", b: str = "vec_b") -> DataFrame:
    """Cosine similarity of two vector columns of the same row."""
    return pairs.withColumn("similarity", cosine(F.col(a), F.col(b)))


def centroids(df: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Mean vector per label; partial means are combined before the shuffle."""
    return (
        df.select(label_col, _vector(vec_col).alias("_v"))
        .groupBy(label_col)
        .agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("centroid"))
    )


def _as_array(cents: DataFrame, *cols: str) -> Column:
    """A table of one row per label as one array value on every row."""
    return cents.agg(F.array_sort(F.collect_list(F.struct(*cols)))).scalar()


def centroid_similarity(cents: DataFrame, label_col: str = "label") -> DataFrame:
    """Similarity between the centroids of every two labels."""
    others = _as_array(cents, label_col, "centroid")
    return (
        cents.withColumn("_others", others)
        .select(
            F.col(label_col).alias("label_a"), F.col("centroid").alias("_a"), F.explode("_others").alias("_o")
        )
        .filter(F.col("label_a") < F.col(f"_o.{label_col}"))
        .select("label_a", F.col(f"_o.{label_col}").alias("label_b"), cosine(F.col("_a"), F.col("_o.centroid")).alias("similarity"))
    )


def centroid_scores(
    df: DataFrame, cents: DataFrame, label_col: str = "label", vec_col: str = "embedding"
) -> DataFrame:
    """Add ``scores``: array of (label, similarity) to every centroid, by label."""
    return df.withColumn("_cents", _as_array(cents, label_col, "centroid")).select(
        *df.columns,
        F.transform(
            "_cents",
            lambda c: F.struct(c[label_col].alias("label"), cosine(F.col(vec_col), c["centroid"]).alias("similarity")),
        ).alias("scores"),
    )


SLICE = 16_384  # rows that a block of queries meets in one task
AT_ONCE = 256  # queries whose products with a slice are held at a time


def by_cosine(product: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosine from a product and both squared lengths, and where there is one."""
    lengths = np.sqrt(a) * np.sqrt(b)
    return np.divide(product, lengths, out=np.zeros_like(product), where=lengths != 0), lengths != 0


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, padded with zeros, and the size of each: -1 for a vector that is null or holds a null."""
    lists = column.combine_chunks()
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(int)
    values = lists.flatten()
    out = np.zeros((len(size), size.max(initial=0)))
    inside = np.arange(out.shape[1]) < size[:, None]
    out[inside] = values.to_numpy(zero_copy_only=False)
    missing = np.zeros(out.shape, bool)
    missing[inside] = values.is_null().to_numpy(zero_copy_only=False)
    lost = missing.any(axis=1) | lists.is_null().to_numpy(zero_copy_only=False)
    out[lost] = 0.0
    return out, np.where(lost, -1, size)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of each pair of rows, added up in one order, so that copies of a vector are draws."""
    total = np.zeros(len(a))
    for d in range(min(a.shape[1], b.shape[1])):
        total += a[:, d] * b[:, d]
    return total


def _nearest_of_slice(k: int, id_col: str, vec_col: str, query_id: str, query_vec: str, score):
    """The first ``k`` rows of a slice for each query of a block.

    Matrix products find the rows that can be among the first; only these are
    scored pair by pair and ranked.
    """

    def first(rows: pa.Table, asked: pa.Table) -> pa.Table:
        np.seterr(invalid="ignore", over="ignore")
        rows = rows.take(pc.sort_indices(rows, [(id_col, "ascending")], null_placement="at_start"))
        (a, size), (b, wanted) = _matrix(rows.column(vec_col)), _matrix(asked.column(query_vec))
        both = min(a.shape[1], b.shape[1])
        norm_a, norm_b, n = _products(a, a), _products(b, b), len(a)
        largest = norm_a[np.isfinite(norm_a)].max(initial=0.0)
        found_queries, found_rows, found_scores = [], [], []
        for at in range(0, len(b) if n else 0, AT_ONCE):
            part, norm = b[at : at + AT_ONCE], norm_b[at : at + AT_ONCE, None]
            rough, known = score(part[:, :both] @ a[:, :both].T, norm_a, norm)
            known &= (size == wanted[at : at + AT_ONCE, None]) & (size >= 0)
            rough = np.where(known, np.where(np.isnan(rough), np.inf, rough), -np.inf)
            least = np.partition(rough, n - k, axis=1)[:, n - k, None] if n > k else np.full((len(part), 1), -np.inf)
            slack = 1e-10 * np.maximum(1.0, largest + np.where(np.isfinite(norm), norm, 0.0))
            query, row = np.nonzero(known & (rough >= least - slack))
            exact = score(_products(a[row], part[query]), norm_a[row], norm[query, 0])[0]
            order = np.lexsort((row, -np.where(np.isnan(exact), np.inf, exact), ~np.isnan(exact), query))
            query, row, exact = query[order], row[order], exact[order]
            starts = np.searchsorted(query, np.arange(len(part) + 1))
            kept = np.arange(len(query)) - starts[query] < k
            found_queries.append(at + query[kept])
            found_rows.append(row[kept])
            found_scores.append(pa.array(exact[kept], pa.float64()))
            for short in np.flatnonzero(np.diff(starts) < k):  # rows without a score come last
                rest = np.flatnonzero(~known[short])[: k - (starts[short + 1] - starts[short])]
                found_queries.append(np.full(len(rest), at + short))
                found_rows.append(rest)
                found_scores.append(pa.nulls(len(rest), pa.float64()))
        joined = [np.concatenate([np.empty(0, int), *f]) for f in (found_queries, found_rows)]
        return pa.table({
            query_id: asked.column(query_id).take(pa.array(joined[0])),
            id_col: rows.column(id_col).take(pa.array(joined[1])),
            "similarity": pa.chunked_array(found_scores, pa.float64()),
        })

    return first


def nearest(
    df: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
    query_id: str = "query_id", query_vec: str = "query_vec", block: int = 4096, score: Callable = by_cosine,
) -> DataFrame:
    """The ``k`` rows most similar to each query vector, exactly; ties go to the smaller id.

    Queries are dealt into blocks of about ``block`` and rows into slices of
    about ``SLICE``. Every slice meets every block in a task of its own, which
    multiplies them as matrices and hands on ``k`` rows per query, so any number
    of queries can be asked and memory does not grow. The cost is rows times queries.
    """
    n_blocks = max(1, -(-queries.count() // block))
    n_slices = max(1, -(-df.count() // SLICE))

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n: int, *cols: str) -> Column:
        return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")

    rows = df.select(id_col, vec_col, dealt(n_slices, id_col, vec_col).alias("_slice"), numbers(n_blocks).alias("_block"))
    asked = queries.select(query_id, query_vec, dealt(n_blocks, query_id).alias("_block"), numbers(n_slices).alias("_slice"))
    schema = T.StructType([queries.schema[query_id], df.schema[id_col], T.StructField("similarity", T.DoubleType())])
    scored = rows.groupBy("_block", "_slice").cogroup(asked.groupBy("_block", "_slice")).applyInArrow(
        _nearest_of_slice(k, id_col, vec_col, query_id, query_vec, score), schema
    )
    return top_n_per_group(scored, [query_id], [F.desc("similarity"), F.asc(id_col)], k)


def project_2d(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Two principal components as ``x`` and ``y``, other columns kept.

    A component points to where its largest coefficient is positive.
    """
    vectors = df.withColumn("_v", _vector(vec_col))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(vectors)
    axes = model.pc.toArray()
    x, y = (1.0 if a[np.abs(a).argmax()] > 0 else -1.0 for a in axes.T)
    xy = model.transform(vectors).withColumn("_xy", vector_to_array("_p"))
    return xy.select(
        *[c for c in df.columns if c != vec_col], (x * F.col("_xy")[0]).alias("x"), (y * F.col("_xy")[1]).alias("y")
    )
