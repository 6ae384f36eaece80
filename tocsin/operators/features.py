"""TF-IDF features as a long table ``(doc_id, ..., term_id, x)``.

The n-grams that a document explodes into, their counts and the row norm stay
in the document's partition, so no step shuffles the (several times larger)
n-gram table. A table that is bucketed by document id is read as it lies; any
other is hash-partitioned by id once. The vocabulary comes from bounded
summaries (``heavy_hitters``) and is broadcast while it is small enough.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tocsin.constants import MAX_DF, MAX_FEATURES, MIN_DF
from tocsin.functions.gram_counts import gram_counts
from tocsin.functions.text import ngrams, tokens
from tocsin.operators.heavy_hitters import CAPACITY, frequent_terms
from tocsin.session import cluster_by

GATHERED = 1 << 22  # characters of one document that may meet in one row


def ngrams_table(
    df: DataFrame,
    lo: int = 1,
    hi: int = 2,
    id_col: str = "doc_id",
    text_col: str = "clean_text",
    carry: Sequence[str] = (),
    keep_marks: bool = False,
    vocab: DataFrame | None = None,
    batched: bool = False,
) -> DataFrame:
    """N-gram counts per document: ``(id, *carry, term, tf)``.

    With ``vocab`` only its terms are counted, so that a partition never holds
    counts of what the features drop.

    ``batched`` counts documents on their own in Arrow, so a task holds the
    counts of some documents and not of its whole partition. Spark no longer
    knows the result as partitioned by ``id_col`` then; features, which group
    by it, are better made without.
    """
    rows = cluster_by(df.select(id_col, *carry, text_col), id_col)
    if batched:
        counted = _batched(rows, lo, hi, [id_col, *carry], text_col, keep_marks)
        return counted if vocab is None else counted.join(F.broadcast(vocab.select("term")), "term", "left_semi").select(
            *counted.columns
        )
    # Tokens are a column of their own: the n-grams refer to them several times.
    grams = rows.select(id_col, *carry, tokens(text_col, keep_marks).alias("_tokens")).select(
        id_col, *carry, F.explode(ngrams(F.col("_tokens"), lo, hi)).alias("term")
    )
    if vocab is not None:
        known = F.broadcast(vocab.select("term"))  # vocabulary rows
        grams = grams.join(known, "term", "left_semi").select(*grams.columns)
    return grams.groupBy(id_col, *carry, "term").agg(F.count("*").alias("tf"))


def _batched(rows: DataFrame, lo: int, hi: int, keys: list[str], text_col: str, keep_marks: bool) -> DataFrame:
    """N-gram counts of rows that lie by document.

    The texts of one document are gathered first. Beyond ``GATHERED``
    characters its n-grams are grouped one by one instead, without a bound.
    """
    document = Window.partitionBy(*keys)  # one number is summed; what does not fit is spilled
    long = F.coalesce(F.sum(F.length(text_col)).over(document) > GATHERED, F.lit(False))
    split = rows.select(*keys, text_col, long.alias("_long")).select(
        *keys,
        F.when(~F.col("_long"), F.col(text_col)).alias("_text"),
        F.when(F.col("_long"), tokens(text_col, keep_marks)).alias("_tokens"),
    )
    # One row without a term for a gathered document, one row per term of a long one.
    grouped = (
        split.select(*keys, "_text", F.explode_outer(ngrams(F.col("_tokens"), lo, hi)).alias("_term"))
        .groupBy(*keys, "_term")
        .agg(F.collect_list("_text").alias("_texts"), F.count("*").alias("_tf"))
        .withColumn("_texts", F.transform("_texts", lambda text: tokens(text, keep_marks)))
    )
    schema = StructType([*[grouped.schema[k] for k in keys], StructField("term", StringType()), StructField("tf", LongType())])
    return grouped.mapInArrow(gram_counts(keys, lo, hi), schema)


def _bounds(n_docs: Column, min_df: int, max_df: float, df: str = "df", df_most: str = "df") -> Column:
    return (F.col(df) >= min_df) & (F.col(df_most) <= max_df * n_docs)


def _with_ids(kept: DataFrame, n_docs: Column, max_features: int) -> DataFrame:
    alphabet = Window.orderBy("term")  # max_features rows at most
    return kept.orderBy(F.desc("cnt"), F.asc("term")).limit(max_features).select(
        (F.row_number().over(alphabet) - 1).cast("int").alias("term_id"),
        "term",
        "df",
        "cnt",
        (F.log((1 + n_docs) / (1 + F.col("df"))) + 1).alias("idf"),
    )


def fit_vocab(
    docs: DataFrame,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    max_features: int = MAX_FEATURES,
    lo: int = 1,
    hi: int = 2,
    text_col: str = "clean_text",
    keep_marks: bool = False,
    capacity: int = CAPACITY,
) -> DataFrame:
    """Terms to keep: ``(term_id, term, df, cnt, idf)``.

    Document-frequency bounds first, then the most frequent ``max_features``
    by corpus count, ties to the smaller term. Ids follow the alphabet. Every
    row of ``docs`` is a document, token-less ones included. The n-grams are
    counted in bounded summaries; what is shuffled are these.
    """
    n_docs = F.lit(docs.count())
    counted = frequent_terms(
        docs, max_features, _bounds(n_docs, min_df, max_df), _bounds(n_docs, min_df, max_df, df_most="df_most"),
        lo, hi, text_col, keep_marks, capacity,
    )
    return _with_ids(counted, n_docs, max_features)


def fit_vocab_of_terms(
    terms: DataFrame, docs: DataFrame, min_df: int = MIN_DF, max_df: float = MAX_DF, max_features: int = MAX_FEATURES
) -> DataFrame:
    """The same from the long table of n-gram counts, which it shuffles by term."""
    n_docs = docs.agg(F.count("*").alias("n")).scalar()
    counted = terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cnt"))
    return _with_ids(counted.filter(_bounds(n_docs, min_df, max_df)), n_docs, max_features)


def tfidf(
    terms: DataFrame, vocab: DataFrame, sublinear: bool = True, id_col: str = "doc_id"
) -> DataFrame:
    """Weighted, length-normalised features of any split.

    Terms outside the vocabulary drop out here; a document with none of them
    has no rows, which stands for the zero vector.
    """
    carry = [c for c in terms.columns if c not in (id_col, "term", "tf")]
    tf = F.log(F.col("tf")) + 1 if sublinear else F.col("tf").cast("double")
    raw = terms.join(F.broadcast(vocab.select("term", "term_id", "idf")), "term").select(
        id_col, *carry, "term_id", (tf * F.col("idf")).alias("raw")
    )
    document = Window.partitionBy(id_col)  # one text's terms
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(document))
    return raw.select(id_col, *carry, "term_id", (F.col("raw") / norm).alias("x"))


def fit_maxabs(features: DataFrame) -> DataFrame:
    """Largest magnitude per term, to be fitted on train only."""
    return features.groupBy("term_id").agg(F.max(F.abs("x")).alias("max_abs"))


def apply_maxabs(features: DataFrame, scale: DataFrame) -> DataFrame:
    """Divide by the fitted magnitude; unseen or all-zero terms stay as they are."""
    divisor = F.coalesce(F.nullif(F.col("max_abs"), F.lit(0.0)), F.lit(1.0))
    scaled = features.join(F.broadcast(scale), "term_id", "left")  # one row per vocabulary term
    return scaled.withColumn("x", F.col("x") / divisor).select(*features.columns)


def matrix_profile(features: DataFrame, vocab: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Shape, stored cells and value range; a missing cell counts as zero."""
    stored = features.agg(
        F.count("*").alias("n_cells"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    n_docs = docs.agg(F.count("*").alias("n")).scalar()
    n_terms = vocab.agg(F.count("*").alias("n")).scalar()
    dense = F.col("n_cells") == F.col("n_docs") * F.col("n_terms")
    return (
        stored.withColumns({"n_docs": n_docs, "n_terms": n_terms})
        .select(
            "n_docs",
            "n_terms",
            "n_cells",
            F.round(F.when(dense, F.col("lo")).otherwise(F.least(F.col("lo"), F.lit(0.0))), 6).alias("min_x"),
            F.round("hi", 6).alias("max_x"),
        )
    )
