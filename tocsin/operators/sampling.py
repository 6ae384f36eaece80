"""Seeded sampling without a random generator.

Every draw orders rows by a hash of seed and row id, so the same rows come
back under any partitioning and after any task retry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tocsin.constants import FINGERPRINT_WORDS, RESPONSE_LABELS, ROWS_PER_CALL, SEEDS_PER_CALL, TARGET_ROWS
from tocsin.functions.keys import key_to_long, seeded_key
from tocsin.functions.text import fingerprint
from tocsin.operators.tables import top_n_per_group, with_ordinal
from tocsin.session import materialize


def sample_per_class(df: DataFrame, n: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """``n`` random rows of each class, or all rows of a smaller class."""
    known = df.filter(F.col("target_label").isNotNull())
    order = [seeded_key(seed, id_col), F.col(id_col)]
    return top_n_per_group(known, ["target_label"], order, n).drop("rn")


def class_shortages(df: DataFrame, n: int, labels: Sequence[str] = RESPONSE_LABELS) -> DataFrame:
    """Classes that cannot supply ``n`` rows, absent ones with zero."""
    wide = df.agg(*[F.count_if(F.col("target_label") == c).alias(c) for c in labels])
    return wide.unpivot([], list(labels), "target_label", "available").filter(F.col("available") < n)


def balanced_sample(
    df: DataFrame,
    n: int,
    seed: int,
    labels: Sequence[str] = RESPONSE_LABELS,
    id_col: str = "doc_id",
    strict: bool = True,
) -> DataFrame:
    """Exactly ``n`` rows per class in seeded order; short classes raise if strict."""
    if strict:
        short = class_shortages(df, n, labels).collect()  # at most one row per class
        if short:
            raise ValueError(f"need {n} rows per class, short: {[tuple(r) for r in short]}")
    rows = sample_per_class(df.filter(F.col("target_label").isin(list(labels))), n, seed, id_col)
    order = Window.orderBy(seeded_key(f"{seed}-shuffle", id_col), id_col)  # n rows per class at most
    return rows.withColumn("ord", F.row_number().over(order) - 1)


def shuffle(df: DataFrame, seed: int, key: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Seeded permutation of a whole table as a position column ``ord``."""
    return with_ordinal(df, list(key), seed)


def sample_n(df: DataFrame, n: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """``n`` random rows, or all rows of a smaller table."""
    return df.orderBy(seeded_key(seed, id_col), id_col).limit(n)


def rotate_seeds(
    pool: DataFrame, calls: int, k: int = SEEDS_PER_CALL, seed: int = 42, id_col: str = "doc_id"
) -> DataFrame:
    """``k`` distinct pool rows for every call.

    Only the ids of the pool are written and numbered, in seeded order; its
    other columns are joined to the chosen rows at the end. Slot ``s`` of a call picks a hashed
    position among those congruent to ``s`` modulo ``k``, so slots never
    collide and calls join the pool by position instead of crossing it.
    """
    ids = materialize(pool.select(id_col), "pool")
    size = ids.count()
    if size < k:
        raise ValueError(f"pool holds {size} rows, {k} needed per call")
    numbered = with_ordinal(ids, [id_col], seed)
    slots = (
        pool.sparkSession.range(calls)
        .select(F.col("id").alias("call_id"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("slot"))
        .withColumn("_h", key_to_long(seeded_key(seed, "call_id", "slot")))
        .withColumn("_n", F.floor((F.lit(size) - F.col("slot") + (k - 1)) / k))
        .select("call_id", "slot", (F.col("slot") + k * F.pmod("_h", F.col("_n"))).alias("ord"))
    )
    return pool.join(numbered.join(slots, "ord").drop("ord"), id_col)


def dedup_fingerprint(
    df: DataFrame, text_col: str, order: Sequence[str], n_words: int = FINGERPRINT_WORDS
) -> DataFrame:
    """First row, in arrival order, of every fingerprint.

    Spark cuts each partition to one row per fingerprint before the shuffle,
    so a text copied a billion times arrives once per input partition.
    """
    printed = df.withColumn("fingerprint", fingerprint(text_col, n_words))
    return top_n_per_group(printed, ["fingerprint"], [F.col(c) for c in order], 1).drop("rn")


def cap_rows(
    df: DataFrame,
    order: Sequence[str],
    target: int = TARGET_ROWS,
    per_call: int = ROWS_PER_CALL,
    call_col: str = "call_id",
    calls: DataFrame | None = None,
) -> DataFrame:
    """First ``target`` rows in arrival order within the call budget.

    The budget is three times the number of calls that would do if every row
    were kept. Calls count in the order of their ids, whatever these are;
    ``calls`` names those that were made, by default those with a row.
    """
    budget = (target // per_call) * 3
    made = (df if calls is None else calls).select(F.col(call_col).alias("_call")).distinct()
    spent = made.orderBy("_call").limit(budget)
    return df.join(spent, F.col(call_col) == F.col("_call"), "left_semi").orderBy(*order).limit(target)


def head_examples(df: DataFrame, n: int, order: Sequence[str] = ("doc_id",)) -> DataFrame:
    """First ``n`` rows by a stated order."""
    return df.orderBy(*order).limit(n)


def best_row(df: DataFrame, metric: str, tie: str) -> DataFrame:
    """Row with the largest metric; the smaller ``tie`` value wins a draw."""
    return df.orderBy(F.desc(metric), F.asc(tie)).limit(1)
