"""Experiment grid: three models, with and without generated rows."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.constants import CLASSES
from tocsin.operators.augment import augment_train
from tocsin.operators.evaluate import metrics_wide
from tocsin.operators.tables import with_ordinal
from tocsin.operators.scoring import TextModel, fit_text_model, score_all


def labelled(df: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    return df.filter(F.col("target_label").isin(list(classes)))


def grid_variant(
    real: DataFrame,
    synthetic: DataFrame | None,
    classes: Sequence[str] = CLASSES,
    key: Sequence[str] = ("arrival",),
    **settings,
) -> tuple[TextModel, DataFrame]:
    """One variant: fitted state and its predictions on dev and test rows.

    Held-out rows are always real. ``key`` identifies a generated row.
    """
    train = real.filter(F.col("split") == "train")
    if synthetic is not None:
        # Generated rows carry no document id; the features need one of its own per row.
        numbered = with_ordinal(synthetic, key, "generated", name="_n").withColumn("doc_id", -1 - F.col("_n"))
        numbered = numbered.drop("_n")
        train = augment_train(real, numbered)
    state = fit_text_model(labelled(train, classes), classes=classes, **settings)
    heldout = labelled(real.filter(F.col("split").isin("dev", "test")), classes)
    flagged = score_all(heldout, state, classes=classes).select(
        "model", F.lit(synthetic is not None).alias("augmented"), "split", "doc_id",
        F.col("target_label").alias("y_true"), "y_pred", "proba",
    )
    return state, flagged


def grid_rows(preds: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """One wide row per (model, augmented): ``dev_*`` and ``test_*`` metrics."""
    by = ["model", "augmented"]
    wide = metrics_wide(preds, [*by, "split"], classes)  # one pass for both splits
    metrics = [c for c in wide.columns if c not in (*by, "split")]
    return wide.groupBy(*by).agg(
        *[F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}") for s in ("dev", "test") for c in metrics]
    )


def run_grid(real: DataFrame, synthetic: DataFrame, classes: Sequence[str] = CLASSES, **settings) -> DataFrame:
    """Both variants in one result table; their jobs are submitted together."""
    with ThreadPoolExecutor(max_workers=2) as pool:
        runs = pool.map(lambda s: grid_variant(real, s, classes, **settings)[1], [None, synthetic])
        plain, augmented = runs
    return grid_rows(plain.unionByName(augmented), classes)
