"""Weighted multinomial naive Bayes on the long feature table.

Class counts do not depend on the smoothing value, so they are aggregated
once and every alpha is scored from them in a single pass over the features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tocsin.constants import ALPHA, CLASSES
from tocsin.functions.vectors import arg_max, class_name, softmax
from tocsin.operators.tables import top_n_per_group


def nb_counts(
    features: DataFrame, weights: DataFrame, classes: Sequence[str] = CLASSES, label_col: str = "target_label"
) -> DataFrame:
    """Per term: weighted feature mass of every class and the scaling maximum.

    ``(term_id, max_abs, mass ARRAY<DOUBLE>)``. Scaling by the per-term
    maximum is a constant factor of each term's sums, so the scaler and the
    class masses come out of the same pass and the scaled table is never built.
    """
    label = F.col(label_col)
    sums = features.groupBy("term_id").agg(
        F.max(F.abs("x")).alias("max_abs"),
        *[F.sum(F.when(label == c, F.col("x"))).alias(f"x{k}") for k, c in enumerate(classes)],
    )
    by_class = weights.agg(
        F.array(*[F.max(F.when(label == c, F.col("weight"))) for c in classes]).alias("w")
    ).scalar()
    divisor = F.coalesce(F.nullif(F.col("max_abs"), F.lit(0.0)), F.lit(1.0))
    mass = [F.coalesce(F.col(f"x{k}") * F.col("_w")[k], F.lit(0.0)) / divisor for k in range(len(classes))]
    return sums.withColumn("_w", by_class).select("term_id", "max_abs", F.array(*mass).alias("mass"))


def nb_prior(weights: DataFrame, classes: Sequence[str] = CLASSES, label_col: str = "target_label") -> DataFrame:
    """One row: log share of the weighted rows per class, without smoothing."""
    total = F.sum(F.col("weight") * F.col("n_rows"))
    share = [
        F.sum(F.when(F.col(label_col) == c, F.col("weight") * F.col("n_rows"))) / total for c in classes
    ]
    return weights.agg(F.array(*[F.coalesce(F.log(s), F.lit(float("-inf"))) for s in share]).alias("prior"))


def nb_fit(
    features: DataFrame,
    weights: DataFrame,
    alpha: float | Sequence[float] = ALPHA,
    classes: Sequence[str] = CLASSES,
    label_col: str = "target_label",
) -> DataFrame:
    """Fitted table ``(term_id, max_abs, log_prob)``, one row per term.

    ``log_prob`` holds one value per class; with several alphas it holds the
    classes of the first alpha, then of the second, and so on.
    """
    counts = nb_counts(features, weights, classes, label_col)
    alphas = [alpha] if isinstance(alpha, (int, float)) else list(alpha)
    everything = Window.partitionBy()  # vocabulary rows
    totals = counts.select(
        "*",
        F.array(*[F.sum(F.col("mass")[k]).over(everything) for k in range(len(classes))]).alias("_totals"),
        F.count("*").over(everything).alias("_terms"),
    )
    logs = [
        F.log(F.col("mass")[k] + a) - F.log(F.col("_totals")[k] + F.col("_terms") * a)
        for a in alphas
        for k in range(len(classes))
    ]
    return totals.select("term_id", "max_abs", F.array(*logs).alias("log_prob"))


def _joint(features: DataFrame, params: DataFrame, width: int, id_col: str) -> DataFrame:
    scaled = F.col("x") / F.coalesce(F.nullif(F.col("max_abs"), F.lit(0.0)), F.lit(1.0))
    return (
        features.join(F.broadcast(params), "term_id")  # one row per vocabulary term
        .withColumn("x", scaled)
        .groupBy(id_col)
        .agg(*[F.sum(F.col("x") * F.col("log_prob")[i]).alias(f"s{i}") for i in range(width)])
    )


def _with_prior(i: int, prior: Column, k: int) -> Column:
    return F.coalesce(F.col(f"s{i}"), F.lit(0.0)) + prior[k]


def nb_predict(
    features: DataFrame,
    params: DataFrame,
    prior: DataFrame,
    docs: DataFrame,
    classes: Sequence[str] = CLASSES,
    id_col: str = "doc_id",
) -> DataFrame:
    """``docs`` plus ``y_pred`` and the class probabilities ``proba``.

    A document without known terms is decided by the prior alone.
    """
    p = prior.scalar()
    scores = F.array(*[_with_prior(k, F.col("_prior"), k) for k in range(len(classes))])
    return (
        docs.join(_joint(features, params, len(classes), id_col), id_col, "left")
        .withColumn("_prior", p)
        .withColumn("_scores", scores)
        .select(
            *docs.columns,
            class_name(arg_max(F.col("_scores")), list(classes)).alias("y_pred"),
            softmax(F.col("_scores")).alias("proba"),
        )
    )


def nb_sweep_predict(
    features: DataFrame,
    params: DataFrame,
    prior: DataFrame,
    docs: DataFrame,
    alphas: Sequence[float],
    classes: Sequence[str] = CLASSES,
    id_col: str = "doc_id",
) -> DataFrame:
    """Predictions for every alpha: ``docs`` columns, ``alpha``, ``y_pred``."""
    k = len(classes)
    joint = _joint(features, params, k * len(alphas), id_col)
    choices = [
        F.struct(
            F.lit(float(a)).alias("alpha"),
            class_name(
                arg_max(F.array(*[_with_prior(i * k + j, F.col("_prior"), j) for j in range(k)])), list(classes)
            ).alias("y_pred"),
        )
        for i, a in enumerate(alphas)
    ]
    return (
        docs.join(joint, id_col, "left")
        .withColumn("_prior", prior.scalar())
        .select(*docs.columns, F.inline(F.array(*choices)))
    )


def top_terms(params: DataFrame, vocab: DataFrame, k: int = 10, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Terms that speak most for a class against the mean of all classes.

    Lifts are compared to twelve decimals: terms with equal counts are a draw
    whatever the order in which their masses were added up.
    """
    n = len(classes)
    mean = sum((F.col("log_prob")[i] for i in range(n)), F.lit(0.0)) / n
    rows = [
        F.struct(F.lit(c).alias("target_label"), F.round(F.col("log_prob")[i] - mean, 12).alias("lift"))
        for i, c in enumerate(classes)
    ]
    lifted = params.join(F.broadcast(vocab.select("term_id", "term")), "term_id").select(
        "term", F.inline(F.array(*rows))
    )
    return top_n_per_group(lifted, ["target_label"], [F.desc("lift"), F.asc("term")], k)
