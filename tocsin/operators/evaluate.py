"""Evaluation of a prediction table ``(…group columns, y_true, y_pred)``.

Everything starts from :func:`pair_counts`, which reduces the predictions to
at most (classes + 2) squared rows per group with partial sums before the
shuffle. All reports are arithmetic on that small table, so a class that
holds most rows does not matter, and any number of models or phases is
evaluated in one job through ``by``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tocsin.constants import CLASSES, NON_URGENT, URGENT
from tocsin.operators.tables import names, snake
from tocsin.session import materialize

INVALID = ["ERROR", "UNMATCHED"]
METRICS = ["precision", "recall", "f1"]


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def attach_predictions(df: DataFrame, preds: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Join predictions to their rows by key and flag the correct ones."""
    return df.join(preds, id_col).withColumn("correct", F.col("target_label").eqNullSafe(F.col("y_pred")))


def add_correct(preds: DataFrame) -> DataFrame:
    return preds.withColumn("correct", F.col("y_true").eqNullSafe(F.col("y_pred")))


def pair_counts(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (truth, prediction) pair."""
    return preds.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))


def confusion(preds: DataFrame, by: Sequence[str] = (), classes: Sequence[str] = CLASSES) -> DataFrame:
    """All class pairs with their counts, zero cells included."""
    cells = (
        pair_counts(preds, by)
        .withColumnsRenamed({"y_true": "_t", "y_pred": "_p"})
        .select("*", F.explode(names(classes)).alias("y_true"))
        .select("*", F.explode(names(classes)).alias("y_pred"))
    )
    hit = (F.col("_t") == F.col("y_true")) & (F.col("_p") == F.col("y_pred"))
    return cells.groupBy(*by, "y_true", "y_pred").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n")
    )


def confusion_norm(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row shares; a class without truth rows keeps zeros."""
    row = Window.partitionBy(*by, "y_true")
    total = F.greatest(F.sum("n").over(row), F.lit(1))
    return cm.withColumn("share", F.round(F.col("n") / total, 6))


def confusion_wide(cm: DataFrame, by: Sequence[str] = (), classes: Sequence[str] = CLASSES) -> DataFrame:
    """Matrix layout: one row per true class, one column per predicted class."""
    return cm.groupBy(*by, "y_true").agg(
        *[F.sum(F.when(F.col("y_pred") == c, F.col("n"))).alias(snake(c)) for c in classes]
    )


def _class_sums(preds: DataFrame, by: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """Per class: hits, predicted rows, true rows and their ratios.

    Every pair is repeated once per class, so the sums of each class see all
    rows of the group; ``right`` and ``rows`` are the same in all of them.
    """
    pairs = pair_counts(preds, by).select("*", F.explode(names(classes)).alias("class"))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    is_true, is_pred = F.col("y_true") == F.col("class"), F.col("y_pred") == F.col("class")
    return (
        pairs.groupBy(*by, "class")
        .agg(
            total(is_true & is_pred).alias("tp"),
            total(is_pred).alias("predicted"),
            total(is_true).alias("support"),
            total(F.col("y_true").eqNullSafe(F.col("y_pred"))).alias("right"),
            F.sum("n").alias("rows"),
        )
        .withColumns(
            {
                "precision": _ratio(F.col("tp"), F.col("predicted")),
                "recall": _ratio(F.col("tp"), F.col("support")),
                "f1": _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")),
            }
        )
    )


def class_report(preds: DataFrame, by: Sequence[str] = (), classes: Sequence[str] = CLASSES) -> DataFrame:
    """Precision, recall, F1, support per class; nothing over nothing is 0."""
    return _class_sums(preds, by, classes).select(*by, "class", *METRICS, "support", "predicted", "tp")


def _means(only_seen: bool) -> list[Column]:
    counted = F.lit(True) if not only_seen else (F.col("support") + F.col("predicted")) > 0
    macro = [F.coalesce(F.avg(F.when(counted, F.col(m))), F.lit(0.0)).alias(f"macro_{m}") for m in METRICS]
    weighted = [
        _ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in METRICS
    ]
    return macro + weighted


def summarize_report(report: DataFrame, by: Sequence[str] = (), only_seen: bool = False) -> DataFrame:
    """Macro and weighted means of a class report.

    ``only_seen`` takes the macro mean over classes that occur in truth or
    prediction; otherwise over all classes.
    """
    return report.groupBy(*by).agg(*_means(only_seen))


def accuracy(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return preds.groupBy(*by).agg(
        F.avg(F.col("y_true").eqNullSafe(F.col("y_pred")).cast("double")).alias("accuracy"),
        F.count("*").alias("n_rows"),
    )


def overall_metrics(
    preds: DataFrame, by: Sequence[str] = (), classes: Sequence[str] = CLASSES, only_seen: bool = False
) -> DataFrame:
    """Accuracy, macro and weighted precision, recall and F1, one row per group."""
    return _class_sums(preds, by, classes).groupBy(*by).agg(
        _ratio(F.max("right"), F.max("rows")).alias("accuracy"),
        *_means(only_seen),
        F.max("rows").alias("n_rows"),
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; sums differ in their last bits by order."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def metrics_wide(
    preds: DataFrame, by: Sequence[str] = (), classes: Sequence[str] = CLASSES, prefix: str = "",
    only_seen: bool = True,
) -> DataFrame:
    """One row per group with overall and per-class metrics as columns."""
    overall = [_ratio(F.max("right"), F.max("rows")).alias("accuracy"), *_means(only_seen)]
    per_class = [
        F.max(F.when(F.col("class") == c, F.col(m))).alias(f"{m}_class_{snake(c)}") for c in classes for m in METRICS
    ]
    wide = _class_sums(preds, by, classes).groupBy(*by).agg(*overall, *per_class)
    return wide.select(*by, *[F.col(c).alias(prefix + c) for c in wide.columns if c not in by])


def class_accuracy(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of each true class predicted right; classes without rows are left out."""
    return (
        add_correct(preds)
        .groupBy(*by, "y_true")
        .agg(
            F.avg(F.col("correct").cast("double")).alias("accuracy"),
            F.count_if("correct").alias("n_correct"),
            F.count("*").alias("n_rows"),
        )
    )


def _is_dangerous() -> Column:
    return F.col("y_true").isin(URGENT) & F.col("y_pred").isin(NON_URGENT)


def dangerous_fn(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Urgent messages predicted as harmless: count, percent of urgent, by class."""
    bad = _is_dangerous()
    return preds.groupBy(*by).agg(
        F.count_if(F.col("y_true").isin(URGENT)).alias("n_urgent"),
        F.count_if(bad).alias("n_dangerous"),
        _ratio(F.count_if(bad) * 100.0, F.count_if(F.col("y_true").isin(URGENT))).alias("pct_dangerous"),
        *[F.count_if(bad & (F.col("y_true") == c)).alias(f"n_{snake(c)}") for c in URGENT],
    )


def dangerous_rows(preds: DataFrame) -> DataFrame:
    return preds.filter(_is_dangerous())


def pair_confusion(preds: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """How often two classes are taken for each other, per direction."""
    return preds.groupBy(*by).agg(
        F.count_if((F.col("y_true") == a) & (F.col("y_pred") == b)).alias("n_a_as_b"),
        F.count_if((F.col("y_true") == b) & (F.col("y_pred") == a)).alias("n_b_as_a"),
    )


def pair_rows(preds: DataFrame, true: str, pred: str) -> DataFrame:
    return preds.filter((F.col("y_true") == true) & (F.col("y_pred") == pred))


def errors(preds: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Misclassified rows, sorted by true class and id."""
    wrong = add_correct(preds).filter(~F.col("correct")).drop("correct")
    return wrong.orderBy("y_true", id_col)


def leaderboard(
    preds: DataFrame, by: Sequence[str] = ("model",), classes: Sequence[str] = CLASSES
) -> DataFrame:
    """One row per model, best macro F1 first; a model without rows has no line."""
    board = overall_metrics(preds, by, classes, only_seen=True)
    return rounded(board.select(*by, "accuracy", "macro_precision", "macro_recall", "macro_f1")).orderBy(
        F.desc("macro_f1"), *by
    )


def class_matrix(
    preds: DataFrame, metric: str = "f1", by: Sequence[str] = ("model",), classes: Sequence[str] = CLASSES
) -> DataFrame:
    """Model by class matrix of one metric, in leaderboard order (``rank``)."""
    report = class_report(preds, by, classes)
    wide = report.groupBy(*by).agg(
        *[F.round(F.max(F.when(F.col("class") == c, F.col(metric))), 6).alias(snake(c)) for c in classes]
    )
    board = leaderboard(preds, by, classes)
    best_first = Window.orderBy(F.desc("macro_f1"), *by)  # one row per model
    ranked = board.select(*by, F.row_number().over(best_first).alias("rank"))
    return wide.join(ranked, list(by))


def ablation(results: DataFrame, metric: str, by: str = "model", flag: str = "augmented") -> DataFrame:
    """A metric without and with augmentation, and the gain."""
    wide = results.groupBy(by).pivot(flag, [False, True]).agg(F.max(metric))
    return wide.select(
        by,
        F.col("false").alias("real_only"),
        F.col("true").alias("augmented"),
        (F.col("true") - F.col("false")).alias("delta"),
    )


def long_report(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Class report as ``(class, metric, value)`` rows."""
    return report.select(*by, "class", *METRICS).unpivot([*by, "class"], METRICS, "metric", "value")


def report_delta(a: DataFrame, b: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Chosen (class, metric) values of two long reports and ``b - a``."""
    chosen = F.struct("class", "metric").isin(
        [F.struct(F.lit(c).alias("class"), F.lit(m).alias("metric")) for c, m in pairs]
    )
    left = a.filter(chosen).withColumnRenamed("value", "value_a")
    right = b.filter(chosen).withColumnRenamed("value", "value_b")
    return left.join(right, ["class", "metric"], "full_outer").withColumn(
        "delta", F.col("value_b") - F.col("value_a")
    )


def full_long_report(preds: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Class rows plus macro, weighted and accuracy rows of one prediction set."""
    report = class_report(preds, (), classes)
    means = summarize_report(report)
    rows = [
        F.struct(F.lit(f"{kind} avg").alias("class"), F.lit(m).alias("metric"), F.col(f"{kind}_{m}").alias("value"))
        for kind in ("macro", "weighted")
        for m in METRICS
    ]
    right = accuracy(preds).select(
        F.lit("accuracy").alias("class"), F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")
    )
    return long_report(report).unionByName(means.select(F.inline(F.array(*rows)))).unionByName(right)


def side_by_side(preds: DataFrame, models: Sequence[str], metric: str = "recall") -> DataFrame:
    """One metric per class, a column per model."""
    report = class_report(preds, ["model"])
    return report.groupBy("class").agg(
        *[F.round(F.max(F.when(F.col("model") == m, F.col(metric))), 6).alias(m) for m in models]
    )


def scored_summary(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy over usable answers, and how many were not usable."""
    valid = ~F.col("y_pred").isin(INVALID)
    right = F.count_if(valid & (F.col("y_true") == F.col("y_pred")))
    return preds.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.count_if(valid).alias("n_valid"),
        F.count_if(~valid).alias("n_skipped"),
        _ratio(right, F.count_if(valid)).alias("accuracy"),
    )


def compare_experiments(
    preds: DataFrame, by: Sequence[str] = ("experiment", "strategy", "seed"), classes: Sequence[str] = CLASSES
) -> DataFrame:
    """One row per experiment: accuracy, skipped rows, accuracy per class.

    A class without usable rows is null, not zero.
    """
    valid = ~F.col("y_pred").isin(INVALID)
    right = F.col("y_true") == F.col("y_pred")
    per_class = [
        F.try_divide(
            F.count_if(valid & right & (F.col("y_true") == c)), F.count_if(valid & (F.col("y_true") == c))
        ).alias(snake(c))
        for c in classes
    ]
    return preds.groupBy(*by).agg(
        _ratio(F.count_if(valid & right), F.count_if(valid)).alias("accuracy"),
        F.count_if(~valid).alias("skipped"),
        *per_class,
    )


def evaluate_phases(preds: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Overall metrics of every (phase, model) in one job."""
    return rounded(overall_metrics(preds, ["phase", "model"], classes, only_seen=True))


def focal_loss(
    preds: DataFrame, weights: DataFrame, gamma: float = 2.0, proba: str = "proba", classes: Sequence[str] = CLASSES
) -> DataFrame:
    """Mean weighted focal loss of a probability table."""
    p = F.get(F.col(proba), F.array_position(names(classes), F.col("y_true")).cast("int") - 1)
    ce = -F.col("weight") * F.log(p)
    loss = F.pow(1 - F.exp(-ce), F.lit(gamma)) * ce
    rows = preds.join(F.broadcast(weights.select(F.col("target_label").alias("y_true"), "weight")), "y_true")
    return rows.agg(F.avg(loss).alias("focal_loss"), F.count("*").alias("n_rows"))


# --- curves ---------------------------------------------------------------


def scores_long(
    preds: DataFrame, proba: str = "proba", by: Sequence[str] = (), classes: Sequence[str] = CLASSES
) -> DataFrame:
    """One row per (prediction row, class): score and whether the class is true."""
    return preds.select(
        *by, "y_true", F.posexplode(proba).alias("_pos", "score")
    ).select(
        *by,
        F.get(names(classes), F.col("_pos")).alias("class"),
        "score",
        (F.get(names(classes), F.col("_pos")) == F.col("y_true")).alias("positive"),
    )


def curve_points(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One point per distinct score: ROC rates, precision and recall.

    Rows are first reduced to distinct scores per class, from the top down.
    A window over a whole class would be one task, so the sorted scores are
    cut into slices: as many as there are shuffle partitions, at bounds that
    follow the rows of every group and class. Each slice is summed on its own
    and the totals of the higher slices are added. The slices are written, so
    that both sums and every later use read the same ones.
    """
    keys = [*by, "class"]
    steps = scores.groupBy(*keys, "score").agg(
        F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg")
    )
    slices = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(
        steps.repartitionByRange(slices, *keys, F.desc("score")).withColumn("slice", F.spark_partition_id()), "curve"
    )
    group = Window.partitionBy(*keys)
    above = group.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    heads = cut.groupBy(*keys, "slice").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(
        *[F.col(c).alias(f"_{c}") for c in keys],
        F.col("slice").alias("_slice"),
        F.coalesce(F.sum("p").over(above), F.lit(0)).alias("tp0"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("fp0"),
        F.sum("p").over(group).alias("n_pos"),
        F.sum("n").over(group).alias("n_neg"),
    )
    inside = Window.partitionBy(*keys, "slice").orderBy(F.desc("score"))
    same = F.col("slice") == F.col("_slice")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    points = cut.withColumns({"tp": F.sum("pos").over(inside), "fp": F.sum("neg").over(inside)}).join(heads, same)
    tp, fp = F.col("tp") + F.col("tp0"), F.col("fp") + F.col("fp0")
    return points.select(
        *keys,
        F.col("score").alias("threshold"),
        "pos",
        "neg",
        tp.alias("tp"),
        fp.alias("fp"),
        F.try_divide(tp, "n_pos").alias("tpr"),
        F.try_divide(fp, "n_neg").alias("fpr"),
        (tp / (tp + fp)).alias("precision"),
        "n_pos",
        "n_neg",
    )


def roc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC points per class with the (0, 0) start, threshold null there."""
    keys = [*by, "class"]
    points = curve_points(scores, by).select(*keys, "threshold", "fpr", "tpr")
    start = points.select(*keys).distinct().select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def roc_auc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; tied scores form one trapezoid.

    A step adds ``neg`` to the right at a mean height of ``tp - pos/2``, so
    the area is a plain sum over points and needs no neighbouring row. Null
    where a class has no positive or no negative rows.
    """
    points = curve_points(scores, by)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return points.groupBy(*by, "class").agg(
        F.try_divide(area, F.max("n_pos").cast("double") * F.max("n_neg")).alias("auc"),
        F.max("n_pos").alias("n_pos"),
    )


def pr_curve(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall per class with the (recall 0, precision 1) end."""
    keys = [*by, "class"]
    points = curve_points(scores, by).select(
        *keys, "threshold", "precision", F.coalesce("tpr", F.lit(1.0)).alias("recall")
    )
    end = points.select(*keys).distinct().select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def average_precision(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of precision times recall gained; 0 for a class without positives."""
    points = curve_points(scores, by)
    gain = F.sum(F.col("precision") * F.col("pos"))
    return points.groupBy(*by, "class").agg(
        _ratio(gain, F.max("n_pos")).alias("average_precision"), F.max("n_pos").alias("n_pos")
    )
