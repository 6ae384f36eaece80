"""Reports as nested JSON, and plain table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tocsin.constants import CLASSES
from tocsin.operators.evaluate import METRICS, class_report, overall_metrics
from tocsin.operators.tables import snake

# --- fixed values: metric keys of the JSON report -------------------------
JSON_KEYS = {"precision": "precision", "recall": "recall", "f1": "f1-score"}


def report_schema(classes: Sequence[str] = CLASSES) -> T.StructType:
    block = T.StructType(
        [T.StructField(k, T.DoubleType()) for k in JSON_KEYS.values()] + [T.StructField("support", T.DoubleType())]
    )
    return T.StructType(
        [T.StructField(c, block) for c in classes]
        + [T.StructField("accuracy", T.DoubleType())]
        + [T.StructField(a, block) for a in ("macro avg", "weighted avg")]
    )


def report_to_json(preds: DataFrame, by: Sequence[str] = (), classes: Sequence[str] = CLASSES) -> DataFrame:
    """One JSON document per group: class blocks, accuracy and the two means."""
    report = class_report(preds, by, classes)
    wide = report.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("class") == c, F.col(m))).cast("double").alias(f"{snake(c)}_{m}")
            for c in classes
            for m in [*METRICS, "support"]
        ],
        F.sum("support").cast("double").alias("total"),
    )
    means = overall_metrics(preds, by, classes).drop("n_rows")
    joined = wide.join(means, list(by)) if by else wide.withColumns(
        {c: means.select(c).scalar() for c in means.columns}
    )

    def block(prefix: str, support: str) -> list:
        return [F.col(f"{prefix}_{m}").alias(k) for m, k in JSON_KEYS.items()] + [F.col(support).alias("support")]

    document = F.struct(
        *[F.struct(*block(snake(c), f"{snake(c)}_support")).alias(c) for c in classes],
        F.col("accuracy"),
        F.struct(*block("macro", "total")).alias("macro avg"),
        F.struct(*block("weighted", "total")).alias("weighted avg"),
    )
    return joined.select(*by, F.to_json(document).alias("report"))


def report_from_json(df: DataFrame, by: Sequence[str] = (), classes: Sequence[str] = CLASSES) -> DataFrame:
    """JSON documents back to ``(…, class, metric, value)`` rows."""
    parsed = df.select(*by, F.from_json("report", report_schema(classes)).alias("r"))
    rows = [
        F.struct(F.lit(c).alias("class"), F.lit(m).alias("metric"), F.col("r")[c][k].alias("value"))
        for c in [*classes, "macro avg", "weighted avg"]
        for m, k in {**JSON_KEYS, "support": "support"}.items()
    ]
    rows.append(
        F.struct(F.lit("accuracy").alias("class"), F.lit("accuracy").alias("metric"), F.col("r.accuracy").alias("value"))
    )
    return parsed.select(*by, F.inline(F.array(*rows)))


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Errors, predictions, metrics and comparison tables as files."""
    writer = df.write
    if fmt == "csv":
        writer = writer.options(header=True, escape='"')
    writer.format(fmt).save(path)
