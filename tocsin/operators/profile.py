"""Profiling of a labelled message table.

Class reports use one row of conditional counts, unpivoted afterwards: each
task sends a single row to the shuffle, a class with no rows keeps its zero,
and a class that holds most of the data costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tocsin.constants import CLASSES, SPLITS, STOP_WORDS
from tocsin.operators.tables import class_dim, snake, top_n_per_group
from tocsin.session import materialize


def _is(c: str) -> Column:
    return F.col("target_label") == c


def _unpivot_classes(wide: DataFrame, classes: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row of ``<measure>_<i>`` columns to one row per class."""
    rows = [
        F.struct(
            F.lit(i).alias("class_id"),
            F.lit(c).alias("target_label"),
            *[F.col(f"{m}_{i}").alias(m) for m in measures],
        )
        for i, c in enumerate(classes)
    ]
    extra = [c for c in wide.columns if not any(c.startswith(f"{m}_") for m in measures)]
    return wide.select(*extra, F.inline(F.array(*rows)))


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows, rows per event set and split, distinct events."""
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("event_set") == "set1").alias("n_set1"),
        F.count_if(F.col("event_set") == "set2").alias("n_set2"),
        F.countDistinct("event").alias("n_events"),
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in SPLITS],
    )


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column, in one pass."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "n_null")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, most frequent first."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n_rows"))
    return counts.orderBy(F.desc("n_rows"), col)


def class_distribution(df: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Count and percent of all rows per class, in canonical order."""
    wide = df.agg(
        F.count("*").alias("total"),
        *[F.count_if(_is(c)).alias(f"n_rows_{i}") for i, c in enumerate(classes)],
    )
    share = F.coalesce(F.try_divide(F.col("n_rows") * 100.0, F.col("total")), F.lit(0.0))
    return _unpivot_classes(wide, classes, ["n_rows"]).select(
        "class_id", "target_label", "n_rows", F.round(share, 6).alias("pct")
    )


def imbalance(df: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Largest class against each class; marks the rarest and the commonest."""
    dist = class_distribution(df, classes)
    everything = Window.partitionBy()  # one row per class
    first = Window.orderBy("n_rows", "class_id")
    last = Window.orderBy(F.desc("n_rows"), "class_id")
    return dist.select(
        "target_label",
        "n_rows",
        F.round(F.try_divide(F.max("n_rows").over(everything), F.col("n_rows")), 6).alias("ratio"),
        (F.row_number().over(first) == 1).alias("is_rarest"),
        (F.row_number().over(last) == 1).alias("is_commonest"),
    )


def length_stats(
    df: DataFrame, col: str = "word_count", classes: Sequence[str] = CLASSES
) -> DataFrame:
    """Mean, sample deviation, minimum, median, maximum per class, one decimal.

    The exact median keeps one counter per distinct length, which is bounded
    by the longest text and combines before the shuffle.
    """
    stats = df.groupBy("target_label").agg(
        F.bround(F.avg(col), 1).alias("mean"),
        F.bround(F.stddev_samp(col), 1).alias("std"),
        F.min(col).alias("min"),
        F.bround(F.percentile(col, F.lit(0.5)), 1).alias("median"),
        F.max(col).alias("max"),
    )
    return class_dim(df.sparkSession, classes).join(stats, "target_label", "left")


def length_histogram(
    df: DataFrame, col: str, bins: int, classes: Sequence[str] = CLASSES
) -> DataFrame:
    """Equal-width histogram over each class's own range, empty bins kept."""
    rows = df.filter(F.col("target_label").isin(list(classes)))
    # Written: a row per class and length, from which both the range and the bins are read.
    lengths = rows.groupBy("target_label", F.col(col).alias("value")).agg(F.count("*").alias("n"))
    lengths = materialize(lengths, "lengths")
    lo, hi = F.min("value").cast("double"), F.max("value").cast("double")
    # A single distinct length gets a unit-wide range around it.
    ranges = lengths.groupBy("target_label").agg(
        F.when(lo == hi, lo - 0.5).otherwise(lo).alias("lo"),
        F.when(lo == hi, hi + 0.5).otherwise(hi).alias("hi"),
    )
    place = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins
    counts = (
        lengths.join(F.broadcast(ranges), "target_label")  # at most one row per class
        .select("target_label", "n", F.least(F.floor(place), F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("target_label", "bin")
        .agg(F.sum("n").alias("n_rows"))
    )
    width = (F.col("hi") - F.col("lo")) / bins
    return (
        ranges.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        .join(F.broadcast(counts), ["target_label", "bin"], "left")  # classes x bins rows
        .select(
            "target_label",
            "bin",
            F.round(F.col("lo") + F.col("bin") * width, 6).alias("bin_start"),
            F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        )
    )


def event_class_crosstab(
    df: DataFrame, normalize: bool = False, classes: Sequence[str] = CLASSES
) -> DataFrame:
    """Event by class counts, or shares of each event's row."""
    table = (
        df.filter(F.col("target_label").isin(list(classes)))
        .groupBy("event")
        .agg(*[F.count_if(_is(c)).alias(snake(c)) for c in classes])
    )
    if not normalize:
        return table
    total = sum((F.col(snake(c)) for c in classes), F.lit(0))
    return table.select("event", *[F.round(F.col(snake(c)) / total, 6).alias(snake(c)) for c in classes])


def content_words(df: DataFrame, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """One row per word longer than two characters that is no stop word."""
    return (
        df.select("target_label", F.explode(F.split("clean_text", " ")).alias("word"))
        .filter((F.length("word") > 2) & ~F.col("word").isin(list(stop_words)))
    )


def top_words(
    df: DataFrame, k: int = 20, classes: Sequence[str] = CLASSES, stop_words: Sequence[str] = STOP_WORDS
) -> DataFrame:
    """Most frequent content words of every class; ties go to the smaller word."""
    counts = (
        content_words(df.filter(F.col("target_label").isin(list(classes))), stop_words)
        .groupBy("target_label", "word")
        .agg(F.count("*").alias("n_rows"))
    )
    return top_n_per_group(counts, ["target_label"], [F.desc("n_rows"), F.asc("word")], k)


def split_balance(df: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Train and test counts side by side, percent to one decimal."""
    sides = ["train", "test"]
    wide = df.agg(
        *[
            F.count_if(_is(c) & (F.col("split") == s)).alias(f"{s}_{i}")
            for i, c in enumerate(classes)
            for s in sides
        ]
    )
    everything = Window.partitionBy()  # one row per class
    return _unpivot_classes(wide, classes, sides).select(
        "target_label",
        *[F.col(s).alias(f"{s}_count") for s in sides],
        *[
            F.bround(F.try_divide(F.col(s) * 100.0, F.sum(s).over(everything)), 1).alias(f"{s}_pct")
            for s in sides
        ],
    )


def counts_side_by_side(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Rows per value in two tables, aligned on the value; absent ones null."""
    left = a.groupBy(col).agg(F.count("*").alias("n_a"))
    right = b.groupBy(col).agg(F.count("*").alias("n_b"))
    return left.join(right, col, "full_outer")


def empty_audit(df: DataFrame, clean: Column) -> DataFrame:
    """How many rows a cleaning expression leaves empty."""
    return df.select((clean == "").alias("empty")).agg(
        F.count("*").alias("n_rows"),
        F.count_if("empty").alias("n_dropped"),
        F.count_if(~F.col("empty")).alias("n_kept"),
    )


def augmentation_summary(df: DataFrame, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Class counts and shares of an augmented table, with real and generated totals."""
    wide = df.agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("is_synthetic")).alias("real"),
        F.count_if(F.col("is_synthetic")).alias("synthetic"),
        *[F.count_if(_is(c)).alias(f"n_rows_{i}") for i, c in enumerate(classes)],
    )
    share = F.coalesce(F.try_divide(F.col("n_rows") * 100.0, F.col("total")), F.lit(0.0))
    return _unpivot_classes(wide, classes, ["n_rows"]).select(
        "target_label", "n_rows", F.round(share, 6).alias("pct"), "total", "real", "synthetic"
    )


def class_weights(df: DataFrame, col: str = "target_label") -> DataFrame:
    """Balanced weight ``n / (k * n_c)`` of every class that occurs."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n_rows"))
    everything = Window.partitionBy()  # one row per class
    weight = F.sum("n_rows").over(everything) / (F.count("*").over(everything) * F.col("n_rows"))
    return counts.select(col, "n_rows", weight.alias("weight"))


def sample_weights(df: DataFrame, col: str = "target_label", classes: Sequence[str] = CLASSES) -> DataFrame:
    """Attach each row's class weight."""
    known = df.filter(F.col(col).isin(list(classes)))
    weights = class_weights(known, col).select(col, "weight")
    return known.join(F.broadcast(weights), col)  # one row per known class


def mean_sample_weight(df: DataFrame, col: str = "target_label", classes: Sequence[str] = CLASSES) -> DataFrame:
    """Mean row weight per class."""
    return sample_weights(df, col, classes).groupBy(col).agg(F.round(F.avg("weight"), 6).alias("mean_weight"))
