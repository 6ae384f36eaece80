"""Raw label to class mapping, class ids, message preparation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.constants import CLASSES, LABEL_MAP
from tocsin.functions.text import clean_text, clean_word_count
from tocsin.operators.tables import class_dim, lookup


def mapping_table(df: DataFrame, mapping: Mapping[str, str] | DataFrame) -> DataFrame:
    """A dict becomes a broadcast table; a DataFrame is left to Catalyst."""
    if isinstance(mapping, DataFrame):
        return mapping
    return lookup(df.sparkSession, list(mapping.items()), "raw_label string, target_label string")


def map_labels(df: DataFrame, mapping: Mapping[str, str] | DataFrame = LABEL_MAP) -> DataFrame:
    """Add ``target_label``; null where the raw label is not in the mapping."""
    return df.join(mapping_table(df, mapping), "raw_label", "left")


def unmapped_labels(df: DataFrame, mapping: Mapping[str, str] | DataFrame = LABEL_MAP) -> DataFrame:
    """Rows per raw label that the mapping does not know, nulls included."""
    return (
        df.join(mapping_table(df, mapping), "raw_label", "left_anti")
        .groupBy("raw_label")
        .agg(F.count("*").alias("n_rows"))
    )


def mapping_summary(df: DataFrame) -> DataFrame:
    """Rows per (raw, target) pair that did map."""
    return (
        df.filter(F.col("target_label").isNotNull())
        .groupBy("raw_label", "target_label")
        .agg(F.count("*").alias("n_rows"))
    )


def encode_label(
    df: DataFrame, classes: Sequence[str] = CLASSES, col: str = "target_label", out: str = "label"
) -> DataFrame:
    """Class name to its position in the canonical list."""
    dim = class_dim(df.sparkSession, classes).toDF(out, col)
    return df.join(dim, col, "left")


def decode_label(
    df: DataFrame, classes: Sequence[str] = CLASSES, col: str = "label", out: str = "target_label"
) -> DataFrame:
    """Class position back to its name."""
    dim = class_dim(df.sparkSession, classes).toDF(col, out)
    return df.join(dim, col, "left")


def split_rows(df: DataFrame, name: str) -> DataFrame:
    """Rows of one split; prunes directories when ``split`` is a partition column."""
    return df.filter(F.col("split") == name)


def add_clean_text(df: DataFrame, col: str = "text", keep_marks: bool = False) -> DataFrame:
    """Add ``clean_text`` and drop rows that are empty after cleaning.

    Cleaning and dropping are one generator over a list of zero or one
    values. A filter on the cleaned column would be pushed below the
    projection and run every regular expression a second time.
    """
    kept = F.filter(F.array(clean_text(col, keep_marks)), lambda t: t != "")
    return df.select("*", F.explode(kept).alias("clean_text"))


def drop_empty(df: DataFrame, col: str = "clean_text") -> DataFrame:
    """Drop rows whose text is null or blank."""
    return df.filter(F.trim(F.col(col)) != "")


def add_lengths(df: DataFrame, col: str = "clean_text") -> DataFrame:
    """Add ``text_length`` in characters and ``word_count`` of cleaned text."""
    return df.select(
        "*", F.length(col).alias("text_length"), clean_word_count(col).alias("word_count")
    )


def prepare_messages(df: DataFrame, mapping: Mapping[str, str] | DataFrame) -> DataFrame:
    """Map, clean, drop empties, measure: one narrow stage and one broadcast."""
    return add_lengths(add_clean_text(map_labels(df, mapping)))
