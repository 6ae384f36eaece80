"""Message readers and the processed table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.constants import SPLITS
from tocsin.operators.tables import lookup
from tocsin.session import write_bucketed

RAW_SCHEMA = "tweet_id LONG, tweet_text STRING, class_label STRING"
MESSAGE_SCHEMA = (
    "doc_id LONG, text STRING, raw_label STRING, target_label STRING, event STRING, event_set STRING, "
    "lang STRING, clean_text STRING, text_length INT, word_count INT, split STRING"
)
# .../events_set1/<event>/<event>_<split>.tsv, or the same written by Spark
# with event_set=<set>/file=<event>_<split>.tsv directories.
FILE_PATTERN = r"/(?:file=)?([^/=]+)_(train|dev|test)\.tsv(?:/|$)"
SET_PATTERN = r"(?:events_|event_set=)(set\d+)"


def read_messages_tsv(spark: SparkSession, root: str) -> DataFrame:
    """Every message file below ``root`` in one scan.

    Tab-separated with a header and no quoting, so stray quotes stay text.
    Event, split and event set come from the file path; files whose path
    names no split are not messages and are left out.
    """
    path = F.col("_metadata.file_path")
    return (
        spark.read.schema(RAW_SCHEMA)
        .options(sep="\t", quote="", header=True, recursiveFileLookup=True, pathGlobFilter="*.{tsv,csv}")
        .csv(root)
        .select(
            "*",
            F.regexp_extract(path, FILE_PATTERN, 1).alias("event"),
            F.regexp_extract(path, FILE_PATTERN, 2).alias("split"),
            F.regexp_extract(path, SET_PATTERN, 1).alias("event_set"),
        )
        .filter(F.col("split") != "")
    )


def as_messages(raw: DataFrame, lang: str = "en") -> DataFrame:
    """Raw file columns to the message schema."""
    return raw.select(
        F.col("tweet_id").alias("doc_id"),
        F.col("tweet_text").alias("text"),
        F.col("class_label").alias("raw_label"),
        "event",
        "event_set",
        "split",
        F.lit(lang).alias("lang"),
    )


def write_messages_tsv(df: DataFrame, path: str) -> None:
    """Write a message table in the raw layout; tabs and line ends become blanks."""
    one_line = F.regexp_replace("text", r"[\t\r\n]+", " ")
    df.select(
        F.col("doc_id").alias("tweet_id"),
        one_line.alias("tweet_text"),
        F.col("raw_label").alias("class_label"),
        "event_set",
        F.concat("event", F.lit("_"), "split", F.lit(".tsv")).alias("file"),
    ).write.partitionBy("event_set", "file").options(
        sep="\t", quote="", header=True, escapeQuotes=False, emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def missing_sources(expected: Mapping[str, Sequence[str]] | DataFrame, observed: DataFrame) -> DataFrame:
    """Expected (event set, event, split) triples without rows, and unexpected ones.

    ``expected`` maps an event set to its events, or is a table
    ``(event_set, event)``; every event is expected in every split.
    """
    if not isinstance(expected, DataFrame):
        rows = [(s, e) for s, events in expected.items() for e in events]
        expected = lookup(observed.sparkSession, rows, "event_set string, event string")
    splits = F.array(*[F.lit(s) for s in SPLITS])
    wanted = expected.select("event_set", "event", F.explode(splits).alias("split"))
    key = ["event_set", "event", "split"]
    found = observed.groupBy(*key).agg(F.lit(True).alias("found"))
    return (
        wanted.withColumn("wanted", F.lit(True))
        .join(found, key, "full_outer")
        .filter(F.col("wanted").isNull() | F.col("found").isNull())
        .select(*key, F.when(F.col("found").isNull(), "missing").otherwise("unexpected").alias("status"))
    )


def write_messages(df: DataFrame, path: str) -> None:
    """Processed table as parquet, one directory per split."""
    df.write.partitionBy("split").parquet(path)


def read_messages(spark: SparkSession, path: str, schema: str = MESSAGE_SCHEMA) -> DataFrame:
    """Processed table; a filter on ``split`` reads only that directory."""
    return spark.read.schema(schema).parquet(path)


def write_messages_bucketed(df: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """Processed table in buckets of the document id, one directory per split, and read back.

    The files are those of :func:`write_messages` as well, so they can be read
    by path; what is returned knows the buckets.
    """
    return df.sparkSession.table(write_bucketed(df, path, "doc_id", "split", buckets))


def export_csv(df: DataFrame, path: str) -> None:
    """CSV copy with a header and doubled quotes."""
    df.write.options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def read_csv_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(header=True, escape='"', multiLine=True).csv(path)


def read_presplit(
    spark: SparkSession, paths: Mapping[str, str], text_col: str = "message",
    schema: str = "message STRING, clean_text STRING, target_label STRING",
) -> DataFrame:
    """One file or folder per split, tagged and brought to the message columns."""
    parts = [
        read_csv_export(spark, path, schema).withColumnRenamed(text_col, "text").withColumn("split", F.lit(split))
        for split, path in paths.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_eval_set(spark: SparkSession, path: str, lang: str = "ml") -> DataFrame:
    """Native-script test set with ``text`` and ``label`` columns."""
    rows = read_csv_export(spark, path, "text STRING, label STRING")
    return rows.select("text", F.col("label").alias("target_label"), F.lit(lang).alias("lang"))
