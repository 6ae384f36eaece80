"""Near-duplicate filter over an arriving message stream.

State holds the fingerprints seen so far. Without a watermark it grows with
the number of distinct fingerprints, so long-running streams should name an
event-time column or use the RocksDB state store, which keeps state on disk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tocsin.constants import MAX_WORDS, MIN_WORDS
from tocsin.functions.text import fingerprint
from tocsin.operators.augment import good_rows


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _cut_in_tasks(good: DataFrame) -> DataFrame:
    """Drop rows whose fingerprint the same task of the same micro-batch has met.

    Only without a watermark: a late row that is met first would cut an on-time copy.
    """

    def first_ones(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            new = []
            for mark in batch.column("fingerprint").to_pylist():
                new.append(mark not in seen)
                seen.add(mark)
            yield batch.filter(pa.array(new, pa.bool_()))

    return good.mapInArrow(first_ones, good.schema)


def dedup_stream(
    stream: DataFrame,
    text_col: str = "text",
    event_time: str | None = None,
    delay: str = "1 hour",
    min_words: int = MIN_WORDS,
    max_words: int = MAX_WORDS,
) -> DataFrame:
    """Good rows whose fingerprint has not been seen before.

    With ``event_time`` a fingerprint is forgotten once the watermark passes
    ``delay`` after it; without, it is kept for good, and copies are cut within
    every task before they go to the state, so a text that fills the stream
    arrives there once per task and micro-batch. With ``event_time`` all rows
    go there, since the watermark has to judge each by its own time.
    """
    good = good_rows(stream, text_col, min_words, max_words).withColumn("fingerprint", fingerprint("clean_text"))
    if event_time is None:
        return _cut_in_tasks(good).dropDuplicates(["fingerprint"])
    return good.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["fingerprint"])


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process all available input into parquet files, exactly once."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
