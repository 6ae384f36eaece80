"""From raw documents to training sequences, stage by stage.

Every stage works on all that its predecessor kept and its decisions take
effect. Between stages the table has the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.llm import line_dedup, packing, quality, simhash, toxicity
from tocsin.llm.workers import prepare_workers
from tocsin.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare_workers(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.filter(~toxicity.held_out(F.col("doc_id")))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of toxicity."""
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    return toxicity.score(docs, model).filter(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def reject_junk(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are readable more likely than not."""
    grade = quality.graded(F.col("quality"), F.col("toxic"))
    model = quality.fit(docs, _labels(spark, sf_dir), grade)
    return quality.judge(docs, model).filter("kept").select(*docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one holds; lengths follow."""
    prepare_workers(spark)
    kept = line_dedup.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints: four-word shingles, at most four differing bits."""
    prepare_workers(spark)
    return simhash.drop_near_duplicates(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length, each from one document."""
    prepare_workers(spark)
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("quality", reject_junk),
    ("line_dedup", cut_repeated_lines),
    ("simhash", keep_one_of_each),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # models, fingerprints and tokenizers are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
