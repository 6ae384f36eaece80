"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.llm import pieces, quality, toxicity
from tocsin.llm.alignment import align
from tocsin.llm.cap_filters import near_vectors
from tocsin.llm.dual_tree import search
from tocsin.llm.line_dedup import drop_repeated_lines
from tocsin.llm.oracles import ORACLES
from tocsin.llm.packing import pack
from tocsin.llm.sharding import shard, with_slots
from tocsin.llm.simhash import near_duplicates
from tocsin.llm.top_k import top_k
from tocsin.llm.url_filter import Rule, judge
from tocsin.llm.warc import read_archives, write_archives
from tocsin.llm.workers import prepare_workers
from tocsin.session import scratch_path

SHARDS = 8
URL_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    prepare_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, chance of a readable text and decision for every document."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    labels = _read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    train = labels.filter(~toxicity.held_out(F.col("doc_id")))
    model = quality.fit(docs, train, quality.graded(F.col("quality"), F.col("toxic")))
    return quality.judge(docs, model).drop("text")


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all vectors at cosine 0.98 within their label."""
    return near_vectors(_read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of ids, spans and decoded text of every document."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    done = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.crc32("spans").alias("spans_crc32"),
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page by rules, else by the exact list of bad hosts."""
    return judge(_read(spark, sf_dir, "pages", "page_id", "url"), URL_RULES).drop("url")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length; each is a sequence of its own, so it starts at 0."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard, slot and next shard of every document by its id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _read(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return with_slots(shard(docs, "doc_id", SHARDS), "doc_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    return near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best five rows of every vector whose id is divisible by 50."""
    vectors = _read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines that an earlier one holds."""
    kept = drop_repeated_lines(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256")
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision for every document; the model never sees the held-out third's labels."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tokens that end together, and how usual the linked pairs are, for every document."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return align(docs, *paths).withColumn("groups_sha256", digest).drop("groups")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty best documents of every benchmark item."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return search(docs, _read(spark, sf_dir, "benchmark", "item_id", "text"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    path = scratch_path(spark, "warc")
    write_archives(_read(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return read_archives(spark, path).select(
        F.col("key").cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


QUERIES = {
    "op1_quality": op1_quality,
    "op2_near_vectors": op2_near_vectors,
    "op3_pieces": op3_pieces,
    "op4_url_filter": op4_url_filter,
    "op5_packing": op5_packing,
    "op6_sharding": op6_sharding,
    "op7_simhash": op7_simhash,
    "op8_top_k": op8_top_k,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_alignment": op11_alignment,
    "op12_lexical_search": op12_lexical_search,
    "op13_warc": op13_warc,
}

__all__ = ["ORACLES", "QUERIES"]
