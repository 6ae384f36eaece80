"""The given tables seen as the message model.

``documents`` and ``labels`` become labelled messages, documents also serve
as generated rows, and ``embeddings`` give predictions of two nearest-centroid
models.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.constants import CLASSES
from tocsin.functions.vectors import class_name, dot
from tocsin.operators.embeddings import centroid_scores, centroids
from tocsin.operators.experiments import labelled
from tocsin.operators.labels import prepare_messages
from tocsin.session import scratch_path, spread
from tocsin.sources.messages import write_messages_bucketed

LANGS = ["de", "en", "es", "fr"]
N_VECTOR_LABELS = 10
EXPERIMENTS = [
    ("long_7", "long", 7),
    ("short_18", "short", 18),
    ("example_29", "example", 29),
    ("long_36", "long", 36),
]


def label_map() -> dict[str, str]:
    """Raw label ``lang_quality_toxic`` to class; ``fr_0_1`` is left out on purpose."""
    out = {}
    for lang in LANGS:
        out[f"{lang}_1_0"] = "Situational Awareness" if lang == "en" else "Volunteering and Donations"
        out[f"{lang}_1_1"] = "Critical Rescue"
        if lang != "fr":
            out[f"{lang}_0_1"] = "Resource Requests"
        out[f"{lang}_0_0"] = "Irrelevant"
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Chosen columns, spread over the cores if the scan is narrow."""
    return spread(table(spark, sf_dir, "documents").select(*cols), "doc_id")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text, event, lang, event_set, split, raw_label``."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    labels = table(spark, sf_dir, "labels")
    digit = F.col("doc_id") % 10
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        "text",
        F.col("source").alias("event"),
        "lang",
        F.when(F.col("lang") == "en", "set1").otherwise("set2").alias("event_set"),
        F.when(digit == 0, "dev").when(digit.isin(1, 2), "test").otherwise("train").alias("split"),
        F.concat("lang", F.lit("_"), F.col("quality"), F.lit("_"), F.col("toxic")).alias("raw_label"),
    )


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped, cleaned and measured messages."""
    return prepare_messages(messages(spark, sf_dir), label_map())


def processed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written by split in buckets of the id and read back: the input of model building.

    Later steps read a split several times and count its rows, which costs
    nothing on files and a second cleaning otherwise; features group by
    document, which costs no shuffle on buckets.
    """
    path = scratch_path(spark, "processed")
    df = processed(spark, sf_dir)
    columns = ["doc_id", "raw_label", "target_label", "event", "event_set", "lang",
               "clean_text", "text_length", "word_count", "split"]
    return write_messages_bucketed(df.select(*columns), path)


def split_of(df: DataFrame, *splits: str) -> DataFrame:
    return labelled(df.filter(F.col("split").isin(*splits)))


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as generated rows: ``arrival, call_id, text``."""
    return documents(spark, sf_dir, "doc_id", "text").select(
        F.col("doc_id").alias("arrival"), F.floor(F.col("doc_id") / 10).alias("call_id"), "text"
    )


def centroid_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' predictions: ``model, doc_id, y_true, y_pred, proba``.

    Vector label modulo five names the class; a class scores as its better label.
    """
    vectors = table(spark, sf_dir, "embeddings")
    cents = centroids(vectors)
    scored = centroid_scores(vectors, cents)
    norm2 = dot(F.col("embedding"), F.col("embedding"))
    with_norm = cents.withColumn("norm2", dot(F.col("centroid"), F.col("centroid"))).withColumn(
        "norm", F.sqrt("norm2")
    )
    norms = with_norm.agg(
        F.array_sort(F.collect_list(F.struct("label", "norm2", "norm"))).alias("v")  # one entry per label
    ).scalar()
    rows = scored.withColumns({"_n2": norm2, "_norms": norms}).withColumn(
        "_euclid",
        # -|v - c|^2, from the cosine and both lengths
        F.zip_with(
            "scores",
            "_norms",
            lambda s, n: 2 * s["similarity"] * F.sqrt("_n2") * n["norm"] - F.col("_n2") - n["norm2"],
        ),
    ).withColumn("_cosine", F.transform("scores", lambda s: s["similarity"]))
    k = len(CLASSES)

    def per_class(scores: str) -> Column:
        return F.array(
            *[F.greatest(*[F.get(scores, F.lit(i)) for i in range(c, N_VECTOR_LABELS, k)]) for c in range(k)]
        )

    models = F.array(
        *[
            F.struct(F.lit(m).alias("model"), per_class(f"_{m}").alias("proba"))
            for m in ("cosine", "euclid")
        ]
    )
    best = F.array_position("proba", F.array_max("proba")).cast("int") - 1
    return rows.select("vec_id", "label", F.inline(models)).select(
        "model",
        F.col("vec_id").alias("doc_id"),
        class_name(F.col("label") % k, CLASSES).alias("y_true"),
        class_name(best, CLASSES).alias("y_pred"),
        "proba",
    )


def answers(df: DataFrame, experiments: Sequence[tuple[str, str, int]] = EXPERIMENTS) -> DataFrame:
    """Free-text answers to labelled messages, one per experiment.

    By document and seed: the class itself, another class inside a sentence,
    an answer that names no class, or a failed call.
    """
    k = len(CLASSES)
    runs = F.array(
        *[
            F.struct(F.lit(n).alias("experiment"), F.lit(s).alias("strategy"), F.lit(seed).alias("seed"))
            for n, s, seed in experiments
        ]
    )
    kind = (F.col("doc_id") + F.col("seed")) % 4
    own = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("target_label"))
    other = class_name(((own + F.col("seed")) % k).cast("int"), CLASSES)
    return df.select("doc_id", "target_label", "clean_text", F.inline(runs)).withColumn(
        "response",
        F.when(kind == 0, F.col("target_label"))
        .when(kind == 1, F.concat(F.lit("I think: "), F.lower(other)))
        .when(kind == 2, F.lit("no idea"))
        .otherwise("ERROR"),
    )


# Letters a to z as Malayalam: vowels as signs, x as virama, y as joiner, w as a joined letter.
LATIN = "abcdefghijklmnopqrstuvwxyz"
AS_MALAYALAM = "ാബചദെഫഗഹിജകലമനൊപംരസതുവൻ്\u200dഴ"
