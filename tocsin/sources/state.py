"""Fitted text models on disk: plain tables, one folder per variant."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from tocsin.operators.linear import LinearModel
from tocsin.operators.scoring import TextModel

HEAD_SCHEMA = "name STRING, kind STRING, head STRING, sublinear BOOLEAN"


def save_state(spark: SparkSession, state: TextModel, path: str, variant: str = "real") -> str:
    """Write vocabulary, scaler and every model below ``path/variant``."""
    root = f"{path}/{variant}"
    state.vocab.write.parquet(f"{root}/vocab")
    state.scale.write.parquet(f"{root}/scale")
    heads = []
    for name, m in state.models.items():
        m.weights.write.parquet(f"{root}/weights/model={name}")
        head = {"intercept": m.intercept, "slope": m.slope, "offset": m.offset}
        heads.append((name, m.kind, json.dumps(head), state.sublinear))
    spark.createDataFrame(heads, HEAD_SCHEMA).write.parquet(f"{root}/heads")
    return root


def load_state(spark: SparkSession, path: str, variant: str = "real") -> TextModel:
    """Read what :func:`save_state` wrote; the scaler always comes along."""
    root = f"{path}/{variant}"
    models, sublinear = {}, True
    for row in spark.read.schema(HEAD_SCHEMA).parquet(f"{root}/heads").collect():  # one row per model
        weights = spark.read.parquet(f"{root}/weights/model={row['name']}")
        models[row["name"]] = LinearModel(row["name"], row["kind"], weights, **json.loads(row["head"]))
        sublinear = row["sublinear"]
    return TextModel(
        spark.read.parquet(f"{root}/vocab"), spark.read.parquet(f"{root}/scale"), models, sublinear
    )
