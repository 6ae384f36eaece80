"""Small building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tocsin.functions.keys import seeded_key

MAX_LOOKUP_ROWS = 100_000  # a lookup handed over as Python rows is broadcast only up to here


def snake(name: str) -> str:
    return name.replace(" ", "_").lower()


def lookup(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Dimension table from driver-side rows; broadcast up to a checked number, else joined like any table."""
    table = spark.createDataFrame(list(rows), schema)
    return F.broadcast(table) if len(rows) <= MAX_LOOKUP_ROWS else table


def class_dim(spark: SparkSession, classes: Sequence[str]) -> DataFrame:
    return lookup(spark, [(i, c) for i, c in enumerate(classes)], "class_id int, target_label string")


def names(classes: Sequence[str]) -> Column:
    return F.array(*[F.lit(c) for c in classes])


def top_n_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, salts: int = 64
) -> DataFrame:
    """First ``n`` rows of every group, however large a group is.

    Up to the group-limit threshold Spark trims each input partition to ``n``
    rows per group before the shuffle. Beyond it the trimming is done here:
    a group is split over salts, each salt keeps its own first ``n``, and only
    those rows meet in one task. Both ways are exact.
    """
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")):
        salted = Window.partitionBy(*by, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
            .withColumn("_rn", F.row_number().over(salted))
            .filter(F.col("_rn") <= n)
            .drop("_rn", "_salt")
        )
    ranked = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(ranked)).filter(F.col("rn") <= n)


def with_ordinal(
    df: DataFrame,
    key: Sequence[str],
    seed: int | str,
    by: Sequence[str] = (),
    name: str = "ord",
    hex_digits: int = 3,
) -> DataFrame:
    """Number rows 0, 1, 2, ... in seeded random order, inside ``by`` groups.

    A plain ``row_number`` would move a whole group into one task. The seeded
    key is uniform, so its leading hex digits cut every group, hot or not,
    into equal buckets; bucket counts are summed up front and each bucket is
    numbered on its own. ``key`` must identify a row.
    """
    keyed = df.withColumn("_key", seeded_key(seed, *key)).withColumn(
        "_bucket", F.substring("_key", 1, hex_digits)
    )
    sizes = keyed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    # At most 16**hex_digits rows per group: bounded whatever the data size.
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        *[F.col(c).alias(f"_by_{c}") for c in by],
        F.col("_bucket").alias("_start_bucket"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy("_key", *key)
    match = keyed["_bucket"] == starts["_start_bucket"]
    for c in by:
        match = match & keyed[c].eqNullSafe(starts[f"_by_{c}"])
    return (
        keyed.join(starts if by else F.broadcast(starts), match)
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .select(*df.columns, name)
    )
