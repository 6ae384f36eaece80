"""Shards by jump consistent hashing. DataFrame functions only.

The shard of a key is computed, not looked up: a 64-bit generator seeded by
the key jumps through bucket numbers, and the last one below the shard count
is the shard. With one shard more, a key either stays or moves to the new
shard, so about ``1 / (n + 1)`` of the rows move. There is no ring table and
nothing to broadcast.

The generator's multiplication is done modulo 2**64 on two 32-bit halves,
because SQL integers raise an error on overflow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

# Fixed values of the published generator.
MULTIPLIER = 2862933555777941757
SPAN = 2147483648.0

MAX_JUMPS = 256  # a key jumps ln(n) times on average; 2**31 shards expect 22
LOW32 = 0xFFFFFFFF
M_HIGH, M_LOW = MULTIPLIER >> 32, MULTIPLIER & LOW32
M_LOW_HIGH, M_LOW_LOW = M_LOW >> 16, M_LOW & 0xFFFF


def _mask(c: Column, bits: int) -> Column:
    return c.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _times_low(half: Column) -> tuple[Column, Column]:
    return half * F.lit(M_LOW_HIGH).cast("long"), half * F.lit(M_LOW_LOW).cast("long")


def _step(high: Column, low: Column) -> tuple[Column, Column]:
    """key * MULTIPLIER + 1 modulo 2**64; no intermediate leaves 63 bits."""
    low_a, low_b = _times_low(low)
    high_a, high_b = _times_low(high)
    bottom = F.shiftleft(_mask(low_a, 16), 16) + low_b + F.lit(1).cast("long")
    carry = F.shiftright(bottom, 32) + F.shiftright(low_a, 16)
    top = carry + _mask(low * F.lit(M_HIGH).cast("long"), 32) + F.shiftleft(_mask(high_a, 16), 16) + high_b
    return _mask(top, 32), _mask(bottom, 32)


def halves(df: DataFrame, key: str) -> tuple[Column, Column]:
    """64 bits of a key as two halves: an integer as it is, else a digest of its text.

    A null key counts as 0.
    """
    if isinstance(df.schema[key].dataType, IntegralType):
        k = F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long"))
        return F.shiftrightunsigned(k, 32), _mask(k, 32)
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return half(1), half(9)


def jump(high: Column, low: Column, shards: int) -> Column:
    """Shard of a key given as two 32-bit halves."""
    if shards < 1:
        raise ValueError("at least one shard")

    def target(state: Column) -> Column:
        draw = (F.shiftright(state["high"], 1) + 1).cast("double")
        return F.floor((state["at"] + 1).cast("double") * (F.lit(SPAN) / draw))

    def advance(state: Column, _: Column) -> Column:
        new_high, new_low = _step(state["high"], state["low"])
        further = F.struct(new_high.alias("high"), new_low.alias("low"), target(state).alias("at"))
        return F.when(target(state) < shards, further).otherwise(state)

    first_high, first_low = _step(high, low)
    zero = F.lit(0).cast("long")
    start = F.struct(first_high.alias("high"), first_low.alias("low"), zero.alias("at"))
    turns = F.sequence(F.lit(1), F.lit(min(shards, MAX_JUMPS)))
    return F.aggregate(
        turns,
        start,
        advance,
        lambda last: F.when(target(last) >= shards, last["at"])
        .otherwise(F.raise_error(F.lit("more jumps than MAX_JUMPS")).cast("long"))
        .cast("int"),
    )


def shard(
    df: DataFrame, key: str, shards: int, name: str = "shard", grown: str | None = "grown_shard"
) -> DataFrame:
    """Add the shard of every row, and with ``grown`` its shard if there were one more.

    All rows and all other columns stay; a column that already has one of the
    two names is replaced. Rows with equal keys share a shard, so repeated
    rows stay together. A null key counts as 0.
    """
    high, low = halves(df, key)
    out = {name: jump(high, low, shards)}
    if grown:
        out[grown] = jump(high, low, shards + 1)
    return df.withColumns(out)


def with_slots(
    df: DataFrame, key: str, by: str = "shard", name: str = "slot", per_bucket: int = 100_000
) -> DataFrame:
    """Number the rows of every shard 0, 1, 2, ... in a scattered, repeatable order.

    The order is that of a digest of the key, which also mixes the sources of
    a training shard. One window over a whole shard would be one task, so the
    leading digits of the digest cut it into buckets of about ``per_bucket``
    rows: bucket sizes are summed first and each bucket is numbered on its
    own. The digits follow the row count and do not change the numbers, as
    they are a prefix of the order. Rows with equal keys are ordered by their
    other columns; rows equal in all of them are alike, so any order is the same.
    """
    digits = 1
    rows = df.select(F.lit(1)).count()
    while 16**digits * per_bucket < rows:
        digits += 1
    columns = [c for c in df.columns if c != name]
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    keyed = df.select(
        F.struct(*columns).alias("row"), F.col(by).alias("by"), digest.alias("digest"), F.col(key).alias("key")
    ).withColumn("bucket", F.substring("digest", 1, digits))
    before = Window.partitionBy("by").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy("by", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    inside = Window.partitionBy("by", "bucket").orderBy("digest", "key", "row")
    return (
        keyed.join(starts, ["by", "bucket"])
        .withColumn("slot", (F.col("start") + F.row_number().over(inside) - 1).cast("long"))
        .select("row.*", F.col("slot").alias(name))
    )


def write_shards(df: DataFrame, path: str, by: str = "shard", order: str = "slot") -> None:
    """One folder per shard, each file in slot order.

    A shard is written by as many tasks as hold rows of it, so a large shard
    is several files and never one task.
    """
    df.sortWithinPartitions(by, order).write.partitionBy(by).parquet(path)
