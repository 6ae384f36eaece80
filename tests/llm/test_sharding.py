"""Jump hashing against the published loop, and the law of growing."""

import zlib

from pyspark.sql import functions as F

from tests.conftest import SF
from tocsin.llm.queries import QUERIES
from tocsin.llm.sharding import shard, with_slots, write_shards


def jump(key, n):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_are_those_of_the_loop(spark):
    keys = [*range(300), -1, -7, 2**63 - 1, -(2**63), 2**40 + 5]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 2, 8, 700):
        rows = shard(df, "k", n).collect()
        assert all(r.shard == jump(r.k, n) and r.grown_shard == jump(r.k, n + 1) for r in rows)


def test_odd_rows(spark):
    schema = "k string, shard string, slot int"
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 1), (None, None, None), ("", "y", 2), ("ü" * 50_000, "z", 3)], schema)
    out = with_slots(shard(df, "k", 3), "k").collect()
    assert len(out) == 5
    assert len({r.shard for r in out if r.k == "a"}) == 1
    for s in {r.shard for r in out}:
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    assert with_slots(shard(df.limit(0), "k", 3), "k").collect() == []


def test_slots_do_not_depend_on_buckets(spark):
    df = shard(spark.range(500).withColumnRenamed("id", "k"), "k", 4)
    coarse = {r.k: r.slot for r in with_slots(df, "k").collect()}
    assert coarse == {r.k: r.slot for r in with_slots(df, "k", per_bucket=1).collect()}


def test_written_shards(spark, tmp_path):
    df = with_slots(shard(spark.range(100).withColumnRenamed("id", "k"), "k", 4), "k")
    write_shards(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.k, r.shard) for r in back.collect()} == {(r.k, r.shard) for r in df.collect()}


def test_query(spark):
    rows = QUERIES["op6_sharding"](spark, SF).collect()
    text = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(text)
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len(text[r.doc_id]) + 1, zlib.crc32(text[r.doc_id]), "key")
        assert r.shard == jump(r.doc_id, 8)
        assert r.grown_shard in (r.shard, 8)
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op6_sharding"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert spark.range(1).select(F.lit(1)).count() == 1
