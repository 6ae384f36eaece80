"""The keyed permutation is one to one at every size, and needs no other row."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tocsin.functions.permutation import permuted
from tocsin.plans.queries import QUERIES


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 37, 64, 99, 101, 1000, 1023, 4999])
def test_bijection(spark, n):
    rows = spark.range(n).select("id", permuted(F.col("id"), F.lit(n).cast("long"), 7).alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(n))
    if n > 30:
        assert sum(r.id == r.p for r in rows) < 10  # a shuffled order, not the old one
        other = spark.range(n).select("id", permuted(F.col("id"), F.lit(n).cast("long"), 8).alias("p")).collect()
        assert {r.id: r.p for r in rows} != {r.id: r.p for r in other}


def test_outside(spark):
    df = spark.createDataFrame([(None,), (-1,), (5,), (9,)], "i long")
    assert [r[0] for r in df.select(permuted(F.col("i"), F.lit(5).cast("long"), 1)).collect()] == [None] * 4


def test_plan(spark):
    plan = QUERIES["D3_permute"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "hashpartitioning" not in plan
