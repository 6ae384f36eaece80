"""Search against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import compare, duck
from tests.conftest import SF
from tocsin.llm import top_k as module
from tocsin.llm.queries import ORACLES, QUERIES
from tocsin.llm.top_k import top_k


def brute(rows, k, scale=256):
    """{(query, rank): (id, score)} with integers of any size."""
    from math import floor

    usable = [
        (i, [floor(scale * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v and None not in v and np.isfinite(v).all()
    ]
    out = {}
    for i, v in usable:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in usable if j != i and len(w) == len(v))
            out |= {(i, r): (j, -s) for r, (s, j) in enumerate(scores[:k], 1)}
    return out


def found(df, **more):
    rows = top_k(df, F.col("vec_id") % 50 == 0, **more).collect()
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in rows}
    assert len(got) == len(rows)
    return got


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "vec_id long, embedding array<float>, ids string, longest double")


def test_query_matches_sql(spark):
    assert compare(QUERIES["op8_top_k"](spark, SF), duck(SF), ORACLES["op8_top_k"]) == ""


@pytest.mark.parametrize("kind", ["lengths", "cosines", "ties", "small"])
def test_prunings(spark, monkeypatch, kind):
    """Buckets and blocks small enough that many are skipped or cut by coordinates."""
    monkeypatch.setattr(module, "BUCKET", 16)
    monkeypatch.setattr(module, "QUERY_BLOCK", 3)
    monkeypatch.setattr(module, "GROUP", 2)
    monkeypatch.setattr(module, "PART", 2)
    draw = np.random.default_rng(5)
    x = draw.standard_normal((600, 6))
    if kind == "lengths":
        x *= np.exp(draw.normal(0, 2, (600, 1)))
    elif kind == "cosines":
        x = x[draw.integers(0, 20, 600)] + 0.02 * draw.standard_normal((600, 6))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    elif kind == "ties":
        x = np.round(x[draw.integers(0, 4, 600)])
    else:
        x *= 1e-3
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(draw.permutation(600), x)]
    assert found(frame(spark, rows)) == brute(rows, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (50, [0.0, 0.0]), (100, None), (150, []), (200, [nan, 1.0]), (250, [1.0, None]), (300, [1.0, inf]),
        (1, [1.0, -1.0]), (2, [1.0, -1.0]), (3, [-0.001, 5.0]), (None, [9.0, 9.0]), (4, [7.0, 7.0, 7.0]), (350, [1.0, 1.0, 1.0]),
        (400, [1e6, 2.0]), (5, [1e5, -3.0]),
    ]
    assert found(frame(spark, rows)) == brute(rows, 5)
    assert found(frame(spark, rows), k=2) == brute(rows, 2)
    assert found(frame(spark, rows).limit(0)) == {}
    assert found(frame(spark, [(0, [1.0])])) == {}
    assert found(frame(spark, [(1, [1.0]), (2, [1.0])])) == {}


def test_repeated_rows(spark):
    rows = [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [0.0, 2.0])]
    got = found(frame(spark, rows))
    assert got == {(0, 1): (7, 131072), (0, 2): (7, 131072), (0, 3): (8, 131072)}
