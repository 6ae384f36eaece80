"""Links and classes of vectors against all pairs."""

import numpy as np
import pytest

from tests.compare import compare, duck
from tests.conftest import SF
from tocsin.llm import cap_filters
from tocsin.llm.cap_filters import near_vectors, threshold
from tocsin.llm.queries import ORACLES, QUERIES


def all_pairs(rows, least):
    """(links, component, kept) per row of (id, label, vector); ids are not null."""
    def usable(v, label):
        return label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)

    units = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if usable(v, g) else None for _, g, v in rows]
    n = len(rows)
    link = [
        {j for j in range(n) if j != i and units[i] is not None and units[j] is not None and rows[i][1] == rows[j][1]
         and len(units[i]) == len(units[j]) and units[i] @ units[j] >= least}
        for i in range(n)
    ]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = link[todo.pop()] - seen
            seen |= new
            todo += new
        component = min(rows[j][0] for j in seen)
        out.append((len(link[i]), component, component == rows[i][0]))
    return out


def test_query_matches_sql(spark):
    assert compare(QUERIES["op2_near_vectors"](spark, SF), duck(SF), ORACLES["op2_near_vectors"]) == ""


def clusters(draw, dims, n, spread):
    centres = draw.standard_normal((n, dims))
    rows = []
    for c in centres:
        for _ in range(draw.integers(1, 12)):
            rows.append(c + spread * draw.standard_normal(dims) * np.linalg.norm(c) / np.sqrt(dims))
    return [[float(np.float32(x)) for x in r] for r in rows]


@pytest.mark.parametrize("dims,least,part", [(64, 0.98, 2048), (64, 0.98, 4), (8, 0.9, 2048), (3, 0.5, 16), (1, 0.98, 2048)])
def test_clusters(spark, monkeypatch, dims, least, part):
    """Chains at the threshold, many links per filter, few dimensions; small parts force the grid."""
    monkeypatch.setattr(cap_filters, "PART", part)
    draw = np.random.default_rng(dims)
    vectors = clusters(draw, dims, 60, np.sqrt(1 / least**2 - 1) / 1.4)
    rows = [(int(i), int(draw.integers(0, 2)), v) for i, v in zip(draw.permutation(len(vectors)), vectors)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df, min_cosine=least).collect()}
    want = all_pairs(rows, least)
    assert sum(w[0] for w in want) > 50
    assert got == {r[0]: w for r, w in zip(rows, want)}


def test_odd_rows(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.1]
    rows = [
        (1, 1, a), (2, 1, a), (3, 1, [2.0, 0.0, -0.0]), (4, 2, a), (5, None, a), (6, 1, None), (7, 1, []),
        (8, 1, [0.0, 0.0, 0.0]), (9, 1, [None, 1.0, 0.0]), (10, 1, [float("nan"), 1.0, 0.0]),
        (11, 1, [float("inf"), 1.0, 0.0]), (12, 1, b), (13, 1, [1.0, 0.0]), (14, 1, [3.0, 0.1]), (15, 1, [3e38, 0.0, 1e38 / 1e38]),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, node string, part int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect()}
    want = all_pairs(rows, 0.98)
    assert got == {r[0]: w for r, w in zip(rows, want)}
    assert near_vectors(df.limit(0)).collect() == []


def test_repeated_rows_and_null_keys(spark):
    a = [1.0, 2.0]
    df = spark.createDataFrame([(5, 1, a), (5, 1, a), (None, 1, a), (None, 2, a), (None, 2, a)], "vec_id long, label int, embedding array<float>")
    rows = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in near_vectors(df).collect())
    assert rows == [(0, 1, 0, True), (0, 1, 0, True), (0, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True)]


def test_threshold_is_the_worst_case():
    s = np.linspace(-1, 1, 201)
    angle = np.minimum(np.arccos(s) + np.arccos(0.9), np.pi)
    assert np.allclose(threshold(s, 0.9), np.cos(angle), atol=1e-6)
