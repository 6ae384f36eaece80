"""The neighbour graph against all pairs."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tocsin.operators import neighbours
from tocsin.operators.neighbours import exact_neighbours, neighbour_graph, recall

SCHEMA = "vec_id long, embedding array<float>, other string"


def table(spark, data):
    return spark.createDataFrame([(i, v if v is None else [float(x) for x in v], "clash") for i, v in enumerate(data)], SCHEMA)


@pytest.fixture(scope="module")
def clustered():
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((30, 16))
    return centres[draw.integers(0, 30, 1500)] + 0.4 * draw.standard_normal((1500, 16))


def plain(data, k):
    unit = data.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T
    np.fill_diagonal(near, -np.inf)
    return near, np.sort(near, axis=1)[:, -k]


def test_recall_against_all_pairs(spark, clustered):
    graph = neighbour_graph(table(spark, clustered), k=10).collect()
    near, least = plain(clustered, 10)
    assert len(graph) == 10 * len(clustered)
    assert len({(r.id, r.other) for r in graph}) == len(graph) and all(r.id != r.other for r in graph)
    assert all(r.similarity == pytest.approx(near[r.id, r.other], abs=1e-9) for r in graph)
    assert np.mean([r.similarity >= least[r.id] - 1e-9 for r in graph]) >= 0.95


def test_sampled_recall_is_that_of_the_plain_loop(spark, clustered):
    data = clustered[:400]
    df = table(spark, data)
    graph = neighbour_graph(df, k=5, rounds=0, orders=1)
    measured = recall(graph, exact_neighbours(df, df.filter("vec_id % 50 = 0"), 5)).first()
    _, least = plain(data, 5)
    hits = sum(r.similarity >= least[r.id] - 1e-9 for r in graph.collect() if r.id % 50 == 0)
    assert (measured.n_rows, measured.n_wanted) == (8, 40)
    assert measured.recall == pytest.approx(hits / 40)
    assert measured.recall < 1


def test_same_result_under_another_partitioning(spark, clustered):
    df = table(spark, clustered[:300])
    one = sorted(map(tuple, neighbour_graph(df, k=4).collect()))
    assert sorted(map(tuple, neighbour_graph(df.repartition(5), k=4).collect())) == one


def test_copies_zeros_and_missing_vectors(spark, monkeypatch):
    """A third of all rows are one vector: it is dealt into blocks, and each copy finds copies."""
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    draw = np.random.default_rng(5)
    data = [None, [], [0.0] * 4, *([[1.0, 2.0, 0.0, 1.0]] * 60), *draw.standard_normal((120, 4))]
    df = table(spark, data)
    rows = neighbour_graph(df, k=3).collect()
    assert {r.id for r in rows} == set(range(2, len(data)))
    assert all(r.similarity == pytest.approx(1) for r in rows if 3 <= r.id < 63)
    assert all(r.similarity == 0 for r in rows if r.id == 2)
    assert neighbour_graph(df.limit(0), k=3).collect() == []
    assert neighbour_graph(df.filter("vec_id = 5"), k=3).collect() == []


def test_only_what_may_be_nearer_is_handed_on(spark, clustered):
    """Rows that meet again hand on neither what they have nor what is farther than all they have."""
    vectors = table(spark, clustered[:300]).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    graph = neighbour_graph(vectors, 5, "id", "vector", rounds=1, width=1).persist()
    has = {(r.id, r.other) for r in graph.collect()}
    least = {r.id: r.least for r in graph.groupBy("id").agg(F.min("similarity").alias("least")).collect()}
    met = neighbours._introduce(graph, vectors, 5).collect()
    assert met and not has & {(r.id, r.other) for r in met}
    assert all(r.similarity >= least[r.id] - 1e-9 for r in met)
    graph.unpersist()
