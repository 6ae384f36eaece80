"""The map of neighbours: bandwidths, the mesh, parts, and what stays together."""

import numpy as np
import pandas as pd
import pytest

from tests.test_neighbours import table
from tocsin.operators import projection
from tocsin.operators.projection import Box, affinities, neighbour_map, preservation


def test_weights_have_the_entropy_asked_for(spark):
    draw = np.random.default_rng(1)
    rows = [(i, 100 + j, float(s)) for i in range(20) for j, s in enumerate(draw.uniform(-0.5, 1, 15))]
    found = affinities(spark.createDataFrame(rows, "id long, other long, similarity double"), 5).collect()
    for i in range(20):
        weights = np.array([r.weight for r in found if r.id == i])
        assert weights.sum() == pytest.approx(1)
        assert np.exp(-(weights * np.log(np.maximum(weights, 1e-300))).sum()) == pytest.approx(5, rel=1e-6)


def test_weights_of_copies_and_of_few_neighbours(spark):
    rows = [(1, 2, 1.0), (1, 3, 1.0), (1, 4, 1.0), (2, 1, 1.0)]
    found = affinities(spark.createDataFrame(rows, "id long, other long, similarity double"), 2).collect()
    assert len(found) == 4
    assert all(r.weight == pytest.approx(1 / 3 if r.id == 1 else 1) for r in found)


def test_mesh_of_four_sums_is_that_of_single_rows(spark):
    draw = np.random.default_rng(2)
    xy = draw.standard_normal((200, 2)) * 9
    box = Box(xy[:, 0].min(), xy[:, 1].min(), float(np.ptp(xy, axis=0).max()))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    mesh, counts = projection._mesh(projection._cells(df, box))
    assert sum(counts.values()) == 200
    assert mesh == pytest.approx(projection._summed(projection._corners(box.place(xy))), abs=1e-4)


def test_push_of_the_mesh_is_that_of_all_pairs():
    """One step of a part without edges, against the loop over all pairs; distances are well above the mesh width."""
    gx, gy = np.meshgrid(np.arange(5) * 3.0, np.arange(4) * 3.5)
    xy = np.stack([gx.ravel(), gy.ravel()], 1) + np.random.default_rng(4).uniform(-0.4, 0.4, (20, 2))
    box = Box(xy[:, 0].min(), xy[:, 1].min(), 13.0)
    mesh = projection._summed(projection._corners(box.place(xy)))
    own = pd.DataFrame({"id": range(20), "x": xy[:, 0], "y": xy[:, 1], "vx": 0.0, "vy": 0.0})
    none = pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("id", int), ("other", int), ("weight", float), ("ox", float), ("oy", float))})
    moved = projection._moved(box, mesh, 20, 1.0, 0.5, 1)(own, none)[["x", "y"]].to_numpy() - xy
    apart = xy[:, None] - xy[None]
    near = 1 / (1 + (apart**2).sum(2))
    np.fill_diagonal(near, 0)
    push = ((near**2)[..., None] * apart).sum(1) / near.sum()
    wanted = 50.0 * 4 * push * 0.8
    assert moved == pytest.approx(wanted, rel=0.1, abs=0.05 * np.abs(wanted).max())


@pytest.mark.parametrize("size", [1, 7, 50])
def test_parts_hold_at_most_their_size(size):
    draw = np.random.default_rng(6)
    counts = {(int(a), int(b)): int(n) for a, b, n in zip(draw.integers(0, 40, 90), draw.integers(0, 40, 90), draw.integers(1, 30, 90))}
    counts[3, 3] = 400
    dealt = projection._parts(counts, size)
    assert {d[:2] for d in dealt} == set(counts)
    rows = {}
    for a, b, first, own in dealt:
        for part in range(first, first + own):
            rows[part] = rows.get(part, 0) + counts[a, b] / own
    assert max(rows.values()) <= size and sorted(rows) == list(range(len(rows)))


@pytest.fixture(scope="module")
def groups():
    """Six far groups, a third of all rows in the first."""
    draw = np.random.default_rng(8)
    names = np.concatenate([np.zeros(60, int), draw.integers(1, 6, 120)])
    return names, np.eye(6, 12)[names] * 5 + 0.5 * draw.standard_normal((180, 12))


@pytest.fixture(scope="module")
def placed(spark, groups):
    return neighbour_map(table(spark, groups[1]), perplexity=5, rounds=6, part_rows=70).cache()


def test_groups_lie_apart_over_several_parts(spark, groups, placed):
    names, data = groups
    rows = {r.id: (r.x, r.y) for r in placed.collect()}
    assert sorted(rows) == list(range(len(data)))
    xy = np.array([rows[i] for i in range(len(data))])
    gaps = ((xy[:, None] - xy[None]) ** 2).sum(2)
    np.fill_diagonal(gaps, np.inf)
    assert np.mean(names[gaps.argmin(1)] == names) >= 0.97


def test_preservation_is_that_of_the_plain_loop(spark, groups, placed):
    data = groups[1].astype(np.float32).astype(float)
    df = table(spark, groups[1])
    found = preservation(df, placed, df.filter("vec_id % 9 = 0"), 6).first()
    rows = {r.id: (r.x, r.y) for r in placed.collect()}
    xy = np.array([rows[i] for i in range(len(data))])
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    kept = 0
    for i in range(0, len(data), 9):
        others = [j for j in range(len(data)) if j != i]
        like = sorted(others, key=lambda j: -unit[i] @ unit[j])[:6]
        near = sorted(others, key=lambda j: ((xy[i] - xy[j]) ** 2).sum())[:6]
        kept += len(set(like) & set(near))
    assert found.n_rows == 20 and found.preserved == pytest.approx(kept / 120)


def test_same_map_under_another_partitioning(spark, groups):
    few = table(spark, groups[1][:60])
    one, other = (neighbour_map(d, perplexity=3, rounds=2, steps=10).orderBy("id").collect() for d in (few, few.repartition(3)))
    assert one == other


def test_missing_copied_and_few_vectors(spark):
    data = [None, [], [0.0, 0.0], *([[1.0, 2.0]] * 8), [2.0, 1.0]]
    df = table(spark, data)
    rows = neighbour_map(df, perplexity=2, rounds=2, steps=5).collect()
    assert {r.id for r in rows} == set(range(2, 12)) and all(np.isfinite([r.x, r.y]).all() for r in rows)
    assert neighbour_map(df.limit(0)).collect() == []
    assert [tuple(r) for r in neighbour_map(df.filter("vec_id = 11")).collect()] == [(11, 2.0, 1.0)]
