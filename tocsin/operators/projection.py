"""A map of vectors in the plane that keeps neighbours together.

Rows are pulled along the edges of their neighbour graph and pushed apart by
everything else. The push comes from a mesh: rows are summed into at most
``MESH`` x ``MESH`` cells, whatever their number, and the push of the summed
mesh is read back between its nodes. The work is rows times neighbours.

A round deals the rows into parts of about ``PART`` rows that lie together on
the map. A part moves its own rows for ``STEPS`` steps; the rows outside rest
where the last round left them, pull through the edges and push through the
mesh. Positions are written between rounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.operators.embeddings import nearest, project_2d
from tocsin.operators.neighbours import exact_neighbours, neighbour_graph
from tocsin.operators.tables import top_n_per_group
from tocsin.session import materialize

PERPLEXITY = 10
PER_ROW = 3  # neighbours of a row, times the perplexity
ROUNDS = 10
STEPS = 30  # of every round
GATHER = 3  # rounds in which rows are pulled more strongly, so that groups form
STRENGTH = 12.0
MESH = 192
PART = 20_000
BISECTIONS = 40
FIXED = 1 << 20  # fractions are summed as integers: equal sums in any order
MARGIN = 0.5  # room around the map, as a share of its width, to move in a round
LEAST_WIDTH = 30.0  # of the mesh, so that a round of a small map is not held back


def affinities(graph: DataFrame, perplexity: float) -> DataFrame:
    """(id, other, weight): how much each neighbour of a row counts; the weights of a row add up to 1.

    A row's bandwidth is found by bisection, such that the entropy of its
    weights is that of ``perplexity`` equal ones. Rows with fewer neighbours
    spread the weight as evenly as the widest bandwidth does.
    """
    # Rounded, as products of one pair in different blocks differ in their last bits.
    far = F.greatest(F.lit(0.0), F.round(2 - 2 * F.col("similarity"), 9))
    rows = graph.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(far.alias("far"), "other"))).alias("near"))
    rows = rows.withColumn("beyond", F.transform("near", lambda n: n["far"] - F.col("near")[0]["far"]))

    def entropy(beta: Column) -> Column:
        mass = F.aggregate("beyond", F.lit(0.0), lambda s, d: s + F.exp(-beta * d))
        moment = F.aggregate("beyond", F.lit(0.0), lambda s, d: s + d * F.exp(-beta * d))
        return F.log(mass) + beta * moment / mass

    def halve(state: Column, _: Column) -> Column:
        """Bisection of the exponent of beta: a higher beta means less entropy."""
        middle = (state["low"] + state["high"]) / 2
        wide = entropy(F.exp(middle)) > float(np.log(perplexity))
        low, high = F.when(wide, middle).otherwise(state["low"]), F.when(wide, state["high"]).otherwise(middle)
        return F.struct(low.alias("low"), high.alias("high"))

    ends = F.struct(F.lit(-10.0).alias("low"), F.lit(30.0).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), ends, halve)
    rows = rows.withColumn("beta", F.exp(found["low"]))
    rows = rows.withColumn("mass", F.aggregate("beyond", F.lit(0.0), lambda s, d: s + F.exp(-F.col("beta") * d)))
    edges = rows.select("id", "beta", "mass", F.explode(F.arrays_zip("near", "beyond")).alias("n"))
    return edges.select(
        "id", F.col("n.near.other").alias("other"), (F.exp(-F.col("beta") * F.col("n.beyond")) / F.col("mass")).alias("weight")
    )


def _start(vectors: DataFrame) -> DataFrame:
    """(id, x, y, vx, vy): a small copy of the principal plane."""
    plane = project_2d(vectors, "vector")
    spread = plane.agg(F.stddev_pop("x").alias("s")).first()["s"] or 1.0
    # Written to a few decimals, as the plane differs in its last bits by the order of addition.
    scaled = [F.round(F.col(c) / spread, 6).alias(c) for c in ("x", "y")]
    return plane.select("id", *scaled, F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"))


class Box:
    """The square of the plane under the mesh."""

    def __init__(self, low_x: float, low_y: float, width: float):
        whole = max(width * (1 + 2 * MARGIN), LEAST_WIDTH)
        self.x, self.y = low_x - (whole - width) / 2, low_y - (whole - width) / 2
        self.step = whole / (MESH - 1)

    def place(self, xy: np.ndarray) -> np.ndarray:
        """Coordinates in cells, kept inside the mesh."""
        return np.clip((xy - (self.x, self.y)) / self.step, 0, MESH - 1.000001)


def _cells(placed: DataFrame, box: Box) -> DataFrame:
    """Rows with the cell they lie in (``cx``, ``cy``) and how far in (``fx``, ``fy``)."""
    at = {c: F.least((F.col(c) - low) / box.step, F.lit(MESH - 1.000001)) for c, low in (("x", box.x), ("y", box.y))}
    return placed.select(
        "*",
        *[F.floor(at[c]).cast("int").alias(f"c{c}") for c in "xy"],
        *[(at[c] - F.floor(at[c])).alias(f"f{c}") for c in "xy"],
    )


def _mesh(cells: DataFrame) -> tuple[np.ndarray, dict[tuple[int, int], int]]:
    """Rows summed on the nodes of the mesh, and rows per cell. At most ``MESH`` squared cells reach the driver.

    The share of a row at each corner of its cell is linear in fx, fy and
    their product, so four sums per cell suffice.
    """
    sums = cells.groupBy("cx", "cy").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.round(e * FIXED).cast("long")).alias(a) for a, e in
          (("sx", F.col("fx")), ("sy", F.col("fy")), ("sxy", F.col("fx") * F.col("fy")))],
    ).toPandas()
    a, b, n = (sums[c].to_numpy() for c in ("cx", "cy", "n"))
    sx, sy, sxy = (sums[c].to_numpy() / FIXED for c in ("sx", "sy", "sxy"))
    mesh = np.zeros((MESH, MESH))
    for da, db, share in ((0, 0, n - sx - sy + sxy), (1, 0, sx - sxy), (0, 1, sy - sxy), (1, 1, sxy)):
        np.add.at(mesh, (a + da, b + db), share)
    return mesh, dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True))


def _interleaved(cell: tuple[int, int]) -> int:
    """Cells in an order in which neighbours on the map mostly follow each other."""
    return sum((cell[axis] >> bit & 1) << (2 * bit + axis) for bit in range(MESH.bit_length()) for axis in (0, 1))


def _parts(counts: dict[tuple[int, int], int], size: int) -> list[tuple[int, int, int, int]]:
    """(cx, cy, first part, parts): cells gathered to parts of at most ``size`` rows; a fuller cell has parts of its own."""
    dealt, part, room = [], -1, 0
    for cell in sorted(counts, key=_interleaved):
        rows = counts[cell]
        if rows > size:
            own = -(-rows // size)
            dealt.append((*cell, part + 1, own))
            part, room = part + own, 0
            continue
        if rows > room:
            part, room = part + 1, size
        dealt.append((*cell, part, 1))
        room -= rows
    return dealt


def _push(box: Box):
    """Transformed kernels of the mesh: how a unit of mass is felt at every distance."""
    reach = np.fft.fftfreq(2 * MESH, 1 / (2 * MESH)) * box.step
    dx, dy = np.meshgrid(reach, reach, indexing="ij")
    near = 1 / (1 + dx * dx + dy * dy)
    return [np.fft.rfft2(k) for k in (near, near * near * dx, near * near * dy)]


def _corners(place: np.ndarray):
    base = place.astype(int)
    fx, fy = (place - base).T
    a, b = base.T
    return [(a, b, (1 - fx) * (1 - fy)), (a + 1, b, fx * (1 - fy)), (a, b + 1, (1 - fx) * fy), (a + 1, b + 1, fx * fy)]


def _summed(corners) -> np.ndarray:
    flat = sum(np.bincount(a * MESH + b, share, MESH * MESH) for a, b, share in corners)
    return flat.reshape(MESH, MESH)


def _moved(box: Box, mesh: np.ndarray, rows: int, strength: float, keep: float, steps: int):
    """Moves the rows of a part; called with the rows and the edges that start there."""
    rate = max(rows / 12, 50.0)

    def part(own: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id")
        edges = edges.sort_values(["id", "other"])
        ids = own["id"].to_numpy()
        xy, speed = own[["x", "y"]].to_numpy(), own[["vx", "vy"]].to_numpy()
        gains = np.ones_like(xy)
        start = np.searchsorted(ids, edges["id"].to_numpy())
        end = np.minimum(np.searchsorted(ids, edges["other"].to_numpy()), len(ids) - 1)
        inside = ids[end] == edges["other"].to_numpy()
        resting = edges[["ox", "oy"]].to_numpy()
        # An edge within the part is felt at both ends with half its weight; one that leaves it, here only.
        weight = edges["weight"].to_numpy() / rows * np.where(inside, 0.5, 1.0)
        kernels, shape = _push(box), (2 * MESH, 2 * MESH)
        outside = mesh - _summed(_corners(box.place(xy)))
        for _ in range(steps):
            corners = _corners(box.place(xy))
            mass = np.fft.rfft2(outside + _summed(corners), shape)
            fields = [np.fft.irfft2(mass * k, shape)[:MESH, :MESH] for k in kernels]
            apart = xy[start] - np.where(inside[:, None], xy[end], resting)
            pull = (strength * weight / (1 + (apart**2).sum(1)))[:, None] * apart
            # What is felt at the nodes, weighted with the mass there, is the sum over all pairs.
            total = max(float((fields[0] * (outside + _summed(corners))).sum()) - rows, 1e-9)
            slope = np.empty_like(xy)
            for axis in (0, 1):
                felt = sum(share * fields[axis + 1][a, b] for a, b, share in corners)
                pulled = np.bincount(start, pull[:, axis], len(ids))
                pulled -= np.bincount(end[inside], pull[inside, axis], len(ids))
                slope[:, axis] = 4 * (pulled - felt / total)
            gains = np.maximum(np.where(slope * speed < 0, gains + 0.2, gains * 0.8), 0.01)
            speed = keep * speed - rate * gains * slope
            xy = np.clip(xy + speed, (box.x, box.y), (box.x + box.step * (MESH - 1), box.y + box.step * (MESH - 1)))
        moved = {"id": ids, "x": xy[:, 0], "y": xy[:, 1], "vx": speed[:, 0], "vy": speed[:, 1]}
        return pd.DataFrame(moved)

    return part


def _round(placed: DataFrame, edges: DataFrame, rows: int, strength: float, keep: float, steps: int, part_rows: int) -> DataFrame:
    ends = placed.agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))]).first()
    box = Box(ends["low_x"], ends["low_y"], max(ends["high_x"] - ends["low_x"], ends["high_y"] - ends["low_y"]))
    cells = _cells(placed, box)
    mesh, counts = _mesh(cells)
    # One row per filled cell of the mesh, so its size is bounded.
    deal = placed.sparkSession.createDataFrame(_parts(counts, part_rows), "cx int, cy int, first int, parts int")
    own = cells.join(F.broadcast(deal), ["cx", "cy"]).select(
        "id", "x", "y", "vx", "vy", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("part")
    )
    own = materialize(own, "own")
    there = own.select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    pulls = edges.join(there, "other").join(own.select("id", F.col("part").alias("starts_in")), "id")
    moved = own.groupBy("part").cogroup(pulls.groupBy("starts_in")).applyInPandas(
        _moved(box, mesh, rows, strength, keep, steps), "id long, x double, y double, vx double, vy double"
    )
    return materialize(moved, "moved")


def neighbour_map(
    df: DataFrame,
    perplexity: float = PERPLEXITY,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    rounds: int = ROUNDS,
    steps: int = STEPS,
    part_rows: int = PART,
) -> DataFrame:
    """(id, x, y): a place in the plane for every vector, near its most similar vectors.

    Ids are integers, each on one row; vectors have one size. Vectors that are
    null, empty or hold nulls have no place. Copies of one vector lie together.
    An empty table gives an empty map; fewer than three rows
    lie at their first two components. The result is the same on every run.
    """
    usable = (F.size(vec_col) > 0) & ~F.exists(vec_col, lambda x: x.isNull())
    vectors = df.filter(F.col(id_col).isNotNull() & usable)
    vectors = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vector"))
    vectors = materialize(vectors, "vectors")
    rows = vectors.count()
    if rows < 3:
        return vectors.select("id", F.col("vector")[0].alias("x"), F.coalesce(F.get("vector", F.lit(1)), F.lit(0.0)).alias("y"))
    graph = neighbour_graph(vectors, int(PER_ROW * perplexity), "id", "vector", width=1)
    edges = materialize(affinities(graph, perplexity), "edges")
    placed = materialize(_start(vectors), "start")
    for n in range(rounds):
        strength, keep = (STRENGTH, 0.5) if n < GATHER else (1.0, 0.8)
        placed = _round(placed, edges, rows, strength, keep, steps, part_rows)
    return placed.select("id", "x", "y")


def preservation(df: DataFrame, placed: DataFrame, asked: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(n_rows, preserved): the share of the ``k`` most similar rows of each asked row that are among its ``k`` nearest on the map."""
    exact = exact_neighbours(df, asked, k, id_col, vec_col).select("id", "other")
    points = placed.select("id", F.array("x", "y").alias("point"))
    queries = points.join(asked.select(F.col(id_col).alias("id")), "id").select(F.col("id").alias("asked"), F.col("point").alias("from"))
    near = nearest(points, queries, k + 1, "id", "point", "asked", "from", score=_closeness).filter("asked != id")
    near = top_n_per_group(near, ["asked"], [F.desc("similarity"), F.asc("id")], k)
    near = near.select(F.col("asked").alias("id"), F.col("id").alias("other"), F.lit(1).alias("kept"))
    return exact.join(near, ["id", "other"], "left").agg(
        F.count_distinct("id").alias("n_rows"), (F.count("kept") / F.count(F.lit(1))).alias("preserved")
    )


def _closeness(product: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return 2 * product - a - b, np.ones_like(product, bool)
