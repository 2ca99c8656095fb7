"""Clustering within cells without a cap, and seeding by oversampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_spatial import BOX, cloud_rows, frame
from voxelspan.operators import cluster, octree


def by_hand(rows, share, iterations):
    """Means of one cell's clusters: rows of (pos, x, y, z, intensity)."""
    rows = sorted(rows)
    p = np.array([r[1:4] for r in rows])
    n, k = len(p), max(1, int(len(p) * share))
    c = np.array([p[i * (n - 1) // max(1, k - 1)] for i in range(k)])
    for step in range(iterations):
        label = ((p[:, None] - c[None]) ** 2).sum(2).argmin(1)
        if step < iterations - 1:
            for i in range(k):
                if (label == i).any():
                    c[i] = np.floor(p[label == i].mean(0) * 1000 + cluster.TURN) / 1000
    return sorted((min(rows[j][0] for j in np.flatnonzero(label == i)), *p[label == i].mean(0), max(rows[j][4] for j in np.flatnonzero(label == i))) for i in np.unique(label))


def shown(df):
    return sorted((r["cell_code"], r["pos"], r["x"], r["y"], r["z"], r["intensity"]) for r in df.collect())


def same(a, b):
    """But for the order of additions."""
    return len(a) == len(b) and [(r[:2], r[5]) for r in a] == [(r[:2], r[5]) for r in b] and np.allclose([r[2:5] for r in a], [r[2:5] for r in b], atol=1e-9)


def test_cells_are_clustered_alike_whatever_the_cap(spark):
    p = cloud_rows(900, 12, hot=250)
    cells = octree.assign_cells(frame(spark, p), BOX, 1).cache()
    whole = shown(cluster.lloyd_cells(cells, BOX, iterations=4))
    assert same(shown(cluster.lloyd_cells(cells, BOX, iterations=4, cap=150)), whole)
    groups = {}
    for r in cells.collect():
        groups.setdefault(r["cell_code"], []).append((r["pos"], r["x"], r["y"], r["z"], r["intensity"]))
    assert same(whole, sorted((code, *row) for code, rows in groups.items() for row in by_hand(rows, 0.5, 4)))
    assert sum(len(g) > 150 for g in groups.values()) >= 1
    cells.unpersist()


def test_a_crowded_cell_in_far_less_than_a_square_of_time(spark):
    """40,000 points of one cell against 20,000 centres: all distances would be 8e8 a pass."""
    import time

    p = np.random.default_rng(1).uniform(0, 10, (40_000, 3)).round(2)
    nodes, order = cluster.kdtree.grow(p)
    began = time.time()
    label = cluster.kdtree.labels(nodes, p[order], p[::2])
    assert time.time() - began < 30
    some = np.arange(0, 40_000, 997)
    assert label[some].tolist() == ((p[order][some][:, None] - p[::2][None]) ** 2).sum(2).argmin(1).tolist()


def test_nearest_in_batches_is_the_expression(spark):
    points = frame(spark, cloud_rows(400, 5))
    c = [tuple(map(float, a)) for a in cloud_rows(80, 6)]
    wide = {(r["pos"], r["cluster_id"], r["d2"]) for r in cluster.nearest(points, c).collect()}
    near = {(r["pos"], r["cluster_id"], r["d2"]) for r in cluster.nearest(points, c[:40]).collect()}
    rest = {r["pos"]: (r["cluster_id"] + 40, r["d2"]) for r in cluster.nearest(points, c[40:]).collect()}
    assert wide == {(p, i, d) if d <= rest[p][1] else (p, *rest[p]) for p, i, d in near}


@pytest.mark.parametrize("k", [1, 5])
def test_seeds_cost_no_more_than_chance(spark, k):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.normal(m, 0.3, (300, 3)) for m in ((0, 0, 0), (40, 0, 0), (0, 40, 0), (0, 0, 40), (40, 40, 40))])
    points = frame(spark, p).cache()
    cost = lambda c: cluster.nearest(points, c).agg(F.sum("d2")).first()[0]
    found = cluster.candidate_seeds(points, k)
    assert sum(c[4] for c in found) == len(p) and found == cluster.candidate_seeds(points.repartition(5), k)
    ours = cluster.parallel_seeds(points, k)
    assert len(ours) == k and cost(ours) <= cost(cluster.seeds(points, k)) * (1.0 if k > 1 else 3.0)
    if k == 5:
        assert cost(ours) < 5000
    points.unpersist()


def test_seeds_of_few_points(spark):
    assert cluster.parallel_seeds(frame(spark, cloud_rows(0, hot=0)), 3) == []
    assert len(cluster.parallel_seeds(frame(spark, np.ones((20, 3))), 3)) == 1


@pytest.mark.parametrize("n, kind", [(1, "spread"), (2, "spread"), (17, "spread"), (700, "spread"), (700, "few places"), (700, "one place"), (900, "sheet"), (900, "lattice")])
def test_groups_against_boxes_are_all_against_all(n, kind):
    """Every pass of a cell, whichever groups it looks at, has the labels of all distances; equal ones go to the first."""
    from voxelspan.operators import boxes

    rng = np.random.default_rng(n)
    p = rng.uniform(-5, 5, (n, 3)).round(2)
    if kind != "spread":
        p = {"few places": p[rng.integers(0, 9, n)], "one place": np.tile(p[:1], (n, 1)), "sheet": p * (900, 0, 3), "lattice": rng.integers(-3, 4, (n, 3)) * 1.0}[kind]
    k = max(1, n // 2)
    first = np.arange(k) * (n - 1) // max(1, k - 1)
    order, own = boxes.ordered(p)
    assert sorted(order) == list(range(n)) and (p[order] == own).all()
    at, groups, c, moved = np.argsort(order)[first], boxes.Groups(own), p[first], None
    for _ in range(8):
        label = groups.assign(at, c, moved)
        w = own[:, None] - c[None]
        assert (label == (w[:, :, 0] * w[:, :, 0] + w[:, :, 1] * w[:, :, 1] + w[:, :, 2] * w[:, :, 2]).argmin(1)).all()
        new = np.array([own[label == i].mean(0).round(3) if (label == i).any() else c[i] for i in range(k)])
        moved, c = (new != c).any(1), new


def test_a_crowded_cell_is_one_tasks_without_much_time(spark):
    """400,000 points of one cell, ten passes: the trees of points before took 20 s a pass."""
    import time

    rows = spark.range(400_000).selectExpr("id AS pos", *[f"round(10 * rand({i}), 3) AS {a}" for i, a in enumerate("xyz")], "1D AS intensity").coalesce(1)
    cells = octree.assign_cells(rows, ((0.0, 10.0),) * 3, 0).cache()
    cells.count()
    began = time.time()
    means = cluster.lloyd_cells(cells, ((0.0, 10.0),) * 3)
    assert 150_000 < means.count() <= 200_000 and time.time() - began < 60
    cells.unpersist()
