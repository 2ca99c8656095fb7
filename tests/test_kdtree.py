"""Filtering over k-d trees against plain assignment."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_spatial import cloud_rows, frame
from voxelspan.operators import cluster, kdtree


def plain(p, c):
    d2 = ((p[:, None] - c[None]) ** 2).sum(2)
    label = d2.argmin(1)
    return np.bincount(label, minlength=len(c)), np.stack([np.bincount(label, p[:, a], len(c)) for a in range(3)], 1), np.bincount(label, d2.min(1), len(c))


@pytest.mark.parametrize("k", [1, 2, 9, 60])
def test_a_tree_assigns_as_all_distances_do(k):
    rng = np.random.default_rng(k)
    for p in (cloud_rows(3000, k), np.round(rng.normal(size=(500, 3)) * 3), np.ones((300, 3)), rng.normal(size=(1, 3))):
        nodes, order = kdtree.grow(p, leaf=16)
        assert sorted(order.tolist()) == list(range(len(p)))
        ordered = p[order]
        c = p[rng.integers(0, len(p), k)]
        count, sums, sse, computed = kdtree.assign(nodes, ordered, c)
        n, s, e = plain(p, c)
        assert kdtree.labels(nodes, ordered, c).tolist() == ((ordered[:, None] - c[None]) ** 2).sum(2).argmin(1).tolist()
        assert count.tolist() == n.tolist() and np.allclose(sums, s) and np.allclose(sse, e, atol=1e-6) and computed <= len(p) * k
    p = rng.uniform(size=(20_000, 3))
    nodes, order = kdtree.grow(p)
    if k > 2:
        assert kdtree.assign(nodes, p[order], p[:k])[3] < 0.25 * len(p) * k


def test_lloyd_over_trees_is_lloyd(spark):
    p = cloud_rows(6000, 2)
    points = frame(spark, p).repartition(3)
    start = [tuple(map(float, a)) for a in p[::700]]
    forest = kdtree.trees(points, block=1000, leaf=32)
    assert forest.agg(F.sum("n")).first()[0] == 6000 and forest.count() >= 6
    ours, theirs = kdtree.lloyd(forest, start, 6), cluster.lloyd(points, len(start), 6, start)
    assert np.allclose(ours, theirs)
    costs = {r["cluster_id"]: r["sse"] for r in kdtree.totals(forest, ours).collect()}
    expected = {r["cluster_id"]: r["sse"] for r in cluster.cost(cluster.nearest(points, theirs)).collect()}
    assert costs.keys() == expected.keys() and all(abs(costs[k] - expected[k]) < 1e-6 * (1 + expected[k]) for k in costs)


def test_no_points(spark):
    forest = kdtree.trees(frame(spark, cloud_rows(0, hot=0)))
    assert forest.count() == 0 and kdtree.lloyd(forest, [(0.0, 0.0, 0.0)], 3) == [(0.0, 0.0, 0.0)]
