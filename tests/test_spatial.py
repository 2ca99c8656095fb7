"""Stored pyramid, rays and nearest joins against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspan.operators import neighbours, octree, pyramid
from voxelspan.schema import POINT_SCHEMA

BOX = ((0.0, 100.0), (-5.0, 5.0), (10.0, 30.0))


def cloud_rows(n=3000, seed=0, hot=900, flat=False):
    rng = np.random.default_rng(seed)
    p = np.stack([rng.uniform(lo, hi, n) for lo, hi in BOX], 1).round(2)
    hot = min(hot, n // 2)
    if hot:
        p[:hot] = (p[:hot] - p[0]) * 1e-3 + p[0]  # a crowded place
        p[hot : hot + 200] = p[hot]  # copies
    if flat:
        p[:, 1] = 1.5
    return p


def frame(spark, p):
    rows = [(i, float(x), float(y), float(z), 0.0, 0.0, 0.0, float(i % 9), 1.0) for i, (x, y, z) in enumerate(p)]
    return spark.createDataFrame(rows, POINT_SCHEMA)


def scanned(df) -> int:
    """Rows that the plan's scans gave out; for plans without exchanges."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


@pytest.fixture(scope="module")
def cloud(spark, tmp_path_factory):
    df = frame(spark, cloud_rows(40_000, hot=2000))
    return pyramid.store(octree.assign_cells(df, BOX, 5), BOX, 5, f"file://{tmp_path_factory.mktemp('cloud')}/c")


def test_levels_add_up(spark, cloud):
    found = cloud.levels.groupBy("level").agg(F.sum("n_points").alias("n"), F.sum("sum_x").alias("x"), F.count("*").alias("cells")).orderBy("level").collect()
    assert [r["level"] for r in found] == [0, 1, 2, 3, 4, 5] and {r["n"] for r in found} == {40_000} and found[0]["cells"] == 1
    assert max(r["x"] for r in found) - min(r["x"] for r in found) < 1e-3
    own = {r["cell_code"]: (r["n"], r["lo"]) for r in cloud.points.groupBy(F.shiftright("cell_code", 6).alias("cell_code")).agg(F.count("*").alias("n"), F.min("x").alias("lo")).collect()}
    assert {r["cell_code"]: (r["n_points"], r["min_x"]) for r in cloud.levels.where("level = 3").collect()} == own


def test_parts_of_the_cloud_read_parts_of_the_files(cloud):
    all_rows = cloud.points.count()
    some = cloud.points_below(5, 1)
    assert some.count() == cloud.points.where(F.shiftright("cell_code", 12) == 5).count() > 0
    assert scanned(some) < all_rows / 3
    assert scanned(cloud.below(5, 1, 4)) < cloud.levels.count() / 2
    part = ((10.0, 20.0), (-5.0, -2.0), (12.0, 14.0))
    assert cloud.points_in(part).count() == cloud.points.where(octree.in_box(part)).count() > 0
    assert scanned(cloud.points_in(part)) < all_rows / 2


def test_counts_in_a_box(cloud):
    part = ((10.0, 71.5), (-4.0, 5.0), (12.0, 30.0))
    found = {r["cell_code"]: (r["n_points"], r["from_points"]) for r in cloud.count_in(part, 3).collect()}
    own = {r["c"]: r["n"] for r in cloud.points.where(octree.in_box(part)).groupBy(F.shiftright("cell_code", 6).alias("c")).agg(F.count("*").alias("n")).collect()}
    assert {c: n for c, (n, _) in found.items()} == own
    assert 0 < sum(f for _, f in found.values()) < sum(own.values())


def nearest_by_hand(q, p, k):
    out = []
    for i, a in enumerate(q):
        d = ((p - a) ** 2)
        d2 = d[:, 0] + d[:, 1] + d[:, 2]
        for rank, j in enumerate(np.lexsort((np.arange(len(p)), d2))[:k], 1):
            out.append((i, rank, int(j), float(d2[j])))
    return out


@pytest.mark.parametrize(("k", "depth", "flat"), [(1, 5, False), (4, 6, False), (1, 3, True), (300, 2, False)])
def test_nearest_against_brute_force(spark, k, depth, flat):
    p = cloud_rows(2500, 3, flat=flat)
    box = ((0.0, 100.0), (1.5, 1.5), (10.0, 30.0)) if flat else BOX
    q = np.concatenate([p[::50], np.random.default_rng(9).uniform(-50, 150, (40, 3)).round(2)])
    queries = spark.createDataFrame([(i, *map(float, a)) for i, a in enumerate(q)], "id bigint, x double, y double, z double")
    found = sorted(tuple(r) for r in neighbours.nearest_join(queries, frame(spark, p), box, depth, k).collect())
    assert found == nearest_by_hand(q, p, k)


def test_nearest_of_few_or_none(spark):
    queries = spark.createDataFrame([(0, 1.0, 2.0, 3.0)], "id bigint, x double, y double, z double")
    assert neighbours.nearest_join(queries, frame(spark, cloud_rows(0, hot=0)), BOX, 3).count() == 0
    assert neighbours.nearest_join(queries, frame(spark, cloud_rows(3, hot=0)), BOX, 3, k=5).count() == 3
    assert neighbours.nearest_join(queries.limit(0), frame(spark, cloud_rows(30, hot=0)), BOX, 3).count() == 0


def picked_by_hand(rays, p, reach):
    out = {}
    for i, o, d in rays:
        w = p - o
        t = w[:, 0] * d[0] + w[:, 1] * d[1] + w[:, 2] * d[2]
        far = w[:, 0] * w[:, 0] + w[:, 1] * w[:, 1] + w[:, 2] * w[:, 2] - t * t
        ok = np.flatnonzero((t >= 0) & (far <= reach * reach))
        if len(ok):
            j = ok[np.lexsort((ok, t[ok]))[0]]
            out[i] = (int(j), float(t[j]))
    return out


@pytest.mark.parametrize(("reach", "level", "flat"), [(0.3, 5, False), (2.5, 4, False), (40.0, 3, False), (0.2, 4, True)])
def test_rays_against_brute_force(spark, tmp_path, reach, level, flat):
    p = cloud_rows(5000, 4, flat=flat)
    box = ((0.0, 100.0), (1.5, 1.5), (10.0, 30.0)) if flat else BOX
    store = pyramid.store(octree.assign_cells(frame(spark, p), box, 5), box, 5, f"file://{tmp_path}/c")
    rng = np.random.default_rng(6)
    rays = []
    for i in range(60):
        o = rng.uniform((-30, -10, 0), (130, 10, 40))
        d = p[rng.integers(len(p))] - o if i % 3 else rng.normal(size=3)
        if i % 10 == 0:
            d = np.eye(3)[i // 10 % 3] * (-1) ** (i // 10)
        rays.append((i, o, d / np.sqrt((d * d).sum())))
    df = spark.createDataFrame([(i, *map(float, o), *map(float, d)) for i, o, d in rays], "ray_id bigint, ox double, oy double, oz double, dx double, dy double, dz double")
    rows = neighbours.pick_many(df, store, reach, level).collect()
    assert {r["ray_id"]: (r["pos"], r["t"]) for r in rows} == picked_by_hand(rays, p, reach)
    assert all(0 < r["cells_read"] <= r["cells_all"] for r in rows)
    if reach == 0.3:
        assert sum(r["cells_read"] for r in rows) < 0.05 * sum(r["cells_all"] for r in rows)


def test_a_ray_meets_the_cells_within_its_reach(spark):
    """Along the middle of cells those alone; near a plane the ones behind it too."""
    box = ((0.0, 16.0),) * 3
    rays = spark.createDataFrame([(0, -3.0, 5.5, 7.5, 1.0, 0.0, 0.0), (1, -3.0, 5.1, 7.5, 1.0, 0.0, 0.0)], "ray_id bigint, ox double, oy double, oz double, dx double, dy double, dz double")
    met = neighbours.cells_met(rays, box, 4, 0.2).groupBy("ray_id").agg(F.count("*").alias("n")).collect()
    assert {r["ray_id"]: r["n"] for r in met} == {0: 16, 1: 32}


def test_ranges_are_few_and_hold_everything():
    ranges = [(i * 10, i * 10 + 3) for i in range(100)]
    few = octree.few_ranges(ranges, 7)
    assert len(few) == 7 and all(any(lo <= a and b <= hi for lo, hi in few) for a, b in ranges)
    assert octree.few_ranges([], 7) == [] and octree.few_ranges(ranges[:3], 7) == ranges[:3]
