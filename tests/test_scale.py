"""Sums that don't depend on the order of additions, and plans whose cost grows with the rows alone."""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.test_spatial import BOX, cloud_rows, frame
from voxelspan.operators import cluster, neighbours, octree, pyramid, reduce
from voxelspan.plans import pointview, registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sums_of_levels_lose_nothing(spark):
    rows = [(0, *[v] * 3, 1.0) for v in (2.0**53, *[1.0] * 6)]
    cells = spark.createDataFrame(rows, "cell_code bigint, x double, y double, z double, intensity double").coalesce(1)
    assert {tuple(r) for r in pyramid.levels_of(cells, 1).select("sum_x", "sum_y", "sum_z").collect()} == {(2.0**53 + 6,) * 3}


def test_costs_lose_nothing(spark):
    near = spark.createDataFrame([(0, v) for v in (2.0**53, *[1.0] * 6)], "cluster_id int, d2 double").coalesce(1)
    assert cluster.cost(near).first()["sse"] == 2.0**53 + 6
    assert cluster.mean_cost(near, 1, 1).first()[0] == 2.0**53 + 6


def test_prefix_costs_lose_nothing(spark):
    p = spark.createDataFrame([(i, v, 0.0, 0.0) for i, v in enumerate([0.0, 2.0**27, *[1.0] * 8])], "pos bigint, x double, y double, z double").coalesce(1)
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "1")
    try:
        assert {r["k"]: r["cost"] for r in cluster.prefix_costs(p, "pos", 2).collect()} == {1: 2.0**54 + 8, 2: 8.0}
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("rows", ["100", "10000"])
def test_prefix_costs_lose_nothing_within_a_batch(spark, rows):
    """Wherever batches end, sums are those of whole numbers: 2 ** 54 is followed by ones that it would swallow."""
    p = spark.createDataFrame([(i, v, 0.0, 0.0) for i, v in enumerate([0.0, 2.0**27, *[1.0] * 1000, 1.25])], "pos bigint, x double, y double, z double").coalesce(1)
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, rows)
    try:
        assert {r["k"]: r["cost"] for r in cluster.prefix_costs(p, "pos", 2).collect()} == {1: 2.0**54 + 1000, 2: 1001.5625}
    finally:
        spark.conf.set(key, before)


def test_many_centroids_are_no_long_expression(spark):
    p = frame(spark, cloud_rows(300, 3))
    centres = [(r["x"], r["y"], r["z"]) for r in p.orderBy("pos").limit(20).collect()]
    found = cluster.nearest(p, centres)
    assert "MapInArrow" in plan(found)
    want = {r["pos"]: min(((r["x"] - x) * (r["x"] - x) + (r["y"] - y) * (r["y"] - y) + (r["z"] - z) * (r["z"] - z), i) for i, (x, y, z) in enumerate(centres)) for r in p.collect()}
    assert {r["pos"]: (r["d2"], r["cluster_id"]) for r in found.collect()} == want


def test_records_are_moved_once(spark):
    found = plan(pointview._numbered_records(spark, SF))
    assert found.count("Exchange rangepartitioning") == 1 and "SortMergeJoin" not in found
    pos = [[r["pos"] for r in part] for part in pointview._numbered_records(spark, SF).rdd.glom().collect()]
    assert [p for part in pos for p in part] == list(range(len(spark.read.parquet(f"{SF}/lineitem.parquet").select("l_tax").collect())))


def test_shapes_are_made_without_sorting(spark):
    assert "SortAggregate" not in plan(registry.shapes(spark, SF))


@pytest.mark.parametrize("slice_rows", [1 << 20, 20])
def test_second_halves_of_cells_are_not_moved_again(spark, slice_rows):
    """What is grouped by place is at most half of the points (and one of each cell)."""
    cells = octree.assign_cells(frame(spark, cloud_rows(400, 5, hot=100)), BOX, 1)
    reduced = reduce.reduce_cells(cells, slice_rows=slice_rows)
    got = sorted((r["cell_code"], r["pos"]) for r in reduced.collect())
    by_cell = {}
    for r in cells.orderBy("pos").collect():
        by_cell.setdefault(r["cell_code"], []).append(r)
    want = []
    for code, rows in by_cell.items():
        seen, keep = set(), 1
        for i, r in enumerate(rows, 1):
            place = (r["x"], r["y"], r["z"])
            keep = i if place not in seen and 2 * i <= len(rows) else keep
            seen.add(place)
        want += [(code, r["pos"]) for r in rows[:keep]]
    assert got == sorted(want)
    assert re.search(r"= 1\) OR \(", reduced._jdf.queryExecution().optimizedPlan().toString())


@pytest.mark.parametrize("k, cell_points", [(1, 3), (3, 3), (3, 40)])
def test_nearest_join_over_cut_cells(spark, k, cell_points):
    p = cloud_rows(400, 5, hot=60)
    df = frame(spark, p)
    inside = df.where("pos % 3 = 0").select(F.col("pos").alias("id"), "x", "y", "z")
    queries = inside.unionByName(inside.select((-F.col("id") - 1).alias("id"), *[(F.col(a) * 3 + 7).alias(a) for a in "xyz"]))
    got = sorted(tuple(r) for r in neighbours.nearest_join(queries, df, BOX, 4, k, cell_points=cell_points).collect())
    there, want = octree.assign_cells(df, BOX, 1).collect(), []
    for q in queries.collect():
        d2 = sorted(((r["x"] - q["x"]) * (r["x"] - q["x"]) + (r["y"] - q["y"]) * (r["y"] - q["y"]) + (r["z"] - q["z"]) * (r["z"] - q["z"]), r["pos"]) for r in there)
        want += [(q["id"], i + 1, pos, d) for i, (d, pos) in enumerate(d2[:k])]
    assert got == sorted(want)


def test_nearest_join_moves_a_query_for_a_few_cells(spark, monkeypatch):
    moved, own = [], neighbours._held
    monkeypatch.setattr(neighbours, "_held", lambda q, *a, **kw: moved.append(q.count()) or own(q, *a, **kw))
    df = spark.range(8000).selectExpr("id AS pos", "id % 20 / 2 AS x", "id div 20 % 20 / 2 AS y", "id div 400 / 2D AS z", "1D AS intensity")
    queries = df.select(F.col("pos").alias("id"), F.col("x") + 0.1, "y", "z").toDF("id", "x", "y", "z")
    assert neighbours.nearest_join(queries, df, ((0.0, 10.0),) * 3, 5, 3, cell_points=500).count() == 3 * 8000
    assert sum(moved) < 6 * 8000


@pytest.mark.parametrize("slice_rows", [1 << 20, 300, 40])
def test_levels_leave_second_halves_where_they_are(spark, slice_rows):
    cells = octree.assign_cells(frame(spark, cloud_rows(900, 5, hot=300)), BOX, 2)
    rows = lambda df: sorted((r["cell_code"], r["leaf_code"], r["pos"], r["x"]) for r in df.collect())
    known = reduce.levels_of_detail(cells, slice_rows=slice_rows, depth=2)
    assert list(map(rows, known)) == list(map(rows, reduce.levels_of_detail(cells, slice_rows=slice_rows)))
    held = reduce.first_halves(cells, reduce.slice_counts(cells, 10), 10)
    assert "Exchange hashpartitioning(pos" not in plan(held) and {r["_n"] for r in held.collect()} == {r["n"] for r in cells.groupBy("cell_code").agg(F.count("*").alias("n")).collect()}
    halves = {(r["cell_code"], r["pos"]) for r in held.collect()}
    assert {(r["cell_code"], r["pos"]) for r in known[0].collect()} <= halves and len(halves) < 700


def test_an_upload_is_reduced_once(spark):
    """Messages are made from stored levels: nothing in their plan reads the file or reduces cells again."""
    from voxelspan.plans import upload
    from voxelspan.schema import Options

    out = upload.process(spark, pointview.point_file(spark, SF), Options(clustering=True, lod=True), depth=4)
    made = plan(out.messages)
    assert "BatchScan" not in made and "_keep" not in made
    assert sorted(out.levels) == ["base", "low", "medium"] and out.messages.where("event = 'lod-points'").count() > 0


@pytest.mark.parametrize("slice_rows", [1 << 20, 40, 3])
def test_slices_leave_points_where_they_are(spark, monkeypatch, slice_rows):
    """Counts and places of first halves are moved, points never; with few points in a cell's slice, counts stay few too."""
    kept, own = [], reduce.stored
    monkeypatch.setattr(reduce, "stored", lambda df: kept.append(own(df)) or kept[-1])
    cells = octree.assign_cells(frame(spark, cloud_rows(900, 5, hot=300)), BOX, 2).repartition(5)
    reduced = reduce.reduce_hot_cells(cells, slice_rows)
    assert "Exchange hashpartitioning" not in plan(reduced)
    assert sorted((r["cell_code"], r["pos"], r["x"]) for r in reduced.collect()) == sorted((r["cell_code"], r["pos"], r["x"]) for r in reduce._reduce_whole(cells, ["pos"]).collect())
    n_cells = cells.select("cell_code").distinct().count()
    assert kept and all(df.count() == n_cells for df in kept)


@pytest.mark.parametrize("slice_rows", [1 << 20, 30, 2])
def test_slices_in_the_order_of_two_columns(spark, slice_rows):
    """A place may lie under several values of the first; the same rows as by ranks."""
    cells = octree.assign_cells(frame(spark, cloud_rows(900, 5, hot=300)), BOX, 1).withColumn("leaf_code", F.pmod(F.hash("pos"), F.lit(7)).cast("bigint"))
    order = ["leaf_code", "pos"]
    rows = lambda df: sorted((r["cell_code"], r["leaf_code"], r["pos"]) for r in df.collect())
    assert rows(reduce._reduce_sliced(cells, order, slice_rows)) == rows(reduce._reduce_whole(cells, order))
    assert rows(reduce.reduce_cells(cells, order, slice_rows)) == rows(reduce._reduce_whole(cells, order))


def test_ranges_of_a_large_table_are_few_enough_not_to_be_sorted(spark, monkeypatch):
    many = pointview.header(spark, SF)
    monkeypatch.setattr(pointview, "header", lambda *_: replace(many, count=216_000_000))
    dealt = re.search(r"Exchange rangepartitioning\(.*, (\d+)\)", plan(pointview._numbered_records(spark, SF)))
    assert 4 < int(dealt[1]) <= 200
