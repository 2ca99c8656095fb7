import itertools
import random

import pytest
from pyspark.sql import functions as F

from voxelspan.functions import measure as M
from voxelspan.functions import scalar as P
from voxelspan.operators import cluster, octree, reduce, sample
from voxelspan.schema import FILE_PALETTE, POINT_SCHEMA, Header, Options

BOX = ((0.0, 8.0), (0.0, 8.0), (0.0, 8.0))


def cloud(spark, places, pos=None):
    return spark.createDataFrame([(i if pos is None else pos[i], *map(float, p), 0.0, 0.0, 0.0, float(i % 5), 2.0) for i, p in enumerate(places)], POINT_SCHEMA)


def first_octant(p, box):
    """The first of the eight closed boxes, in the fixed order, that holds p."""
    order = [(0, 0, 0), (0, 1, 0), (0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 0, 0), (1, 1, 0), (1, 1, 1)]
    mid = [lo + (hi - lo) / 2 for lo, hi in box]
    for k, halves in enumerate(order):
        part = [(m, hi) if h else (lo, m) for h, m, (lo, hi) in zip(halves, mid, box)]
        if all(lo <= v <= hi for v, (lo, hi) in zip(p, part)):
            return k, part
    return None


def path(p, box, depth):
    code = 0
    for _ in range(depth):
        got = first_octant(p, box)
        if got is None:
            return None
        k, box = got
        code = code * 8 + k
    return code


def test_cells_are_the_first_box_that_holds_a_point(spark):
    edge = list(itertools.product((0, 2, 4, 5, 8), repeat=3)) + [(-1, 2, 2), (2, 9, 2)]
    got = {r["pos"]: r["cell_code"] for r in octree.assign_cells(cloud(spark, edge), BOX, 3).collect()}
    assert got == {i: c for i, p in enumerate(edge) if (c := path(p, BOX, 3)) is not None}
    drop = octree.dropped(cloud(spark, edge), BOX).first()
    assert (drop["n_points"], drop["n_dropped"]) == (127, 2)


@pytest.mark.parametrize("box", [((0.1, 7.3), (-5.0, 11.0), (1e6, 1e6 + 3)), ((0.0, 1.0), (2.0, 2.0), (0.0, 1.0)), ((0.0, 1.0), (0.0, 1.0), (3.0, 3.0)), ((4.0, 4.0),) * 3])
def test_cells_of_middles_at_every_level(spark, box):
    rng = random.Random(9)
    ends = [octree.edges(lo, hi, 6) for lo, hi in box]
    places = [tuple(rng.choice(e) if rng.random() < 0.6 else rng.uniform(e[0], e[-1]) for e in ends) for _ in range(800)]
    got = {r["pos"]: r["cell_code"] for r in octree.assign_cells(cloud(spark, places), box, 6).collect()}
    assert got == {i: path(p, box, 6) for i, p in enumerate(places)}
    cell, level = got[0] >> 9, 3
    inside = {i for i, p in enumerate(places) if all(lo <= v <= hi for v, (lo, hi) in zip(p, octree.cell_box(cell, level, box)))}
    assert {i for i, c in got.items() if c >> 9 == cell} <= inside


def test_filters_on_cells_stay_above_the_levels(spark):
    cells = octree.assign_cells(cloud(spark, [(1, 1, 1), (7, 7, 7)]), BOX, 8)
    assert len(cells.where(octree.prefix_range(7, 1, 8))._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    assert [r["pos"] for r in cells.where(octree.prefix_range(7, 1, 8)).collect()] == [1]


def keep_by_costs(places):
    """The literal search: the first prefix whose cost is strictly smallest."""
    n = len(places)
    if n <= 1:
        return n
    best, keep = None, 0
    for i in range(1, n // 2 + 1):
        cost = sum(min(sum((a - b) ** 2 for a, b in zip(p, c)) for c in places[:i]) for p in places)
        if best is None or cost < best:
            best, keep = cost, i
    return keep


def random_cells(seed):
    rng = random.Random(seed)
    return [[(rng.randrange(3), rng.randrange(2), 0) for _ in range(rng.randrange(1, 12))] for _ in range(60)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_reduction_is_the_prefix_search(spark, partitions):
    rows, want, pos = [], set(), 0
    for c, places in enumerate(random_cells(partitions)):
        start = pos
        for p in places:
            rows.append((pos, *map(float, p), 0.0, 0.0, 0.0, 1.0, 2.0, c, 1))
            pos += 1
        want |= set(range(start, start + keep_by_costs(places)))
    cells = spark.createDataFrame(rows, POINT_SCHEMA + ", cell_code bigint, depth int").repartition(partitions)
    assert {r["pos"] for r in reduce.reduce_cells(cells).collect()} == want
    assert {r["pos"] for r in reduce.reduce_hot_cells(cells, slice_rows=5).collect()} == want


def test_levels_of_detail_shrink_and_nest(spark):
    rng = random.Random(1)
    pts = cloud(spark, [[rng.uniform(0, 8) for _ in range(3)] for _ in range(400)])
    cells = octree.assign_cells(pts, BOX, 3)
    base, medium, low = reduce.levels_of_detail(cells)
    sets = [{r["pos"] for r in x.collect()} for x in (base, medium, low)]
    assert sets[0] > sets[1] > sets[2]
    assert sets[0] == {r["pos"] for r in reduce.reduce_cells(cells).collect()}
    step = reduce.coarser(reduce.reduce_cells(cells.withColumn("leaf_code", F.col("cell_code"))))
    assert {r["pos"] for r in step.collect()} == sets[1]
    sliced = reduce.levels_of_detail(cells, slice_rows=10)
    assert [{r["pos"] for r in x.collect()} for x in sliced] == sets


def test_numbering_and_chunks(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(5), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, pos bigint").repartition(5)
    got = {r["pos"]: r["rn"] for r in reduce.numbered(df, "g", ["pos"]).collect()}
    assert got == {p: k + 1 for k, (_, p) in enumerate(sorted(rows))}
    chunked = reduce.chunks(df, "g", ["pos"], 162).collect()
    assert {r["total_chunks"] for r in chunked} == {7} and sum(r["chunk_no"] == 6 for r in chunked) == 28
    win = reduce.window_chunks(spark.range(350).withColumnRenamed("id", "pos"), 100, 30).where("pos = 299").first()
    assert (win["window_no"], win["chunk_no"]) == (2, 3)


def test_messages_hold_points_in_order(spark):
    import json

    pts = cloud(spark, [(i, 0, 0) for i in range(5)]).withColumn("g", F.lit(0)).repartition(3)
    texts = sorted((r["chunk_no"], json.loads(r["payload"])) for r in reduce.messages(reduce.chunks(pts, "g", ["pos"], 2)).collect())
    assert [m["points"][::8] for _, m in texts] == [[0.0, 1.0], [2.0, 3.0], [4.0]] and {m["total"] for _, m in texts} == {3}


def test_colours(spark):
    df = spark.createDataFrame([(0, 0.0), (510, 3.0), (0, 6.0), (0, 16.0), (0, 17.0), (0, 255.0), (0, 1.0)], "raw int, cls double")
    got = [r[0] for r in df.select(P.resolved_colour("raw", "cls", 0)).collect()]
    assert got == [1.0, 2.0, 1.0, 1.0, 1.0, 1.0, 1.0] and FILE_PALETTE[6][0] == 255
    assert [r[0] for r in df.select(P.resolved_colour("raw", "cls", 1)).collect()][2] == 168 / 255
    assert [r[0] for r in df.select(P.class_colour(F.lit(0.5), "cls", 2)).collect()] == [1.0, 1 / 255, 0.0, 0.5, 0.5, 0.5, 1.0]
    h = spark.range(1).select(P.hex_colour(F.lit(161), F.lit(2), F.lit(255)).alias("h"))
    assert h.select("h", P.parse_hex("h", 0), P.parse_hex("h", 2)).first()[:] == ("#a102ff", 161, 255)


def shape(*points):
    return [tuple(F.lit(float(v)) for v in p) for p in points]


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_measures(spark):
    a, b, c, e = shape((0, 0, 0), (3, 0, 0), (3, 4, 0), (0, 4, 0))
    assert one(spark, M.length(a, c)) == 5.0
    assert one(spark, M.angle(a, b, c)) == 90.0 and one(spark, M.angle(a, a, c)) is None
    assert one(spark, M.area(a, b, c, e)) == 12.0
    assert [one(spark, x) for x in M.triangle(a, b, c)] == [53.13, 90.0, 36.87]
    assert one(spark, M.triangle(a, b, c, "dragged")[2]) == 36.87
    assert [one(spark, x) for x in M.middle(b, e)] == [1.5, 2.0, 0.0]
    assert one(spark, M.rounded(F.lit(-0.125))) == -0.12 and one(spark, M.rounded(F.lit(0.125))) == 0.13
    assert one(spark, M.height(c, F.lit(10.0), F.lit(14.0))) == 6.0
    low, high = shape((0, 0, 0), (22, 22, 22))
    assert [one(spark, x) for x in M.original(a, low, high)] == [11.0, 11.0, 1.0]
    assert [one(spark, x) for x in M.original(a, low, high, "intended")] == [11.0, 11.0, 11.0]
    assert [tuple(x) for x in one(spark, M.edges(a, b, c, e))] == [(1, 3.0), (2, 4.0), (3, 3.0), (4, 4.0)]


def test_options_and_header():
    assert Options.parse({"clustering": "T", "lod": "yes", "density": "50"}) == Options(True, False, False, 50.0)
    assert Options.parse({"density": "x"}).keep_rate == 0.1 and Options.parse({"clustering": "1", "lod": "true"}).levels == ("base", "medium", "low")
    assert Header(0).total_chunks == 0 and Header(100_001).total_chunks == 618 + 1 and Header(162).total_chunks == 1


def test_clusters(spark):
    pts = cloud(spark, [(0, 0, 0), (1, 0, 0), (10, 0, 0), (11, 0, 0), (5.5, 0, 0)])
    near = cluster.nearest(pts, [(0.5, 0, 0), (10.5, 0, 0)])
    assert [r["cluster_id"] for r in near.orderBy("pos").collect()] == [0, 0, 1, 1, 0]  # a tie goes to the first
    assert {r["cluster_id"]: r["sse"] for r in cluster.cost(near).collect()} == {0: 25.5, 1: 0.5}
    assert cluster.mean_cost(near, 2).first()[0] == 26 / 16
    m = {r["cluster_id"]: (r["x"], r["intensity"]) for r in cluster.means(near.where("pos < 4")).collect()}
    assert m == {0: (0.5, 1.0), 1: (10.5, 3.0)}
    assert sorted(cluster.lloyd(pts.where("pos < 4"), 2)) == [(0.5, 0.0, 0.0), (10.5, 0.0, 0.0)]
    costs = cluster.prefix_costs(pts, "pos", 3)
    assert {r["k"]: r["cost"] for r in costs.collect()} == {1: 252.25, 2: 201.25, 3: 21.25}
    assert cluster.largest_drop(costs).first()[0] == 3
    cells = pts.withColumns({"cell_code": F.lit(1).cast("bigint"), "depth": F.lit(1)})
    assert cluster.lloyd_cells(cells, BOX).count() == 2
    assert [r["pos"] for r in cluster.pick(pts, (2.0, 0.5, 0.0), (1.0, 0.0, 0.0), 1.0).collect()] == [4]
    assert cluster.pick(pts, (2.0, 5.0, 0.0), (1.0, 0.0, 0.0), 1.0).count() == 0


def test_sampling(spark):
    pts = spark.range(20000).withColumnRenamed("id", "pos")
    a, b = (sample.subsample(pts, 0.4, "hash").repartition(n) for n in (1, 5))
    assert {r[0] for r in a.collect()} == {r[0] for r in b.collect()} and abs(a.count() - 8000) < 400
    assert abs(sample.subsample(pts, 0.1, seed=3).count() - 2000) < 300
    assert [tuple(r) for r in sample.stride(pts, 7000, 10000).collect()] == [(0, 0), (7000, 0), (14000, 1)]


def test_view_geometry(spark):
    assert one(spark, P.progress(F.lit(1), F.lit(3))) == 34 and one(spark, P.progress(F.lit(1), F.lit(0))) is None
    assert one(spark, P.screen_position(F.lit(0.0), 801, 1)) == 401 and one(spark, P.screen_position(F.lit(1.0), 600, -1)) == 0
    assert [one(spark, c) for c in P.camera_place(F.lit(3), F.lit(2.0), F.lit(4.0), F.lit(6.0))] == [0.0, 4.0, 0.0]
    assert one(spark, P.exaggerated(F.lit(2.0), 50.0)) == 4.0 and one(spark, P.marker_scale(F.lit(50.0), 75.0)) == 0.5
    assert [one(spark, P.lod_point_size(F.lit(v), 1.0)) for v in ("base", "medium", "low")] == [1.0, 2.0, 4.0]
    assert one(spark, cluster.array_distance(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0)))) == 5.0


def test_two_step_numbering(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(300), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g int, pos bigint").repartition(5)
    got = reduce.numbered(df, "g", ["pos"], coarse=F.floor(F.col("g") / 7), total="n").collect()
    assert {r["pos"]: r["rn"] for r in got} == {p: k + 1 for k, (_, p) in enumerate(sorted(rows))} and {r["n"] for r in got} == {2000}


def test_elbows_and_starts(spark):
    costs = {k: c for k, c in enumerate([100.0, 90.0, 20.0, 18.0, 17.0, 16.5, 16.4], 1)}
    df = spark.createDataFrame(list(costs.items()), "k int, cost double")
    assert cluster.observed_elbow(df).first()[0] == 4
    asked = []
    assert cluster.bisected_elbow(lambda k: asked.append(k) or costs[k], 7) == 3 and len(asked) == len(set(asked))
    assert cluster.bisected_elbow(lambda k: 1.0, 7) in range(1, 9)
    rng = random.Random(4)
    pts = cloud(spark, [[rng.uniform(0, 8) for _ in range(3)] for _ in range(200)])
    assert cluster.seeds(pts.repartition(7), 5) == cluster.seeds(pts.coalesce(1), 5)
    assert cluster.two_means(pts).count() == 2


def test_labels_and_markers(spark):
    assert [one(spark, M.number_text(F.lit(v))) for v in (12.0, 12.5, 12.25, -0.5, -12.04, 0.004, 1e6)] == ["12", "12.5", "12.25", "-0.5", "-12.04", "0", "1000000"]
    mark = lambda tool, n: one(spark, M.is_marker(F.lit(tool), F.array_repeat(F.lit(1), F.lit(n))))
    assert mark("area", 4) and mark("point", 1) and not mark("angle", 2) and not mark("other", 1)
    assert [one(spark, P.parsed_number(F.lit(v))) for v in ("12.5", "x", "", "-3", "100")] == [12.5, 0.0, 0.0, -3.0, 100.0]
