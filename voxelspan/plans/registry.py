"""Every registered query by name, with the DuckDB SQL that must return the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspan.functions import measure as M
from voxelspan.functions import scalar as P
from voxelspan.operators import cluster, metrics, octree, reduce, sample
from voxelspan.plans.pointview import POINTS_SQL, RECORDS_SQL, S, header, lod_sql, octree_sql, palette_sql, point_file, points, records, reduce_sql
from voxelspan.schema import LOD_DISTANCES, VIEW_PALETTE, WINDOW_POINTS
from voxelspan.sources.storage import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
DEPTH = 4
WITH = f"WITH {POINTS_SQL}"
#: Camera, ray and density of the sample queries.
CAMERA, RAY, REACH, DENSITY = (5.0, 2.0, 1.0), (1.0, 0.0, 0.0), 5.0, 50.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def d(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def centred_sql(source: str = "p") -> str:
    move = lambda a: f"{a} + (-((h.{a}2 - h.{a}1) / 2) - h.{a}1)"
    return f"c AS (SELECT pos, {', '.join(f'{move(a)} AS {a}' for a in 'xyz')}, r, g, b, intensity, classification FROM {source}, h)"


# ---- projections


@query(f"{WITH} SELECT pos, x, y, z FROM p")
def scale_axis_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("pos", "x", "y", "z")


@query(f"{WITH}, {centred_sql()} SELECT pos, x, y, z FROM c")
def center_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).withColumns(P.centred(header(spark, sf_dir))).select("pos", "x", "y", "z")


@query(f"""{WITH}, w AS (SELECT *, least(n, 100000) AS win FROM h)
SELECT n AS n_points, win AS window_points, {", ".join(f"-((h{a}) / 2) - {a}1 AS shift_{a}" for a in "xyz").replace("(hx)", "(x2 - x1)").replace("(hy)", "(y2 - y1)").replace("(hz)", "(z2 - z1)")},
CAST(ceil(win * 8 / CAST(1296 AS DOUBLE)) * (n // win) + ceil((n % win) * 8 / CAST(1296 AS DOUBLE)) AS BIGINT) AS total_chunks FROM w""")
def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = header(spark, sf_dir)
    sx, sy, sz = h.shift
    row = (h.count, h.window, sx, sz, sy, h.total_chunks)
    return spark.createDataFrame([row], "n_points bigint, window_points bigint, shift_x double, shift_y double, shift_z double, total_chunks bigint")


@query(f"WITH {RECORDS_SQL} SELECT pos, " + ", ".join(f"{palette_sql(f'i{c}', 'classification', k)} AS {c}" for k, c in enumerate("rgb")) + " FROM rec")
def color_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("pos", "r", "g", "b")


def view_sql(cls: str, k: int, own: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {c[k]}" for i, c in enumerate(VIEW_PALETTE[:12]))
    return f"CASE WHEN {cls} BETWEEN 0 AND 11 THEN CAST(CASE CAST({cls} AS INT) {cases} END AS DOUBLE) / 255 ELSE {own} END"


@query(f"{WITH}, q AS (SELECT *, classification * 2 AS cls FROM p) SELECT pos, " + ", ".join(f"{view_sql('cls', k, c)} AS {c}" for k, c in enumerate("rgb")) + " FROM q")
def class_recolor(spark: SparkSession, sf_dir: str) -> DataFrame:
    cls = F.col("classification") * 2  # some classes beyond the palette
    return points(spark, sf_dir).select("pos", *[P.class_colour(c, cls, k).alias(c) for k, c in enumerate("rgb")])


@query(f"WITH {RECORDS_SQL} SELECT pos, '#' || printf('%02x%02x%02x', ir, ig, ib) AS colour, ir AS r, ig AS g FROM rec")
def class_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = records(spark, sf_dir).select("pos", P.hex_colour(F.col("ir"), F.col("ig"), F.col("ib")).alias("colour"))
    return df.withColumns({"r": P.parse_hex("colour", 0), "g": P.parse_hex("colour", 1)})


@query(f"{WITH} SELECT pos, intensity / (SELECT max(intensity) FROM p) AS alpha FROM p")
def intensity_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = points(spark, sf_dir).select("pos", "intensity")
    top = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.max("l_quantity").alias("_top"))  # one row
    return df.join(F.broadcast(top)).select("pos", (F.col("intensity") / F.col("_top")).alias("alpha"))


@query(f"{WITH} SELECT pos, y * {d(1.0 + 2.0 * (25.0 / 100.0))} AS y FROM p")
def z_exaggerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("pos", P.exaggerated("y", 25.0).alias("y"))


def dist_sql(a: str = "", c: tuple = CAMERA) -> str:
    return "sqrt(" + " + ".join(f"({a}{n} - {d(v)}) * ({a}{n} - {d(v)})" for n, v in zip("xyz", c)) + ")"


@query(f"{WITH} SELECT pos, {dist_sql()} AS dist, {d(3.0)} / {dist_sql()} AS size FROM p")
def camera_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    dist = P.distance(("x", "y", "z"), tuple(F.lit(v) for v in CAMERA))
    return points(spark, sf_dir).select("pos", dist.alias("dist")).withColumn("size", P.point_size(3.0, F.col("dist")))


MATRIX = [[0.8, 0.1, 0.0, -5.0], [0.0, 1.2, 0.3, 2.0], [0.1, 0.0, -1.01, -0.2], [0.0, 0.001, -1.0, 60.0]]


def matrix_sql(row: list[float]) -> str:
    return "(" + " + ".join([d(0.0), *[f"{d(m)} * {a}" for m, a in zip(row, "xyz")], d(row[3])]) + ")"


@query(f"""{WITH}, t AS (SELECT pos, {", ".join(f"{matrix_sql(r)} AS {n}" for r, n in zip(MATRIX, ("tx", "ty", "tz", "tw")))} FROM p)
SELECT pos, CAST(floor(({d(0.5)} + {d(1.0)} * (tx / tw) / {d(2.0)}) * {d(800.0)} + {d(0.5)}) AS INT) AS px,
CAST(floor(({d(0.5)} + {d(-1.0)} * (ty / tw) / {d(2.0)}) * {d(600.0)} + {d(0.5)}) AS INT) AS py, tz / tw < 1 AS visible FROM t WHERE abs(tw) > {d(0.5)}""")
def screen_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z, w = P.transformed(MATRIX, ("x", "y", "z"))
    t = points(spark, sf_dir).select("pos", x.alias("tx"), y.alias("ty"), z.alias("tz"), w.alias("tw")).where(F.abs(F.col("tw")) > 0.5)
    return t.select("pos", P.screen_position(F.col("tx") / F.col("tw"), 800, 1).alias("px"), P.screen_position(F.col("ty") / F.col("tw"), 600, -1).alias("py"), (F.col("tz") / F.col("tw") < 1).alias("visible"))


@query(f"{WITH} SELECT pos, {dist_sql()} / {d(100.0)} * {d(60.0 / 75.0)} AS perspective, {dist_sql()} / {d(100.0)} * {d(1.0)} AS orthographic FROM p")
def marker_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = points(spark, sf_dir).select("pos", P.distance(("x", "y", "z"), tuple(F.lit(v) for v in CAMERA)).alias("d"))
    return df.select("pos", P.marker_scale(F.col("d"), 60.0).alias("perspective"), P.marker_scale(F.col("d"), 60.0, True).alias("orthographic"))


@query(f"""{WITH}, e AS (SELECT x2 - x1 AS dx, y2 - y1 AS dy, z2 - z1 AS dz FROM h), k AS (SELECT unnest([1, 2, 3]) AS kind)
SELECT kind, CASE WHEN kind = 3 THEN 0 ELSE {d(0.5)} * dx END AS x, CASE WHEN kind = 3 THEN dy ELSE {d(0.75)} * dy END AS y, CASE WHEN kind = 3 THEN 0 ELSE -dz END AS z FROM e, k""")
def camera_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    (x1, x2), (y1, y2), (z1, z2) = header(spark, sf_dir).box()
    kinds = spark.createDataFrame([(1,), (2,), (3,)], "kind int")
    return kinds.select("kind", *[c.alias(a) for a, c in zip("xyz", P.camera_place("kind", F.lit(x2 - x1), F.lit(y2 - y1), F.lit(z2 - z1)))])


@query(f"{WITH} SELECT x2 - x1 AS width, z2 - z1 AS length, -(y2 - y1) / 2 AS level FROM h")
def ground_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = header(spark, sf_dir)
    d_ = [b - a for a, b in zip(h.low, h.high)]
    return spark.createDataFrame([(d_[0], d_[1], -d_[2] / 2)], "width double, length double, level double")


# ---- filters and sampling

HASHED = "((pos % 1000003) * 7919 + 104729) % 1000000"


@query(f"{WITH} SELECT pos, x, y, z FROM p WHERE {HASHED} <= 400000")
def subsample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.subsample(points(spark, sf_dir), 0.1 + DENSITY / 100 * 0.6, "hash").select("pos", "x", "y", "z")


@query()
def subsample_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.subsample(points(spark, sf_dir), 0.1 + DENSITY / 100 * 0.6, seed=7).select("pos", "x", "y", "z")


@query(f"{WITH} SELECT pos, x, pos // 10000 AS batch_no FROM p WHERE pos % 7 = 0")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.stride(points(spark, sf_dir), 7, 10_000).select("pos", "x", "batch_no")


INNER = ", ".join(f"{a}1 + ({a}2 - {a}1) / 4 AS {a}3, {a}2 - ({a}2 - {a}1) / 4 AS {a}4" for a in "xyz")


@query(f"{WITH}, i AS (SELECT {INNER} FROM h) SELECT pos, x, y, z FROM p, i WHERE " + " AND ".join(f"{a} >= {a}3 AND {a} <= {a}4" for a in "xyz"))
def bounds_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where(octree.in_box(_inner(spark, sf_dir))).select("pos", "x", "y", "z")


def _inner(spark: SparkSession, sf_dir: str):
    return tuple((lo + (hi - lo) / 4, hi - (hi - lo) / 4) for lo, hi in header(spark, sf_dir).box())


@query(f"{WITH}, i AS (SELECT {INNER} FROM h) SELECT count(*) AS n_points, CAST(sum(CASE WHEN " + " AND ".join(f"{a} >= {a}3 AND {a} <= {a}4" for a in "xyz") + " THEN 0 ELSE 1 END) AS BIGINT) AS n_dropped FROM p, i")
def bounds_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octree.dropped(points(spark, sf_dir), _inner(spark, sf_dir))


@query(f"{WITH} SELECT pos // {WINDOW_POINTS} AS window_no, count(*) AS n_points, min(pos) AS first_pos, max(pos) AS last_pos FROM p GROUP BY 1")
def window_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = points(spark, sf_dir).select("pos", F.floor(F.col("pos") / F.lit(WINDOW_POINTS)).alias("window_no"))
    return df.groupBy("window_no").agg(F.count("*").alias("n_points"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


# ---- octree, reduction, levels of detail


def cells(spark: SparkSession, sf_dir: str, depth: int = DEPTH) -> DataFrame:
    return octree.assign_cells(points(spark, sf_dir), header(spark, sf_dir).box(), depth)


@query(f"{WITH}, {octree_sql(8)} SELECT pos, cell_code FROM cells")
def octree_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir, 8).select("pos", "cell_code")


@query(f"{WITH}, {octree_sql(DEPTH)} SELECT cell_code, count(*) AS n_points, {', '.join(f'{f}({a}) AS {f}_{a}' for a in 'xyz' for f in ('min', 'max'))}, max(intensity) AS max_intensity FROM cells GROUP BY cell_code")
def octree_cell_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octree.cell_stats(cells(spark, sf_dir))


@query(f"{WITH}, {octree_sql(DEPTH)} SELECT pos, cell_code FROM cells WHERE cell_code // 64 = 37")
def octree_prefix_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = header(spark, sf_dir).box()
    near = points(spark, sf_dir).where(octree.in_box(octree.cell_box(37, 2, box)))  # coordinates are compared before cells are computed
    return octree.assign_cells(near, box, DEPTH).where(octree.prefix_range(37, 2, DEPTH)).select("pos", "cell_code")


@query(f"{WITH}, {octree_sql(DEPTH)}, {reduce_sql('cells', 'base')} SELECT cell_code, pos, x, y, z FROM base")
def cell_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.reduce_cells(cells(spark, sf_dir)).select("cell_code", "pos", "x", "y", "z")


@query(ORACLES["cell_reduce"])
def cell_reduce_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.reduce_hot_cells(cells(spark, sf_dir), slice_rows=10_000).select("cell_code", "pos", "x", "y", "z")


def lod(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return reduce.levels_of_detail(cells(spark, sf_dir), depth=DEPTH)


@query(f"{WITH}, {lod_sql(DEPTH)} SELECT cell_code, leaf_code, pos, x, y, z FROM medium")
def lod_medium(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lod(spark, sf_dir)[1].select("cell_code", "leaf_code", "pos", "x", "y", "z")


@query(f"{WITH}, {lod_sql(DEPTH)} SELECT cell_code, leaf_code, pos, x, y, z FROM low")
def lod_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lod(spark, sf_dir)[2].select("cell_code", "leaf_code", "pos", "x", "y", "z")


@query(f"""{WITH}, {lod_sql(DEPTH)}, a AS (SELECT 'base' AS level, 0 AS shown_from, * FROM base UNION ALL SELECT 'medium', 200, * FROM medium UNION ALL SELECT 'low', 400, * FROM low),
s AS (SELECT *, {dist_sql()} AS dist FROM a) SELECT level, shown_from, pos, CASE level WHEN 'low' THEN 4 * {d(1.5)} WHEN 'medium' THEN 2 * {d(1.5)} ELSE {d(1.5)} END AS size FROM s
WHERE level = CASE WHEN dist >= 400 THEN 'low' WHEN dist >= 200 THEN 'medium' ELSE 'base' END""")
def lod_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a viewer shows: each place from the level that its distance calls for."""
    parts = [df.select("pos", "x", "y", "z", F.lit(n).alias("level"), F.lit(v).alias("shown_from")) for df, (n, v) in zip(lod(spark, sf_dir), LOD_DISTANCES.items())]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    dist = P.distance(("x", "y", "z"), tuple(F.lit(v) for v in CAMERA))
    wanted = F.when(dist >= 400, "low").when(dist >= 200, "medium").otherwise("base")
    return every.where(F.col("level") == wanted).select("level", "shown_from", "pos", P.lod_point_size("level", 1.5).alias("size"))


@query(f"""{WITH}, i AS (SELECT {INNER} FROM h), {lod_sql(DEPTH)} SELECT 'raw' AS stage, count(*) AS n_points FROM p UNION ALL SELECT 'sampled', count(*) FROM p WHERE {HASHED} <= 400000
UNION ALL SELECT 'reduced', count(*) FROM base UNION ALL SELECT 'medium', count(*) FROM medium UNION ALL SELECT 'low', count(*) FROM low""")
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From one run of the levels of detail."""
    names = ("reduced", "medium", "low")
    with metrics.Stages(spark) as seen:
        raw = seen.watch("raw", points(spark, sf_dir), sampled=sample.hashed(F.col("pos")) <= 400_000)
        levels = reduce.levels_of_detail(octree.assign_cells(raw, header(spark, sf_dir).box(), DEPTH), watch=lambda k, level: seen.watch(names[k], level), depth=DEPTH)
        seen.run(levels[-1])
    return seen.counts()


@query("""SELECT event_type AS name, count(*) AS n_samples, CAST(sum(CAST(floor(value) AS BIGINT)) - arg_min(CAST(floor(value) AS BIGINT), event_id) AS BIGINT) AS total_ms,
CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS intended_ms FROM events GROUP BY event_type""")
def time_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of time: their type the name, their value whole milliseconds."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("name"), F.col("event_id").alias("seq"), F.floor("value").alias("ms"))
    return metrics.time_totals(e).join(metrics.time_totals(e, "intended").select("name", F.col("total_ms").alias("intended_ms")), "name")


# ---- messages

CHUNKED = f"{WITH}, {octree_sql(DEPTH)}, {reduce_sql('cells', 'base')}, k AS (SELECT pos, (row_number() OVER (ORDER BY cell_code, pos) - 1) // 162 AS chunk_no, CAST(ceil(count(*) OVER () / CAST(162 AS DOUBLE)) AS BIGINT) AS total_chunks FROM base)"


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.chunks(reduce.reduce_cells(cells(spark, sf_dir)), "cell_code", ["pos"], depth=DEPTH)


@query(f"{CHUNKED} SELECT * FROM k")
def chunk_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir).select("pos", "chunk_no", "total_chunks")


@query(f"{CHUNKED} SELECT chunk_no, count(*) AS n_points, CAST(ceil((chunk_no + 1) / CAST(max(total_chunks) AS DOUBLE) * 100) AS BIGINT) AS percent FROM k GROUP BY chunk_no")
def chunk_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _chunked(spark, sf_dir).groupBy("chunk_no").agg(F.count("*").alias("n_points"), F.max("total_chunks").alias("t"))
    return per.select("chunk_no", "n_points", P.progress(F.col("chunk_no") + 1, F.col("t")).alias("percent"))


@query(f"{WITH} SELECT pos // {WINDOW_POINTS} AS window_no, pos % {WINDOW_POINTS} // 162 AS chunk_no, count(*) AS n_points, max(pos) AS last_pos FROM p GROUP BY 1, 2")
def chunk_points_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reduce.window_chunks(points(spark, sf_dir))
    return df.groupBy("window_no", "chunk_no").agg(F.count("*").alias("n_points"), F.max("pos").alias("last_pos"))


@query()
def chunk_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.messages(_chunked(spark, sf_dir))


# ---- clusters

FIRST = "f AS (SELECT pos AS i, x, y, z FROM p WHERE pos < 8)"
NEAREST = f"""{WITH}, {FIRST}, dd AS (SELECT p.pos, p.intensity, p.x, p.y, p.z, p.classification, f.i, (p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y) + (p.z - f.z) * (p.z - f.z) AS d2 FROM p, f),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY d2, i) AS k FROM dd) WHERE k = 1)"""


def _centroids(spark: SparkSession, sf_dir: str) -> cluster.Centroids:
    return _first(spark, sf_dir, 8)


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.nearest(points(spark, sf_dir), _centroids(spark, sf_dir))


@query(f"{NEAREST} SELECT pos, CAST(i AS INT) AS cluster_id, d2 FROM n")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("pos", "cluster_id", "d2")


@query(f"{NEAREST} SELECT CAST(i AS INT) AS cluster_id, count(*) AS n_points, CAST(round(sum(d2) / 1000) AS BIGINT) AS sse_k FROM n GROUP BY i")
def cluster_sse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cost(_assigned(spark, sf_dir)).select("cluster_id", "n_points", F.round(F.col("sse") / 1000).cast("bigint").alias("sse_k"))


@query(f"{NEAREST} SELECT CAST(round(sum(d2) / 64 / 1000) AS BIGINT) AS mean_cost_k FROM n")
def cluster_mean_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.mean_cost(_assigned(spark, sf_dir), 8).select(F.round(F.col("mean_cost") / 1000).cast("bigint").alias("mean_cost_k"))


@query(f"{NEAREST} SELECT CAST(i AS INT) AS cluster_id, round(avg(x), 3) AS x, round(avg(y), 3) AS y, round(avg(z), 3) AS z, round(avg(classification), 3) AS classification, max(intensity) AS intensity FROM n GROUP BY i")
def cluster_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = cluster.means(_assigned(spark, sf_dir))
    return m.select("cluster_id", *[F.round(c, 3).alias(c) for c in ("x", "y", "z", "classification")], "intensity")


@query(f"""{WITH}, {FIRST}, dd AS (SELECT p.pos, f.i, (p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y) + (p.z - f.z) * (p.z - f.z) AS d2 FROM p, f),
m AS (SELECT pos, i, min(d2) OVER (PARTITION BY pos ORDER BY i) AS d2 FROM dd) SELECT CAST(i + 1 AS INT) AS k, CAST(round(sum(d2) / 1000) AS BIGINT) AS cost_k FROM m GROUP BY i""")
def prefix_cost_elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.prefix_costs(points(spark, sf_dir), "pos", 8).select("k", F.round(F.col("cost") / 1000).cast("bigint").alias("cost_k"))


COSTS = f"""{WITH}, {FIRST}, dd AS (SELECT p.pos, f.i, (p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y) + (p.z - f.z) * (p.z - f.z) AS d2 FROM p, f),
m AS (SELECT pos, i, min(d2) OVER (PARTITION BY pos ORDER BY i) AS d2 FROM dd), costs AS (SELECT CAST(i + 1 AS INT) AS k, sum(d2) AS cost FROM m GROUP BY i)"""


@query(f"{COSTS} SELECT k FROM (SELECT k, lag(cost) OVER (ORDER BY k) - cost AS fall FROM costs) WHERE fall IS NOT NULL ORDER BY fall DESC, k LIMIT 1")
def elbow_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.largest_drop(cluster.prefix_costs(points(spark, sf_dir), "pos", 8))


@query(f"{COSTS} SELECT k FROM costs WHERE k >= 4 AND k % 3 = 1 ORDER BY cost DESC, k LIMIT 1")
def elbow_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.observed_elbow(cluster.prefix_costs(points(spark, sf_dir), "pos", 8))


def lloyd_sql(k: int, passes: int, tag: str = "") -> str:
    """CTEs c0 to c_passes (centroids) and last (points with their nearest of c_passes), named with the tag."""
    near = lambda r: f"(SELECT * FROM (SELECT p.*, c.i, (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) + (p.z - c.z) * (p.z - c.z) AS d2 FROM p, c{tag}{r} AS c) QUALIFY row_number() OVER (PARTITION BY pos ORDER BY d2, i) = 1)"
    out = [f"c{tag}0 AS MATERIALIZED (SELECT pos AS i, x, y, z FROM p WHERE pos < {k})"]
    for r in range(passes):
        out.append(f"m{tag}{r} AS MATERIALIZED (SELECT i, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM {near(r)} GROUP BY i)")
        out.append(f"c{tag}{r + 1} AS MATERIALIZED (SELECT c.i, coalesce(m.x, c.x) AS x, coalesce(m.y, c.y) AS y, coalesce(m.z, c.z) AS z FROM c{tag}{r} AS c LEFT JOIN m{tag}{r} AS m USING (i))")
    return ",\n".join([*out, f"last{tag} AS (SELECT * FROM {near(passes)})"])


BISECTED = ",\n".join(lloyd_sql(k, 3, f"_{k}_") for k in range(1, 7)) + ",\ncost AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {k} AS k, sum(d2) AS c FROM last_{k}_" for k in range(1, 7)) + """),
fall AS MATERIALIZED (SELECT k, CASE WHEN k BETWEEN 2 AND 6 THEN abs(lag(c) OVER (ORDER BY k) - c) ELSE 0 END AS f FROM (SELECT * FROM cost UNION ALL SELECT unnest([0, 7]), 0)),
step AS (SELECT 1 AS low, 7 AS high, CAST(NULL AS INT) AS found UNION ALL
    SELECT CASE WHEN a.f >= b.f AND b.f >= c.f THEN low ELSE b.k + 1 END, CASE WHEN a.f >= b.f AND b.f >= c.f THEN b.k ELSE high END, CASE WHEN a.f < b.f AND b.f > c.f THEN b.k END
    FROM step JOIN fall AS b ON b.k = (low + high) // 2 JOIN fall AS a ON a.k = b.k - 1 JOIN fall AS c ON c.k = b.k + 1 WHERE found IS NULL AND low < high)"""


@query(f"{WITH.replace('WITH', 'WITH RECURSIVE', 1)}, {BISECTED} SELECT CAST(coalesce(max(found), 7) AS INT) AS k FROM step")
def elbow_bisected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By halving over the costs of Lloyd's iterations."""
    p = points(spark, sf_dir)
    cost = lambda k: cluster.nearest(p, cluster.lloyd(p, k, 3, _first(spark, sf_dir, k))).agg(F.sum("d2")).first()[0]
    return spark.createDataFrame([(cluster.bisected_elbow(cost, 6),)], "k int")


def _first(spark: SparkSession, sf_dir: str, k: int) -> cluster.Centroids:
    return [(r["x"], r["y"], r["z"]) for r in points(spark, sf_dir).where(F.col("pos") < k).orderBy("pos").collect()]


@query(f"{WITH}, {lloyd_sql(4, 10)} SELECT CAST(i AS INT) AS cluster_id, count(*) AS n_points, CAST(round(sum(d2) / 1000) AS BIGINT) AS sse_k FROM last GROUP BY i")
def kmeans_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    found = cluster.cost(cluster.nearest(p, cluster.lloyd(p, 4, 10, _first(spark, sf_dir, 4))))
    return found.select("cluster_id", "n_points", F.round(F.col("sse") / 1000).cast("bigint").alias("sse_k"))


TURNED = lambda v: f"floor({v} * 1000 + {d(cluster.TURN)}) / 1000"


@query(f"{WITH}, {lloyd_sql(2, 8)} SELECT CAST(i AS INT) AS cluster_id, " + ", ".join(f"{TURNED(f'avg({a})')} AS {a}" for a in ("x", "y", "z", "classification")) + ", max(intensity) AS intensity FROM last GROUP BY i")
def viewer_two_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = cluster.two_means(points(spark, sf_dir), 8, _first(spark, sf_dir, 2))
    return m.select("cluster_id", *[cluster.rounded(F.col(a)).alias(a) for a in ("x", "y", "z", "classification")], "intensity")


SEVENS = """v AS (SELECT pos * 8 + unnest(range(8)) AS j, unnest([x, y, z, r, g, b, intensity, classification]) AS v FROM q),
p AS MATERIALIZED (SELECT j // 7 AS pos, """ + ", ".join(f"max(CASE WHEN j % 7 = {i} THEN v END) AS {a}" for i, a in enumerate(("x", "y", "z", "r", "g", "b", "alpha"))) + " FROM v GROUP BY j // 7 HAVING count(*) = 7)"
SEVENS_WITH = f"WITH {POINTS_SQL.replace('p AS (', 'q AS (').replace('FROM p)', 'FROM q)')}, {SEVENS}"


def _sevens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.by_sevens(points(spark, sf_dir))


@query(f"{SEVENS_WITH} SELECT * FROM p")
def viewer_sevens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All groups of seven values that the viewer takes for points."""
    return _sevens(spark, sf_dir)


@query(f"{SEVENS_WITH}, {lloyd_sql(2, 8)} SELECT CAST(i AS INT) AS cluster_id, count(*) AS n_groups, " + ", ".join(f"{TURNED(f'avg({a})')} AS {a}" for a in ("x", "y", "z", "r", "g", "b")) + ", greatest(max(alpha), 0) AS alpha FROM last GROUP BY i")
def viewer_seven_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two means of those groups, as observed; the first two groups begin."""
    groups = stored(_sevens(spark, sf_dir))
    start = [(r["x"], r["y"], r["z"]) for r in groups.where("pos < 2").orderBy("pos").collect()]
    m = cluster.seven_means(groups, 8, start)
    return m.select("cluster_id", "n_groups", *[cluster.rounded(F.col(a)).alias(a) for a in ("x", "y", "z", "r", "g", "b")], "alpha")


def cell_means_sql(depth: int, passes: int) -> str:
    """CTE ``last``: points with the number of their cluster (i) within their cell."""
    near = lambda r: f"(SELECT s.*, c.i, (s.x - c.x) * (s.x - c.x) + (s.y - c.y) * (s.y - c.y) + (s.z - c.z) * (s.z - c.z) AS d2 FROM s JOIN g{r} AS c USING (cell_code) QUALIFY row_number() OVER (PARTITION BY pos ORDER BY d2, i) = 1)"
    out = [octree_sql(depth), "s AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY cell_code) AS n, row_number() OVER (PARTITION BY cell_code ORDER BY pos) - 1 AS rk FROM cells)"]
    out.append("w AS (SELECT cell_code, any_value(n) AS n, unnest(range(greatest(any_value(n) // 2, 1))) AS i FROM s GROUP BY cell_code)")
    out.append("g0 AS MATERIALIZED (SELECT w.cell_code, w.i, s.x, s.y, s.z FROM w JOIN s ON s.cell_code = w.cell_code AND s.rk = w.i * (w.n - 1) // greatest(w.n // 2 - 1, 1))")
    for r in range(passes - 1):
        out.append(f"mm{r} AS MATERIALIZED (SELECT cell_code, i, {', '.join(f'{TURNED(f"avg({a})")} AS {a}' for a in 'xyz')} FROM {near(r)} GROUP BY ALL)")
        out.append(f"g{r + 1} AS MATERIALIZED (SELECT c.cell_code, c.i, {', '.join(f'coalesce(m.{a}, c.{a}) AS {a}' for a in 'xyz')} FROM g{r} AS c LEFT JOIN mm{r} AS m USING (cell_code, i))")
    return ",\n".join([*out, f"last AS (SELECT * FROM {near(passes - 1)})"])


@query(f"{WITH}, {cell_means_sql(3, 10)} SELECT cell_code, min(pos) AS pos, " + ", ".join(f"{TURNED(f'avg({a})')} AS {a}" for a in ("x", "y", "z", "classification")) + ", max(intensity) AS intensity FROM last GROUP BY cell_code, i")
def cell_means_intended(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cells(spark, sf_dir, 3).select("cell_code", "depth", "pos", "x", "y", "z", "classification", "intensity")
    means = cluster.lloyd_cells(own, header(spark, sf_dir).box())
    return means.select("cell_code", "pos", *[cluster.rounded(F.col(a)).alias(a) for a in ("x", "y", "z", "classification")], "intensity")


def seeds_sql(k: int, rounds: int, factor: float) -> str:
    """CTEs of the rounds of k-means||, of which the last is ``heavy``: candidates and their weights."""
    unit = lambda t: f"((pos + {t * 48271}) % 1000003 * 7919 + 104729) % 1000000 / {d(1000000.0)}"
    dist = "(p.x - a.x) * (p.x - a.x) + (p.y - a.y) * (p.y - a.y) + (p.z - a.z) * (p.z - a.z)"
    out = [f"a0 AS MATERIALIZED (SELECT 0 AS turn, pos, x, y, z FROM p ORDER BY {unit(0)}, pos LIMIT 1)"]
    for t in range(1, rounds + 1):
        out.append(f"d{t} AS MATERIALIZED (SELECT p.pos, any_value(p.x) AS x, any_value(p.y) AS y, any_value(p.z) AS z, min({dist}) AS d2 FROM p, a{t - 1} AS a GROUP BY p.pos)")
        out.append(f"a{t} AS MATERIALIZED (SELECT * FROM a{t - 1} UNION ALL SELECT {t}, pos, x, y, z FROM d{t}, (SELECT sum(d2) AS cost FROM d{t}) WHERE {unit(t)} * cost < {d(factor * k)} * d2)")
    out.append(f"near AS (SELECT p.pos AS pos, a.pos AS seed FROM p, a{rounds} AS a QUALIFY row_number() OVER (PARTITION BY p.pos ORDER BY {dist}, a.turn, a.pos) = 1)")
    return ",\n".join([*out, "heavy AS (SELECT seed AS pos, count(*) AS weight FROM near GROUP BY seed)"])


@query(f"{WITH}, {seeds_sql(8, 2, 2.0)} SELECT pos, weight FROM heavy")
def kmeans_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for eight seeds: two rounds of oversampling, and the points that are nearest to each."""
    found = cluster.candidate_seeds(points(spark, sf_dir), 8, 2, 2.0)
    return spark.createDataFrame([(c[0], c[4]) for c in found], "pos bigint, weight bigint")


@query(f"""{WITH}, t AS (SELECT *, {" + ".join(f"({a} - {d(o)}) * {d(v)}" for a, o, v in zip("xyz", CAMERA, RAY))} AS t FROM p),
o AS (SELECT *, {" + ".join(f"({a} - {d(o)}) * ({a} - {d(o)})" for a, o in zip("xyz", CAMERA))} - t * t AS off2 FROM t)
SELECT pos, x, y, z FROM o WHERE t >= 0 AND off2 <= {d(REACH * REACH)} ORDER BY t, pos LIMIT 1""")
def pick_ray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.pick(points(spark, sf_dir), CAMERA, RAY, REACH).select("pos", "x", "y", "z")


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])), 6) AS dist FROM embeddings, q
WHERE vec_id <> 0 ORDER BY dist, vec_id LIMIT 10""")
def embedding_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows nearest to row 0."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    one = F.broadcast(e.where("vec_id = 0").select(F.col("e").alias("q")))  # one row
    d_ = F.round(cluster.array_distance(F.col("e"), F.col("q")), 6)
    return e.where("vec_id <> 0").join(one).select("vec_id", d_.alias("dist")).orderBy("dist", "vec_id").limit(10)


# ---- measurements: consecutive points as shapes

SHAPES = f"""{WITH}, {centred_sql()}, s AS (SELECT pos // 4 AS shape_id, {", ".join(f"max(CASE WHEN pos % 4 = {k - 1} THEN {a} END) AS {a}{k}" for k in (1, 2, 3, 4) for a in "xyz")} FROM c GROUP BY 1 HAVING count(*) = 4)"""


def rnd_sql(v: str) -> str:
    return f"floor(({v}) * {d(100.0)} + {d(0.5)}) / {d(100.0)}"


def len_sql(a: int, b: int) -> str:
    return "sqrt(" + " + ".join(f"({n}{a} - {n}{b}) * ({n}{a} - {n}{b})" for n in "xyz") + ")"


def angle_sql(a: int, at: int, c: int) -> str:
    dot = " + ".join(f"({n}{a} - {n}{at}) * ({n}{c} - {n}{at})" for n in "xyz")
    size = lambda k: "(" + " + ".join(f"({n}{k} - {n}{at}) * ({n}{k} - {n}{at})" for n in "xyz") + ")"
    return f"CASE WHEN {size(a)} * {size(c)} > 0 THEN " + rnd_sql(f"acos(least(greatest(({dot}) / sqrt({size(a)} * {size(c)}), {d(-1.0)}), {d(1.0)})) * {d(180.0)} / {d(3.141592653589793)}") + " END"


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shape_id and p1 to p4 of every four consecutive centred points."""
    c = points(spark, sf_dir).withColumns(P.centred(header(spark, sf_dir)))
    at = lambda k, a: F.max(F.when(F.pmod(F.col("pos"), F.lit(4)) == k - 1, F.col(a))).alias(f"{a}{k}")
    # numbers, not structs: those are aggregated by hashing, without sorting all points
    flat = c.groupBy(F.floor(F.col("pos") / 4).alias("shape_id")).agg(*[at(k, a) for k in (1, 2, 3, 4) for a in "xyz"], F.count("*").alias("_n")).where("_n = 4")
    return flat.select("shape_id", *[F.struct(*[F.col(f"{a}{k}").alias(a) for a in "xyz"]).alias(f"p{k}") for k in (1, 2, 3, 4)])


def corners() -> list[M.Point]:
    return [M.point_of(f"p{k}") for k in (1, 2, 3, 4)]


@query(f"{SHAPES} SELECT shape_id, x1 + (h.x1_ + (h.x2_ - h.x1_) / 2) AS x, y1 + (h.y1_ + (h.y2_ - h.y1_) / 2) AS y, z1 + (h.z1_ + (h.z2_ - h.z1_) / 22) AS z FROM s, (SELECT x1 AS x1_, x2 AS x2_, y1 AS y1_, y2 AS y2_, z1 AS z1_, z2 AS z2_ FROM h) AS h")
def measure_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = header(spark, sf_dir).box()
    o = M.original(corners()[0], tuple(F.lit(b[0]) for b in box), tuple(F.lit(b[1]) for b in box))
    return shapes(spark, sf_dir).select("shape_id", *[c.alias(a) for a, c in zip("xyz", o)])


@query(f"{SHAPES} SELECT shape_id, {rnd_sql(len_sql(1, 2))} AS length FROM s")
def measure_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes(spark, sf_dir).select("shape_id", M.length(*corners()[:2]).alias("length"))


@query(f"{SHAPES} SELECT shape_id, " + ", ".join(f"least({a}1, {a}2) + abs({a}1 - {a}2) / 2 AS {a}" for a in "xyz") + ", " + ", ".join(f"({a}1 + {a}2 + {a}3 + {a}4) / 4 AS mean_{a}" for a in "xyz") + " FROM s")
def measure_midpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    mid, mean = M.middle(*corners()[:2]), M.mean_point(*corners())
    return shapes(spark, sf_dir).select("shape_id", *[c.alias(a) for a, c in zip("xyz", mid)], *[c.alias(f"mean_{a}") for a, c in zip("xyz", mean)])


@query(f"{SHAPES} SELECT shape_id, {angle_sql(1, 2, 3)} AS angle FROM s")
def measure_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes(spark, sf_dir).select("shape_id", M.angle(*corners()[:3]).alias("angle"))


@query(f"{SHAPES}, a AS (SELECT shape_id, {angle_sql(2, 1, 3)} AS a1, {angle_sql(1, 2, 3)} AS a2, {angle_sql(1, 3, 2)} AS a3 FROM s) SELECT *, {rnd_sql(f'{d(180.0)} - a1 - a2')} AS a3_dragged FROM a")
def measure_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    a1, a2, a3 = M.triangle(*corners()[:3])
    return shapes(spark, sf_dir).select("shape_id", a1.alias("a1"), a2.alias("a2"), a3.alias("a3"), M.triangle(*corners()[:3], "dragged")[2].alias("a3_dragged"))


@query(f"""{SHAPES}, a AS (SELECT *, {angle_sql(1, 2, 3)} * {d(3.141592653589793)} / {d(180.0)} AS r1, {angle_sql(3, 4, 1)} * {d(3.141592653589793)} / {d(180.0)} AS r2 FROM s)
SELECT shape_id, {rnd_sql(f"{d(0.5)} * ({len_sql(1, 2)} * {len_sql(3, 2)} * sin(r1) + {len_sql(1, 4)} * {len_sql(3, 4)} * sin(r2))")} AS area FROM a""")
def measure_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes(spark, sf_dir).select("shape_id", M.area(*corners()).alias("area"))


@query(f"{SHAPES} SELECT shape_id, {rnd_sql('s.y1 - (h.low - (h.low + (h.high - h.low) / 2))')} AS height FROM s, (SELECT y1 AS low, y2 AS high FROM h) AS h")
def measure_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = header(spark, sf_dir).box()[1]
    return shapes(spark, sf_dir).select("shape_id", M.height(corners()[0], F.lit(lo), F.lit(hi)).alias("height"))


@query(f"{SHAPES} " + " UNION ALL ".join(f"SELECT shape_id, {i} AS edge_no, {rnd_sql(len_sql(a, b))} AS length FROM s" for i, (a, b) in enumerate(((1, 2), (2, 3), (3, 4), (4, 1)), 1)))
def measure_quad_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes(spark, sf_dir).select("shape_id", F.explode(M.edges(*corners())).alias("e")).select("shape_id", "e.edge_no", "e.length")


@query("""WITH c AS (SELECT user_id, event_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 3 AS shape_no FROM events)
SELECT user_id, shape_no, min(event_id) AS first_click, count(*) AS n_clicks FROM c GROUP BY user_id, shape_no HAVING count(*) = 3""")
def click_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelspan.streaming.assembly import click_shapes

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return click_shapes(e, "user_id", ["ts", "event_id"], 3).groupBy("user_id", "shape_no").agg(F.min("event_id").alias("first_click"), F.count("*").alias("n_clicks")).where("n_clicks = 3")


# ---- uploads and files

PARTS = "parts AS (SELECT user_id AS uploader_id, event_id % 5 AS chunk_number, 5 AS total_chunks, event_type AS content FROM events)"


def upload_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of uploads, simulated from events: repeated, shuffled and missing ones among them."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("uploader_id"), F.pmod("event_id", F.lit(5)).alias("chunk_number"), F.lit(5).alias("total_chunks"), F.col("event_type").alias("content"))


@query(f"WITH {PARTS} SELECT uploader_id, count(*) AS n_parts, count(DISTINCT chunk_number) AS n_chunks, count(*) >= 5 AS triggered, count(DISTINCT chunk_number) = 5 AS complete FROM parts GROUP BY uploader_id")
def upload_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelspan.streaming.assembly import upload_state

    return upload_state(upload_parts(spark, sf_dir))


@query(f"WITH {PARTS}, u AS (SELECT uploader_id, chunk_number, min(content) AS content FROM parts GROUP BY 1, 2) SELECT uploader_id, string_agg(content, '|' ORDER BY chunk_number) AS content FROM u GROUP BY uploader_id HAVING count(*) = 5")
def part_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelspan.streaming.assembly import assemble

    return assemble(upload_parts(spark, sf_dir), "|")


@query(f"""{WITH}, {octree_sql(DEPTH)}, {reduce_sql('cells', 'base')}, {centred_sql('base')}
SELECT pos, CAST(trunc(c.x / {S}) AS INT) AS ix, CAST(trunc(c.z / {S}) AS INT) AS iy, CAST(trunc(c.y / {S}) AS INT) AS iz, CAST(intensity AS INT) AS intensity, 2 AS classification FROM c, h
WHERE NOT (c.x < h.x1 OR c.y < h.y1 OR c.z < h.z1)""")
def reduced_file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxelspan.sources.las import file_records

    h = header(spark, sf_dir)
    return file_records(reduce.reduce_cells(cells(spark, sf_dir)).withColumns(P.centred(h)), h)


@query(f"WITH {RECORDS_SQL} SELECT pos, ix, iy, iz, CAST(intensity AS INT) AS intensity, CAST(classification AS INT) AS classification, ir, ig, ib FROM rec")
def las_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record written as a point file of several parts and read back."""
    from voxelspan.sources import las

    las.register(spark)
    return spark.read.format("las").load(point_file(spark, sf_dir))
