"""Queries over the cloud stored by cells: its pyramid, picking by many rays, nearest points of many places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspan.operators import kdtree, neighbours, octree, pyramid, upkeep
from voxelspan.plans.pointview import _stored, header, octree_sql, points
from voxelspan.plans.registry import DEPTH, INNER, ORACLES, WITH, _first, _inner, d, lloyd_sql, query
from voxelspan.sources.storage import shared_dir

#: Levels of the stored cloud, and of the cells that a ray is led through.
STORED_DEPTH, RAY_LEVEL, RAY_REACH = 6, 5, 0.5


def cloud(spark: SparkSession, sf_dir: str) -> pyramid.Pyramid:
    """The points by cells with the statistics of all levels, stored once a session."""

    def make() -> pyramid.Pyramid:
        box = header(spark, sf_dir).box()
        return pyramid.store(octree.assign_cells(points(spark, sf_dir), box, STORED_DEPTH), box, STORED_DEPTH, f"{shared_dir(spark)}/cloud")

    return _stored(spark, sf_dir, "pyramid", make)


CELLS = f"{WITH}, {octree_sql(STORED_DEPTH)}"
_SUMS = ", ".join(f"CAST(round(sum({a}) * 100) AS BIGINT) AS sum_{a}" for a in "xyz")
_ENDS = ", ".join(f"{f}({a}) AS {f}_{a}" for a in "xyz" for f in ("min", "max"))


def _shown(levels: DataFrame) -> DataFrame:
    """Coordinates are hundredths: their sums as whole numbers."""
    return levels.select("level", "cell_code", "n_points", *[f"{f}_{a}" for a in "xyz" for f in ("min", "max")], *[F.round(F.col(f"sum_{a}") * 100).cast("bigint").alias(f"sum_{a}") for a in "xyz"], "max_intensity")


@query(f"""{CELLS}, l AS (SELECT CAST(unnest(range(0, {STORED_DEPTH + 1})) AS INT) AS level)
SELECT level, cell_code // CAST(pow(8, {STORED_DEPTH} - level) AS BIGINT) AS cell_code, count(*) AS n_points, {_ENDS}, {_SUMS}, max(intensity) AS max_intensity FROM cells, l GROUP BY 1, 2""")
def pyramid_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(cloud(spark, sf_dir).levels)


@query(f"{CELLS} SELECT 4 AS level, cell_code // 64 AS cell_code, count(*) AS n_points, {_ENDS}, {_SUMS}, max(intensity) AS max_intensity FROM cells WHERE cell_code // 4096 = 37 GROUP BY 1, 2")
def pyramid_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(cloud(spark, sf_dir).below(37, 2, 2))


@query(f"{CELLS}, i AS (SELECT {INNER} FROM h) SELECT cell_code // 512 AS cell_code, count(*) AS n_points FROM cells, i WHERE " + " AND ".join(f"{a} >= {a}3 AND {a} <= {a}4" for a in "xyz") + " GROUP BY 1")
def pyramid_box_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud(spark, sf_dir).count_in(_inner(spark, sf_dir), 3).select("cell_code", "n_points")


RAYS_SQL = f"""g AS (SELECT pos AS ray_id, x, y, z, {d(1000.0)} AS gx, CAST(pos % 7 - 3 AS DOUBLE) AS gy, CAST(pos % 11 - 5 AS DOUBLE) AS gz FROM p WHERE pos % 500 = 0),
rays AS (SELECT ray_id, {", ".join(f"{a} - {d(3.0)} * g{a} AS o{a}" for a in "xyz")}, {", ".join(f"g{a} / sqrt(gx * gx + gy * gy + gz * gz) AS d{a}" for a in "xyz")} FROM g)"""


def rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ray for each 500th point, which it passes through."""
    at = points(spark, sf_dir).where(F.col("pos") % 500 == 0)
    g = at.select(F.col("pos").alias("ray_id"), "x", "y", "z", F.lit(1000.0).alias("gx"), (F.col("pos") % 7 - 3).cast("double").alias("gy"), (F.col("pos") % 11 - 5).cast("double").alias("gz"))
    size = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + F.col("gz") * F.col("gz"))
    return g.select("ray_id", *[(F.col(a) - 3.0 * F.col(f"g{a}")).alias(f"o{a}") for a in "xyz"], *[(F.col(f"g{a}") / size).alias(f"d{a}") for a in "xyz"])


@query(f"""{WITH}, {RAYS_SQL}, t AS (SELECT ray_id, pos, x, y, z, (x - ox) * dx + (y - oy) * dy + (z - oz) * dz AS t, (x - ox) * (x - ox) + (y - oy) * (y - oy) + (z - oz) * (z - oz) AS far2 FROM p, rays)
SELECT ray_id, pos, x, y, z, t, TRUE AS few_cells FROM t WHERE t >= 0 AND far2 - t * t <= {d(RAY_REACH * RAY_REACH)} QUALIFY row_number() OVER (PARTITION BY ray_id ORDER BY t, pos) = 1""")
def pick_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many rays at once; few_cells says that a ray read under a quarter of the cells."""
    found = neighbours.pick_many(rays(spark, sf_dir), cloud(spark, sf_dir), RAY_REACH, RAY_LEVEL)
    return found.select("ray_id", "pos", "x", "y", "z", "t", (F.col("cells_read") * 4 < F.col("cells_all")).alias("few_cells"))


@query(f"""{WITH}, q AS (SELECT pos AS id, x, y, z FROM p WHERE pos % 6 = 0), c AS (SELECT pos, x, y, z FROM p WHERE pos % 6 = 1),
m AS (SELECT id, pos, (c.x - q.x) * (c.x - q.x) + (c.y - q.y) * (c.y - q.y) + (c.z - q.z) * (c.z - q.z) AS d2 FROM q, c)
SELECT id, unnest.rank AS rank, unnest.pos AS pos, unnest.d2 AS d2 FROM (SELECT id, min(struct_pack(d2 := d2, pos := pos), 3) AS l FROM m GROUP BY id),
LATERAL (SELECT unnest(list_transform(l, lambda s, i: struct_pack(rank := CAST(i AS INT), pos := s.pos, d2 := s.d2))) AS unnest)""")
def nearest_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sixth of the points looks for its three nearest of another sixth."""
    p = points(spark, sf_dir)
    to = p.where(F.col("pos") % 6 == 1)
    depth = neighbours.depth_for(header(spark, sf_dir).count // 6)
    return neighbours.nearest_join(p.where(F.col("pos") % 6 == 0).withColumnRenamed("pos", "id"), to, header(spark, sf_dir).box(), depth, k=3)


def _forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees over the points as they are stored by cells, made once a session."""
    return _stored(spark, sf_dir, "trees", lambda: kdtree.trees(cloud(spark, sf_dir).points, block=1 << 14))


@query(f"{WITH}, {lloyd_sql(16, 4)} SELECT CAST(i AS INT) AS cluster_id, count(*) AS n_points, CAST(round(sum(d2) / 1000) AS BIGINT) AS sse_k, TRUE AS few_distances FROM last GROUP BY i")
def kmeans_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters by the filtering algorithm; few_distances says that under a quarter of n * k were computed."""
    forest = _forest(spark, sf_dir)
    found = kdtree.totals(forest, kdtree.lloyd(forest, _first(spark, sf_dir, 16), 4))
    every = found.agg(F.sum("n_points").alias("_n"), F.sum("computed").alias("_d"))  # one row
    few = F.col("_d") * 4 < F.col("_n") * 16
    return found.join(F.broadcast(every)).select("cluster_id", "n_points", F.round(F.col("sse") / 1000).cast("bigint").alias("sse_k"), few.alias("few_distances"))


@query(ORACLES["lod_low"])
def lod_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coarsest level after points came in three batches, each of which reworked the cells that it touched."""
    kept = upkeep.KeptLevels(spark, f"{shared_dir(spark)}/levels", header(spark, sf_dir).box(), DEPTH, part_level=1)
    p, n = points(spark, sf_dir), header(spark, sf_dir).count
    for low, high in ((0, n // 2), (n // 2, n - n // 10), (n - n // 10, n)):
        kept.add(p.where((F.col("pos") >= low) & (F.col("pos") < high)))
    return kept.level(2).select("cell_code", "leaf_code", "pos", "x", "y", "z")
