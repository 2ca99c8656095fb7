"""A cloud stored by cells with the statistics of every level: what asks for a part of it reads only that part's files.

``levels`` has a row for each cell of each level that holds points: their count, extent, sums and highest intensity.
``points`` has the points with their cell of the finest level. Both are sorted by cell, so that row groups and pages
hold ranges of cells and their statistics decide what is read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspan.operators import octree
from voxelspan.operators.octree import Box

#: Rows of a page, and bytes of a row group: what statistics can prune by.
PAGE_ROWS, GROUP_BYTES = 4096, 8 << 20


def whole(value: Column) -> Column:
    """The part of a number before the point, as a decimal: sums of those lose nothing, in whatever order."""
    return F.floor(value).cast("decimal(20,0)")


def exact_sum(value: str) -> Column:
    """A sum that rounds as if it were rounded once: what stands before the point is added up exactly, the rest is small."""
    return F.sum(whole(F.col(value))).cast("double") + F.sum(F.col(value) - F.floor(value))


def levels_of(cells: DataFrame, depth: int, by: list[str] | None = None) -> DataFrame:
    """level, cell_code, n_points, min and max and sum of x, y, z, max_intensity for levels 0 to depth.

    Points are aggregated by their finest cell first; the other levels are grouping sets over those rows. With ``by``
    the same for each group.
    """
    own = list(by or [])
    ends = [f(a).alias(f"{f.__name__}_{a}") for a in "xyz" for f in (F.min, F.max)]
    ends += [s for a in "xyz" for s in (F.sum(whole(F.col(a))).alias(f"_w{a}"), F.sum(F.col(a) - F.floor(a)).alias(f"_f{a}"))]  # as exact_sum() adds
    leaf = cells.groupBy(*own, "cell_code").agg(F.count("*").alias("n_points"), *ends, F.max("intensity").alias("max_intensity"))
    names = [f"_c{k}" for k in range(depth + 1)]
    leaf = leaf.withColumns({c: octree.parent(F.col("cell_code"), depth - k) for k, c in enumerate(names)})
    merged = [f(f"{f.__name__}_{a}").alias(f"{f.__name__}_{a}") for a in "xyz" for f in (F.min, F.max)]
    merged += [(F.sum(f"_w{a}").cast("double") + F.sum(f"_f{a}")).alias(f"sum_{a}") for a in "xyz"]
    level = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(k)) for k, c in enumerate(names)]).alias("level")
    rolled = leaf.groupingSets([[*map(F.col, own), F.col(c)] for c in names], *own, *names).agg(level, F.sum("n_points").alias("n_points"), *merged, F.max("max_intensity").alias("max_intensity"))
    return rolled.select(*own, "level", F.coalesce(*names).alias("cell_code"), "n_points", *[f"{f}_{a}" for a in "xyz" for f in ("min", "max", "sum")], "max_intensity")


def low2(at: tuple[Column, Column, Column]) -> Column:
    """Squared distance from a place to the nearest that a cell's points can be, by their extent."""
    away = [F.greatest(F.col(f"min_{a}") - v, v - F.col(f"max_{a}"), F.lit(0.0)) for a, v in zip("xyz", at)]
    return away[0] * away[0] + away[1] * away[1] + away[2] * away[2]


def high2(at: tuple[Column, Column, Column]) -> Column:
    """Squared distance to the farthest that they can be."""
    away = [F.greatest(F.abs(F.col(f"min_{a}") - v), F.abs(F.col(f"max_{a}") - v)) for a, v in zip("xyz", at)]
    return away[0] * away[0] + away[1] * away[1] + away[2] * away[2]


@dataclass(frozen=True)
class Pyramid:
    """A stored cloud. box and depth are those of its cells."""

    spark: SparkSession
    path: str
    box: Box
    depth: int

    @property
    def levels(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/levels")

    @property
    def points(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/points")

    def below(self, code: int, level: int, down: int) -> DataFrame:
        """Statistics of the cells ``down`` levels below one: a range of rows."""
        return self.levels.where((F.col("level") == level + down) & octree.prefix_range(code, level, level + down))

    def points_below(self, code: int, level: int) -> DataFrame:
        return self.points.where(octree.prefix_range(code, level, self.depth))

    def points_in(self, part: Box, level: int = 4) -> DataFrame:
        """Points of a box: cells that meet it are ranges for the files, its bounds are for the points."""
        ranges = octree.covering(part, self.box, min(level, self.depth), self.depth)
        return self.points.where(octree.in_ranges("cell_code", ranges) & octree.in_box(part))

    def count_in(self, part: Box, level: int) -> DataFrame:
        """cell_code, n_points and from_points of the cells of ``level`` that have points in a box.

        A cell whose extent lies within the box is counted by its statistics; only the others' points are read, and
        from_points says how many of n_points they are.
        """
        ranges = octree.covering(part, self.box, level, level)
        met = self.levels.where((F.col("level") == level) & octree.in_ranges("cell_code", ranges))
        inside = F.lit(True)
        for a, (lo, hi) in zip("xyz", part):
            inside = inside & (F.col(f"min_{a}") >= F.lit(lo)) & (F.col(f"max_{a}") <= F.lit(hi))
        whole = met.where(inside).select("cell_code", "n_points", F.lit(0).cast("bigint").alias("from_points"))
        partly = met.where(~inside).select("cell_code")
        found = self.points_in(part, level).withColumn("cell_code", octree.parent(F.col("cell_code"), self.depth - level)).join(partly, "cell_code", "left_semi")
        counted = found.groupBy("cell_code").agg(F.count("*").alias("n_points")).withColumn("from_points", F.col("n_points"))
        return whole.unionByName(counted)


def store(cells: DataFrame, box: Box, depth: int, path: str) -> Pyramid:
    """Writes cells (assign_cells over ``box`` to ``depth``) below path, which must not exist."""
    options = {"parquet.page.row.count.limit": PAGE_ROWS, "parquet.block.size": GROUP_BYTES}
    cells.drop("depth").repartitionByRange("cell_code", "pos").sortWithinPartitions("cell_code", "pos").write.options(**options).parquet(f"{path}/points")
    out = Pyramid(cells.sparkSession, path, box, depth)
    levels_of(out.points, depth).repartitionByRange("level", "cell_code").sortWithinPartitions("level", "cell_code").write.options(**options).parquet(f"{path}/levels")
    return out
