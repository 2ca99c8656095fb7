"""Levels of detail that are kept up to date: points that arrive rework the cells they fall in, and those above them.

A store has the raw points and each level by version and part, a part being a coarse cell. Adding points writes the
parts they touch as a new version, in which cells that have no new point are taken over as they are; then a manifest
says which version of each part counts. Readers go by the manifest, so they see an addition whole or not at all, and
one that failed leaves nothing but files that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspan.operators import octree, reduce
from voxelspan.operators.octree import Box
from voxelspan.sources.storage import stored


@dataclass(frozen=True)
class KeptLevels:
    """A store below path (a URI). Cells are those of box and depth; steps coarser levels are kept beside the finest."""

    spark: SparkSession
    path: str
    box: Box
    depth: int
    steps: int = 2
    part_level: int = 2

    def __post_init__(self) -> None:
        if not 0 <= self.part_level <= self.depth - self.steps:
            raise ValueError("parts have to be cells of the coarsest level kept or coarser ones")

    def manifest(self) -> dict:
        store, path = pafs.FileSystem.from_uri(f"{self.path}/manifest.json")
        if not store.get_file_info(path).is_file:
            return {"version": 0, "parts": {}}
        with store.open_input_stream(path) as f:
            return json.loads(f.read())

    def _commit(self, manifest: dict) -> None:
        store, path = pafs.FileSystem.from_uri(f"{self.path}/manifest.json")
        draft = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps(manifest).encode())
        store.move(draft, path)

    def raw(self, manifest: dict | None = None) -> DataFrame | None:
        """All points with their cells, the part and the version that brought them."""
        m = manifest or self.manifest()
        return self.spark.read.parquet(f"{self.path}/raw").where(F.col("v") <= m["version"]) if m["version"] else None

    def level(self, step: int, manifest: dict | None = None) -> DataFrame | None:
        """The finest level (0) or a coarser one, as reduce.levels_of_detail() makes it of all points; None if there are none."""
        m = manifest or self.manifest()
        if not m["parts"]:
            return None
        current = F.create_map(*[F.lit(int(x)) for pair in m["parts"].items() for x in pair])
        return self.spark.read.parquet(f"{self.path}/level{step}").where(F.col("v") == current[F.col("part")])

    def add(self, points: DataFrame) -> int:
        """Adds points whose pos no other has; returns how many cells of the finest level they touch. Points outside the box go."""
        before = self.manifest()
        version = before["version"] + 1
        up = 3 * (self.depth - self.part_level)
        new = octree.assign_cells(points, self.box, self.depth).withColumn("part", F.shiftright("cell_code", up).cast("int"))
        new.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/raw/v={version}")  # no manifest names it yet
        came = self.spark.read.schema(new.schema).parquet(f"{self.path}/raw/v={version}")
        touched = stored(came.select("cell_code", "part").distinct())
        parts = [r["part"] for r in touched.select("part").distinct().collect()]  # coarse cells: at most 8 ** part_level
        if not parts:
            return 0
        touched = touched.select("cell_code")
        source = self.raw(before | {"version": version}).where(F.col("part").isin(parts)).drop("v")
        source = source.join(touched, "cell_code", "left_semi").withColumn("leaf_code", F.col("cell_code"))
        cells, order = touched, ["pos"]
        for step in range(self.steps + 1):
            made = reduce.reduce_cells(source, order) if step else reduce.reduce_finest(source, self.depth)
            old = self.level(step, before)
            if old is not None:
                same = old.where(F.col("part").isin(parts)).drop("v").join(cells, "cell_code", "left_anti")
                made = made.unionByName(same)
            made.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/level{step}/v={version}")
            if step == self.steps:
                break
            cells = cells.select(octree.parent(F.col("cell_code")).alias("cell_code")).distinct()
            lower = self.spark.read.parquet(f"{self.path}/level{step}/v={version}")
            source = lower.withColumns({"cell_code": octree.parent(F.col("cell_code")), "depth": F.col("depth") - 1}).join(cells, "cell_code", "left_semi")
            order = ["leaf_code", "pos"]
        self._commit({"version": version, "parts": before["parts"] | {str(p): version for p in parts}})
        return touched.count()
