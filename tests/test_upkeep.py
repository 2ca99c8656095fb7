"""Levels kept up to date against levels made anew."""

import numpy as np

from tests.test_spatial import BOX, cloud_rows, frame
from voxelspan.operators import octree, reduce, upkeep


def shown(df):
    return sorted((r["cell_code"], r["leaf_code"], r["pos"], r["x"], r["y"], r["z"], r["depth"]) for r in df.collect())


def test_three_additions_make_what_one_does(spark, tmp_path):
    p = cloud_rows(1500, 21, hot=300)
    points = frame(spark, p)
    kept = upkeep.KeptLevels(spark, f"file://{tmp_path}/levels", BOX, 3, steps=2, part_level=1)
    assert kept.level(0) is None and kept.add(points.where("false")) == 0
    corner = "x < 50 and y < 0 and z < 20"
    for batch in (f"pos < 700 and not ({corner})", f"pos < 1000 and {corner}", f"pos >= 700 and not (pos < 1000 and {corner})"):
        assert kept.add(points.where(batch)) > 0
        if "and not (pos" not in batch:
            reader = kept.manifest()
            old = shown(kept.level(2, reader))
    rebuilt = reduce.levels_of_detail(octree.assign_cells(points, BOX, 3), 2)
    for step, level in enumerate(rebuilt):
        assert shown(kept.level(step)) == shown(level)
    assert shown(kept.level(2, reader)) == old  # who reads by an earlier manifest sees that version
    assert kept.raw().count() == 1500 and kept.manifest()["version"] == 3


def test_only_touched_parts_are_written(spark, tmp_path):
    points = frame(spark, cloud_rows(600, 22, hot=0))
    kept = upkeep.KeptLevels(spark, f"file://{tmp_path}/levels", BOX, 3, steps=1, part_level=2)
    kept.add(points.where("pos < 500"))
    before = len(list((tmp_path / "levels" / "level0" / "v=1").glob("part=*")))
    one = points.where("pos = 599")
    assert kept.add(one) == 1
    assert len(list((tmp_path / "levels" / "level0" / "v=2").glob("part=*"))) == 1 < before
    # an addition that never got to its manifest isn't seen
    (tmp_path / "levels" / "level0" / "v=3").mkdir()
    assert np.isin(599, [r["pos"] for r in kept.raw().collect()])


def test_an_addition_is_written_once(spark, tmp_path, monkeypatch):
    """Only cells are stored beside what stays; points aren't."""
    seen, own = [], upkeep.stored
    monkeypatch.setattr(upkeep, "stored", lambda df: seen.append(df.columns) or own(df))
    kept = upkeep.KeptLevels(spark, f"file://{tmp_path}/levels", BOX, 3, steps=1, part_level=1)
    assert kept.add(frame(spark, cloud_rows(200, 23))) > 0
    assert seen and all("x" not in columns for columns in seen)
