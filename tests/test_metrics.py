"""Rows by stage from the run itself, time by name, progress of streams, and the viewer's reading by sevens."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_spatial import BOX, cloud_rows, frame
from voxelspan.operators import cluster, metrics, octree, reduce


def staged(spark, rows, **kw):
    with metrics.Stages(spark) as seen:
        raw = seen.watch("raw", frame(spark, rows), few=F.col("pos") < 10)
        levels = reduce.levels_of_detail(octree.assign_cells(raw, BOX, 2), watch=lambda k, df: seen.watch(f"level{k}", df), **kw)
        seen.run(levels[-1])
    return seen, levels


@pytest.mark.parametrize("slice_rows", [1 << 20, 40])
def test_stages_are_counted_by_the_run_itself(spark, slice_rows):
    seen, levels = staged(spark, cloud_rows(400, 5, hot=100), slice_rows=slice_rows)
    want = [("raw", 400), ("few", 10), *((f"level{k}", df.count()) for k, df in enumerate(levels))]
    assert [tuple(r) for r in seen.counts().collect()] == want and not seen.recounted
    assert sorted(map(tuple, metrics.counted(seen._marked).collect())) == sorted(want)
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_stages_are_counted_anew_where_a_task_failed(spark, monkeypatch):
    monkeypatch.setattr(metrics.Stages, "_undisturbed", lambda self: False)
    seen, levels = staged(spark, cloud_rows(50, 5))
    assert {r["stage"]: r["n_points"] for r in seen.counts().collect()} == {"raw": 50, "few": 10, **{f"level{k}": df.count() for k, df in enumerate(levels)}} and seen.recounted


def test_skipped_stages_may_be_forgotten(spark, monkeypatch):
    """As in a long session: what is kept of stages is bounded, and those that never ran go first."""
    own = spark.sparkContext.statusTracker()

    class Tracker:
        getJobIdsForGroup, getJobInfo = own.getJobIdsForGroup, own.getJobInfo

        def getStageInfo(self, stage):
            found = own.getStageInfo(stage)
            return found if found is not None and found.numCompletedTasks else None

    monkeypatch.setattr(spark.sparkContext, "statusTracker", Tracker)
    seen, _ = staged(spark, cloud_rows(400, 5, hot=100))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert len(seen.counts().collect()) == 5 and not seen.recounted


def test_stages_of_no_points(spark):
    seen, _ = staged(spark, cloud_rows(0, 5))
    assert {r["n_points"] for r in seen.counts().collect()} == {0}


def test_time_by_name(spark):
    rows = [("a", 3, 5), ("a", 1, 100), ("a", 2, None), ("b", 9, 7), (None, 1, 4), (None, 2, 6), ("c", 1, None), ("c", 2, 8)]
    df = spark.createDataFrame(rows, "name string, seq bigint, ms bigint").withColumn("total_ms", F.lit("clash"))
    assert {r["name"]: (r["n_samples"], r["total_ms"]) for r in metrics.time_totals(df).collect()} == {"a": (3, 5), "b": (1, 0), None: (2, 6), "c": (2, 8)}
    assert {r["name"]: r["total_ms"] for r in metrics.time_totals(df, "intended").collect()} == {"a": 105, "b": 7, None: 10, "c": 8}
    assert metrics.time_totals(df.limit(0)).count() == 0


def test_streams_tell_of_each_batch(spark, tmp_path):
    for k, n in enumerate((3, 0, 5)):
        spark.range(n).coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    told = []
    listener = metrics.ProgressMessages(told.append, "Parsing")
    spark.streams.addListener(listener)
    try:
        rows = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
        q = rows.observe("points", F.count(F.lit(1)).alias("n")).writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
        q.awaitTermination(60)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    seen = {t["Batch"]: t for t in told}
    assert sorted(seen) == [0, 1, 2] and sum(t["Counts"]["points"]["n"] for t in seen.values()) == 8
    assert {(t["Event"], t["Message"]) for t in told} == {("progress", "Parsing")}


@pytest.mark.parametrize("n", [0, 1, 6, 7, 8, 50])
def test_reading_by_sevens(spark, n):
    df = frame(spark, cloud_rows(n, 3))
    for c in ("r", "g", "b", "classification"):
        df = df.withColumn(c, F.col("pos") + F.lit(0.5))
    df = df.withColumn("alpha", F.lit("clash"))
    fields = ["x", "y", "z", "r", "g", "b", "intensity", "classification"]
    flat = np.array([[float(r[f]) for f in fields] for r in df.orderBy("pos").collect()]).ravel()
    got = [tuple(r) for r in cluster.by_sevens(df.withColumn("intensity", F.col("intensity").cast("double")).repartition(5)).orderBy("pos").collect()]
    assert got == [(i, *flat[7 * i : 7 * i + 7]) for i in range(len(flat) // 7)]


def test_two_means_by_sevens(spark):
    rows = [(i, *(float(v) for v in p), 0.0, 0.0, 0.0, -3.0) for i, p in enumerate([(0, 0, 0), (9, 9, 9), (1, 1, 1), (8, 8, 8)])]
    groups = spark.createDataFrame(rows, "pos bigint, x double, y double, z double, r double, g double, b double, alpha double")
    got = cluster.seven_means(groups, 5, [(0.0, 0.0, 0.0), (9.0, 9.0, 9.0)]).orderBy("cluster_id").collect()
    assert [(r["n_groups"], r["x"], r["alpha"]) for r in got] == [(2, 0.5, 0.0), (2, 8.5, 0.0)]
