"""What a viewer is told of an upload: one JSON message a row, with the step and place it comes in.

Every function returns step (int), seq (bigint), event and payload. A message holds a bounded number of points: chunks of
CHUNK_POINTS, for levels of detail too. Messages are ordered by (step, seq).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspan.operators.reduce import chunks
from voxelspan.schema import CHUNK_POINTS, FIELDS, LOD_DISTANCES, Header

# Names of the messages and what progress messages say.
SESSION, PROGRESS, HEADER, POINTS, LOD, FILE_READY, DONE = "sessionId", "progress", "header", "points", "lod-points", "file-ready", "done"
PARSING, OPTIMIZING, CLUSTERING = "Parsing point cloud file...", "Optimizing data...", "Clustering points..."

SCHEMA = "step int, seq bigint, event string, payload string"


def _one(spark: SparkSession, step: int, event: str, **fields) -> DataFrame:
    """A message without points; its values are known when the plan is made."""
    body = F.to_json(F.struct(F.lit(event).alias("Event"), *[_literal(v).alias(k) for k, v in fields.items()]))
    return spark.range(1).select(F.lit(step).alias("step"), F.lit(0).cast("bigint").alias("seq"), F.lit(event).alias("event"), body.alias("payload"))


def _literal(v) -> Column:
    return F.lit(list(v)) if isinstance(v, tuple) else F.lit(v)


def session(spark: SparkSession, step: int, session_id: str) -> DataFrame:
    return _one(spark, step, SESSION, SessionId=session_id)


def progress(spark: SparkSession, step: int, message: str) -> DataFrame:
    return _one(spark, step, PROGRESS, Message=message)


def header(spark: SparkSession, step: int, h: Header) -> DataFrame:
    fields = {"PointOffset": h.data_offset, "FormatId": h.format_id, "StructSize": h.record_length, "PointCount": h.count}
    floats = {"ScaleFactors": h.scale, "Offsets": h.offset, "MaximumBounds": h.high, "MinimumBounds": h.low}
    return _one(spark, step, HEADER, **fields, **{k: tuple(map(float, v)) for k, v in floats.items()})


def file_ready(spark: SparkSession, step: int, path: str) -> DataFrame:
    return _one(spark, step, FILE_READY, FilePath=path)


def done(spark: SparkSession, step: int) -> DataFrame:
    return _one(spark, step, DONE)


def _packed(chunked: DataFrame, keys: list[str], order: list[str], fields: Column | None, step: int, event: str, seq: Column) -> DataFrame:
    row = F.struct(*order, F.array(*FIELDS).alias("v"))
    flat = F.flatten(F.transform(F.sort_array(F.collect_list(row)), lambda s: s["v"]))
    packed = chunked.groupBy(*keys).agg(flat.alias("Points"), F.max("total_chunks").alias("TotalChunks"))
    body = F.struct(F.lit(event).alias("Event"), "Points", "TotalChunks", *([] if fields is None else fields))
    return packed.select(F.lit(step).alias("step"), seq.cast("bigint").alias("seq"), F.lit(event).alias("event"), F.to_json(body).alias("payload"))


def clustered_points(reduced: DataFrame, step: int, depth: int) -> DataFrame:
    """Chunks over all cells, which know how many there are."""
    chunked = chunks(reduced, "cell_code", ["pos"], CHUNK_POINTS, depth)
    return _packed(chunked, ["chunk_no"], ["cell_code", "pos"], None, step, POINTS, F.col("chunk_no"))


def window_points(chunked: DataFrame, step: int) -> DataFrame:
    """Chunks of window_chunks(): each window's own, of an unstated total (0)."""
    seq = F.col("window_no") * F.lit(1 << 20) + F.col("chunk_no")
    return _packed(chunked.withColumn("total_chunks", F.lit(0)), ["window_no", "chunk_no"], ["pos"], None, step, POINTS, seq)


def level_points(level: DataFrame, step: int, label: str, depth: int) -> DataFrame:
    """Chunks of a level of detail with its label and the distance from which it is shown."""
    chunked = chunks(level, "cell_code", ["leaf_code", "pos"], CHUNK_POINTS, depth)
    extra = [F.lit(float(LOD_DISTANCES[label])).alias("RenderDistance"), F.lit(label).alias("Label")]
    return _packed(chunked, ["chunk_no"], ["cell_code", "leaf_code", "pos"], extra, step, LOD, F.col("chunk_no"))


def points_of(messages: DataFrame) -> DataFrame:
    """The messages with points as rows again: step, seq, event, label, render_distance, total_chunks, values (flat)."""
    parsed = F.from_json("payload", "Points array<double>, TotalChunks bigint, RenderDistance double, Label string")
    rows = messages.where(F.col("event").isin(POINTS, LOD)).select("step", "seq", "event", parsed.alias("m"))
    return rows.select("step", "seq", "event", F.col("m.Label").alias("label"), F.col("m.RenderDistance").alias("render_distance"), F.col("m.TotalChunks").alias("total_chunks"), F.col("m.Points").alias("values"))
