"""Landing folders of upload parts, and point arrays baked as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspan.functions.scalar import parsed_flag, parsed_number

NAME = r"([^/]+)\.(\d+)\.(\d+)\.part$"


def _parsed(files: DataFrame) -> DataFrame:
    got = lambda k: F.regexp_extract("path", NAME, k)
    files = files.where(F.col("path").rlike(NAME))
    return files.select(got(1).alias("uploader_id"), got(2).cast("int").alias("chunk_number"), got(3).cast("int").alias("total_chunks"), "content")


def read_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Files named uploader.number.total.part."""
    return _parsed(spark.read.format("binaryFile").load(folder))


def read_options(spark: SparkSession, folder: str) -> DataFrame:
    """uploader_id and the options that came with an upload, parsed: clustering, subsample, lod, density, keep_rate.

    They lie beside the parts in uploader.options.json; what is missing there is false or 0.
    """
    raw = spark.read.schema("clustering string, subsample string, lod string, density string").option("pathGlobFilter", "*.options.json").option("multiLine", "true").json(folder)
    own = raw.withColumn("uploader_id", F.regexp_extract(F.col("_metadata.file_name"), r"(.+)\.options\.json$", 1))
    return own.select("uploader_id", *[parsed_flag(F.col(c)).alias(c) for c in ("clustering", "subsample", "lod")], parsed_number(F.col("density")).alias("density"))


def stream_parts(spark: SparkSession, folder: str) -> DataFrame:
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return _parsed(spark.readStream.format("binaryFile").schema(schema).load(folder))


def read_json_points(spark: SparkSession, path: str) -> DataFrame:
    """A flat array of eight numbers a point, {"points": [...]}, to one row a point; pos counts within each file."""
    names = ["x", "y", "z", "r", "g", "b", "intensity", "classification"]
    flat = spark.read.schema("points array<double>").option("multiLine", "true").json(path)
    each = flat.select("points", F.explode(F.sequence(F.lit(1), F.floor(F.size("points") / 8).cast("int"))).alias("k")).where("k > 0 and size(points) >= 8")
    return each.select((F.col("k") - 1).cast("bigint").alias("pos"), *[F.element_at("points", (F.col("k") - 1) * 8 + i + 1).alias(n) for i, n in enumerate(names)])


def read_json_chunks(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Lines of {"chunk_no": n, "points": [...]}, chunks of ``size`` points, to one row a point; only the last is shorter."""
    names = ["x", "y", "z", "r", "g", "b", "intensity", "classification"]
    lines = spark.read.schema("chunk_no bigint, points array<double>").json(path)
    each = lines.select("chunk_no", "points", F.explode(F.sequence(F.lit(0), F.floor(F.size("points") / 8).cast("int") - 1)).alias("k")).where("size(points) >= 8")
    return each.select((F.col("chunk_no") * size + F.col("k")).alias("pos"), *[F.get("points", F.col("k") * 8 + i).alias(n) for i, n in enumerate(names)])
