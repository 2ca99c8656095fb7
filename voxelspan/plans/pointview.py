"""A cloud of points over the lineitem table, its header, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspan.functions import scalar
from voxelspan.operators.reduce import numbered
from voxelspan.schema import Header
from voxelspan.sources import las
from voxelspan.sources.storage import shared_dir

SCALE = 0.01
ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
#: Groups of neighbouring orders that points are numbered in, each one window partition: at least so many, and one for
#: so many points. Their counts are summed by at most BUCKETS coarser ones first.
BUCKETS, BUCKET_POINTS = 4096, 1 << 18
#: Points of a range that one task numbers and stores. Up to 200 ranges Spark writes the shuffle without sorting, so nothing is spilled.
RANGE_POINTS = 1 << 21


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _coordinates() -> dict:
    stored = {"ix": F.round(F.col("l_extendedprice") * 100).cast("int"), "iy": F.col("l_partkey").cast("int"), "iz": F.col("l_suppkey").cast("int")}
    return stored


_STORED: dict = {}


def _stored(spark: SparkSession, sf_dir: str, what: str, make):
    """What make() returns, made once for a session and the present files of the table."""
    files = spark.read.format("binaryFile").load(f"{sf_dir}/lineitem.parquet").select("path", "modificationTime", "length").collect()  # names, not contents
    key, state = (spark.sparkContext.applicationId, sf_dir, what), sorted(map(tuple, files))
    if _STORED.get(key, (None,))[0] != state:
        _STORED[key] = (state, make())
    return _STORED[key][1]


def header(spark: SparkSession, sf_dir: str) -> Header:
    """One aggregation: the count and the bounds, which a point file states at its start."""

    def make() -> Header:
        c = _coordinates()
        ends = [f(scalar.scaled(v, SCALE)).alias(f"{f.__name__}_{k}") for k, v in c.items() for f in (F.min, F.max)]
        r = _raw(spark, sf_dir).agg(F.count("*").alias("n"), *ends).first()
        pick = lambda how: tuple(r[f"{how}_{k}"] or 0.0 for k in c)
        return Header(count=r["n"], scale=(SCALE,) * 3, low=pick("min"), high=pick("max"))

    return _stored(spark, sf_dir, "header", make)


def _numbered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    lo, hi = raw.agg(F.min("l_orderkey"), F.max("l_orderkey")).first()
    buckets = max(BUCKETS, -(-header(spark, sf_dir).count // BUCKET_POINTS))
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // buckets))
    df = raw.select(*ORDER, "l_quantity", F.floor((F.col("l_orderkey") - F.lit(lo or 0)) / F.lit(width)).alias("_bucket"))
    c = _coordinates()
    coarse = F.floor(F.col("_bucket") / F.lit(-(-buckets // BUCKETS))) if buckets > BUCKETS else None
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-header(spark, sf_dir).count // RANGE_POINTS))
    return numbered(df, "_bucket", ORDER, coarse=coarse, ranges=tasks).select(
        (F.col("rn") - 1).alias("pos"), *[v.alias(k) for k, v in c.items()], F.pmod(c["ix"], F.lit(256)).alias("ir"), (F.pmod(c["iy"], F.lit(3)) * 100).alias("ig"),
        F.lit(0).alias("ib"), F.col("l_quantity").alias("intensity"), F.col("l_linenumber").cast("double").alias("classification"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos (from 0), ix, iy, iz and the raw colours, intensity and class of every record.

    The table is numbered once a session and stored in ranges of pos in the shared folder, as a point file would be.
    """

    def make() -> tuple:
        path, df = f"{shared_dir(spark)}/records", _numbered_records(spark, sf_dir)
        df.write.parquet(path)  # numbered within ranges of orders: ranges of pos, and sorted
        return path, df.schema

    path, schema = _stored(spark, sf_dir, "records", make)
    return spark.read.schema(schema).parquet(path)


def point_file(spark: SparkSession, sf_dir: str) -> str:
    """The records as a binary point file of several parts, written once a session."""

    def make() -> str:
        h = header(spark, sf_dir)
        stored = records(spark, sf_dir).withColumns({c: F.col(c).cast("int") for c in ("intensity", "classification")})
        return las.write(stored, Header(h.count, h.scale, h.offset, h.low, h.high, 2, las.RECORD_LENGTH[2], las.HEADER_BYTES), f"{shared_dir(spark)}/cloud")

    return _stored(spark, sf_dir, "file", make)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled points in the axis order x, z, y of the file, colours resolved."""
    colours = [scalar.resolved_colour(f"i{ch}", "classification", k).alias(ch) for k, ch in enumerate("rgb")]
    return records(spark, sf_dir).select(
        "pos", scalar.scaled("ix", SCALE).alias("x"), scalar.scaled("iz", SCALE).alias("y"), scalar.scaled("iy", SCALE).alias("z"), *colours, "intensity", "classification",
    )


def _palette_case(palette: tuple, channel: int, cls: str) -> str:
    return f"CASE CAST({cls} AS INT) " + " ".join(f"WHEN {i} THEN {c[channel]}" for i, c in enumerate(palette)) + " END"


def palette_sql(raw: str, cls: str, channel: int) -> str:
    from voxelspan.schema import FILE_PALETTE

    return f"CASE WHEN {raw} <> 0 THEN {raw} / CAST(255 AS DOUBLE) WHEN {cls} >= 2 AND {cls} < {len(FILE_PALETTE)} THEN CAST({_palette_case(FILE_PALETTE, channel, cls)} AS DOUBLE) / 255 ELSE CAST(1 AS DOUBLE) END"


S = "CAST(0.01 AS DOUBLE)"
RECORDS_SQL = f"""rec AS (SELECT row_number() OVER (ORDER BY {", ".join(ORDER)}) - 1 AS pos, CAST(round(l_extendedprice * 100) AS INT) AS ix,
    CAST(l_partkey AS INT) AS iy, CAST(l_suppkey AS INT) AS iz, CAST(round(l_extendedprice * 100) AS INT) % 256 AS ir, CAST(l_partkey AS INT) % 3 * 100 AS ig, 0 AS ib,
    l_quantity AS intensity, CAST(l_linenumber AS DOUBLE) AS classification FROM lineitem)"""
POINTS_SQL = f"""{RECORDS_SQL},
p AS (SELECT pos, ix * {S} AS x, iz * {S} AS y, iy * {S} AS z, {", ".join(f"{palette_sql(f'i{ch}', 'classification', k)} AS {ch}" for k, ch in enumerate("rgb"))}, intensity, classification FROM rec),
h AS (SELECT count(*) AS n, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2, min(z) AS z1, max(z) AS z2 FROM p)"""


def octree_sql(depth: int) -> str:
    """CTE ``cells``: p with cell_code, level by level."""
    out = ["o0 AS (SELECT p.*, CAST(0 AS BIGINT) AS cell_code, h.x1, h.x2, h.y1, h.y2, h.z1, h.z2 FROM p, h)"]
    for k in range(depth):
        m = lambda a: f"({a}1 + ({a}2 - {a}1) / 2)"
        out.append(f"m{k} AS (SELECT *, x > {m('x')} AS hx, y > {m('y')} AS hy, CASE WHEN x > {m('x')} AND NOT y > {m('y')} THEN z >= {m('z')} ELSE z > {m('z')} END AS hz FROM o{k})")
        child = "CASE WHEN NOT hx AND NOT hy AND NOT hz THEN 0 WHEN NOT hx AND hy AND NOT hz THEN 1 WHEN NOT hx AND NOT hy THEN 2 WHEN NOT hx THEN 3 WHEN NOT hy AND hz THEN 4 WHEN NOT hy THEN 5 WHEN NOT hz THEN 6 ELSE 7 END"
        halves = ", ".join(f"CASE WHEN h{a} THEN {m(a)} ELSE {a}1 END AS {a}1, CASE WHEN h{a} THEN {a}2 ELSE {m(a)} END AS {a}2" for a in "xyz")
        out.append(f"o{k + 1} AS (SELECT pos, x, y, z, r, g, b, intensity, classification, cell_code * 8 + {child} AS cell_code, {halves} FROM m{k})")
    out.append(f"cells AS (SELECT pos, x, y, z, r, g, b, intensity, classification, cell_code, cell_code AS leaf_code FROM o{depth})")
    return ",\n".join(out)


def reduce_sql(source: str, name: str, order: str = "pos") -> str:
    """CTE ``name``: source reduced cell by cell."""
    return f"""{name}_a AS (SELECT *, row_number() OVER (PARTITION BY cell_code ORDER BY {order}) AS rn, count(*) OVER (PARTITION BY cell_code) AS n,
    row_number() OVER (PARTITION BY cell_code, x, y, z ORDER BY {order}) AS fo FROM {source}),
{name}_b AS (SELECT *, max(CASE WHEN n = 1 OR (fo = 1 AND rn <= n // 2) THEN rn END) OVER (PARTITION BY cell_code) AS keep FROM {name}_a),
{name} AS (SELECT pos, x, y, z, r, g, b, intensity, classification, cell_code, leaf_code FROM {name}_b WHERE rn <= keep)"""


def lod_sql(depth: int) -> str:
    up = lambda s: f"(SELECT * REPLACE (cell_code // 8 AS cell_code) FROM {s})"
    return ",\n".join([octree_sql(depth), reduce_sql("cells", "base"), reduce_sql(up("base"), "medium", "leaf_code, pos"), reduce_sql(up("medium"), "low", "leaf_code, pos")])
