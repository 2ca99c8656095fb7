"""Queries of uploads, messages, files and annotations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspan.functions import measure as M
from voxelspan.functions import scalar as P
from voxelspan.operators import cluster, events, sample
from voxelspan.operators.reduce import messages
from voxelspan.plans import upload
from voxelspan.plans.pointview import RECORDS_SQL, header, lod_sql, point_file, points, records
from voxelspan.plans.registry import CHUNKED, DEPTH, HASHED, ORACLES, SHAPES, WITH, _chunked, angle_sql, corners, d, len_sql, lod, query, rnd_sql, shapes
from voxelspan.schema import ARITY, Options
from voxelspan.sources import las, parts
from voxelspan.sources.storage import shared_dir
from voxelspan.streaming import assembly

# ---- display, annotations


@query(f"{WITH}, t AS (SELECT max(intensity) AS top FROM p) SELECT pos, " + ", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in ("x", "y", "z", "r", "g", "b")) + ", CAST(intensity / top AS FLOAT) AS alpha, CAST(classification AS INT) AS classification FROM p, t")
def display_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    top = p.agg(F.max("intensity").alias("_top"))  # one row
    return p.join(F.broadcast(top)).select("pos", *P.display_columns(F.col("_top")))


TOOLS = "['point', 'height', 'distance', 'angle', 'area', 'other']"


@query(f"""WITH c AS (SELECT user_id, {TOOLS}[CAST(user_id % 6 AS INT) + 1] AS tool, count(*) % 5 AS n FROM events GROUP BY user_id)
SELECT user_id, tool, coalesce(CASE tool {" ".join(f"WHEN '{k}' THEN {v}" for k, v in ARITY.items())} END = n, false) AS is_marker FROM c""")
def marker_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether what was clicked is a marker of the tool in hand."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.pmod(F.count("*"), F.lit(5)).cast("int").alias("n"))
    tools = F.array(*[F.lit(t) for t in (*("point", "height", "distance", "angle", "area"), "other")])
    clicked = e.select("user_id", F.get(tools, F.pmod("user_id", F.lit(6)).cast("int")).alias("tool"), F.array_repeat(F.struct(F.lit(0.0).alias("x")), F.col("n")).alias("picked"))
    return clicked.select("user_id", "tool", M.is_marker(F.col("tool"), F.col("picked")).alias("is_marker"))


def text_sql(v: str) -> str:
    c = f"CAST(floor(({v}) * {d(100.0)} + {d(0.5)}) AS BIGINT)"
    return f"(CASE WHEN {c} < 0 THEN '-' ELSE '' END || CAST(abs({c}) // 100 AS VARCHAR) || CASE WHEN abs({c}) % 100 = 0 THEN '' WHEN abs({c}) % 10 = 0 THEN '.' || CAST(abs({c}) % 100 // 10 AS VARCHAR) ELSE '.' || lpad(CAST(abs({c}) % 100 AS VARCHAR), 2, '0') END)"


OF_H = "(SELECT x1 AS x1_, x2 AS x2_, y1 AS y1_, y2 AS y2_, z1 AS z1_, z2 AS z2_ FROM h) AS h"


@query(f"{SHAPES} SELECT shape_id, " + " || ', ' || ".join(text_sql(v) for v in ("x1 + (h.x1_ + (h.x2_ - h.x1_) / 2)", "z1 + (h.z1_ + (h.z2_ - h.z1_) / 22)", "y1 + (h.y1_ + (h.y2_ - h.y1_) / 2)")) + f" AS label, x1 AS x, y1 AS y, z1 AS z FROM s, {OF_H}")
def point_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = header(spark, sf_dir).box()
    p = corners()[0]
    label = M.point_label(p, tuple(F.lit(b[0]) for b in box), tuple(F.lit(b[1]) for b in box))
    return shapes(spark, sf_dir).select("shape_id", label.alias("label"), *[c.alias(a) for a, c in zip("xyz", p)])


@query(f"{SHAPES} " + " UNION ALL ".join(f"SELECT shape_id, {i} AS edge_no, {text_sql(len_sql(a, b))} || 'm' AS label, " + ", ".join(f"least({n}{a}, {n}{b}) + abs({n}{a} - {n}{b}) / 2 AS {n}" for n in "xyz") + " FROM s" for i, (a, b) in enumerate(((1, 2), (2, 3), (3, 4), (4, 1)), 1)))
def line_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes(spark, sf_dir).select("shape_id", F.explode(M.line_annotations(*corners())).alias("e")).select("shape_id", "e.*")


DRAG = (1.0, 2.5, -0.75)


@query(f"{SHAPES}, m AS (SELECT * REPLACE ({', '.join(f'{a}1 + {d(v)} AS {a}1' for a, v in zip('xyz', DRAG))}) FROM s) SELECT shape_id, {rnd_sql(len_sql(1, 2))} AS length, {angle_sql(2, 1, 3)} AS angle FROM m")
def dragged_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A distance and an angle after their first point was dragged."""
    p1, p2, p3, _ = corners()
    p1 = M.moved(p1, DRAG)
    return shapes(spark, sf_dir).select("shape_id", M.length(p1, p2).alias("length"), M.angle(p2, p1, p3).alias("angle"))


@query(f"WITH {RECORDS_SQL} SELECT pos, least(ix, iy, iz) AS low, greatest(ix, iy, iz) AS high FROM rec")
def least_greatest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("pos", F.least("ix", "iy", "iz").alias("low"), F.greatest("ix", "iy", "iz").alias("high"))


@query(f"{WITH} SELECT classification, arg_min(pos, (x, pos)) AS argmin_pos, arg_max(pos, (x, -pos)) AS argmax_pos FROM p GROUP BY classification")
def arg_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.argmin_argmax(points(spark, sf_dir), "classification", "x")


@query(f"{WITH} SELECT pos, x, y, z FROM p ORDER BY {HASHED}, pos LIMIT 16")
def random_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.distinct_sample(points(spark, sf_dir), 16, sample.hashed(F.col("pos"))).select("pos", "x", "y", "z")


# ---- files


@query("""WITH v AS (SELECT event_id, CAST(event_id // 80 % 3 AS INT) AS major, CAST(event_id // 8 % 10 AS INT) AS minor, CAST(event_id % 8 AS INT) AS format_id FROM events)
SELECT *, major * 10 + minor <= 13 AND format_id <= 3 AS supported FROM v""")
def file_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions and formats simulated from events, and whether files of them are read."""
    part = lambda div, mod: F.pmod(F.floor(F.col("event_id") / F.lit(div)), F.lit(mod)).cast("int")
    v = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", part(80, 3).alias("major"), part(8, 10).alias("minor"), part(1, 8).alias("format_id"))
    return v.withColumn("supported", las.supported(F.col("major"), F.col("minor"), F.col("format_id")))


FIELDS_SQL = "pos, ix, iy, iz, CAST(intensity AS INT) AS intensity, CAST(classification AS INT) AS classification, ir, ig, ib"


def _file(spark: SparkSession, sf_dir: str, **options: str) -> DataFrame:
    las.register(spark)
    return spark.read.format("las").options(**options).load(point_file(spark, sf_dir))


@query(f"WITH {RECORDS_SQL} SELECT {FIELDS_SQL} FROM rec WHERE pos >= 4321 AND pos < 5000")
def record_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by number: the scan reads no others."""
    return _file(spark, sf_dir).where("pos >= 4321 and pos < 5000")


@query(f"WITH {RECORDS_SQL} SELECT {FIELDS_SQL} FROM rec WHERE {HASHED} <= 250000")
def sampled_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled by the scan, before records are decoded."""
    return _file(spark, sf_dir, sampleFraction="0.25")


@query(f"WITH r AS ({ORACLES['reduced_file_records']}) SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, ix, iy, iz, intensity, classification, 0 AS ir, 0 AS ig, 0 AS ib FROM r")
def reduced_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reduced cloud written as a file with the first one's header, and read back."""
    out = upload.process(spark, point_file(spark, sf_dir), Options(clustering=True), depth=DEPTH)
    return spark.read.format("las").load(out.file)


@query(f"{WITH} SELECT pos, x, y, z, r, g, b, intensity, classification FROM p")
def json_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points as lines of JSON, read back."""
    folder = f"{shared_dir(spark)}/json"
    row = F.struct("pos", F.array("x", "y", "z", "r", "g", "b", "intensity", "classification").alias("v"))
    packed = points(spark, sf_dir).groupBy(F.floor(F.col("pos") / 162).alias("chunk_no")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(row)), lambda s: s["v"])).alias("points"))
    packed.write.json(folder)
    return parts.read_json_chunks(spark, folder, 162)


# ---- messages


@query(f"{CHUNKED} SELECT chunk_no, max(total_chunks) AS total, count(*) * 8 AS n_values, max(base.x) AS top_x, min(base.intensity) AS low_intensity FROM k JOIN base USING (pos) GROUP BY chunk_no")
def chunk_message_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What chunk messages hold once parsed."""
    m = messages(_chunked(spark, sf_dir)).select("chunk_no", F.from_json("payload", "points array<double>, total bigint").alias("m"))
    of = lambda k: F.filter("m.points", lambda v, i: F.pmod(i, F.lit(8)) == k)
    return m.select("chunk_no", F.col("m.total").alias("total"), F.size("m.points").cast("bigint").alias("n_values"), F.array_max(of(0)).alias("top_x"), F.array_min(of(6)).alias("low_intensity"))


LEVEL = lambda name, far: f"SELECT '{name}' AS label, CAST({far} AS DOUBLE) AS render_distance, (row_number() OVER (ORDER BY cell_code, leaf_code, pos) - 1) // 162 AS seq, CAST(ceil(count(*) OVER () / CAST(162 AS DOUBLE)) AS BIGINT) AS total_chunks FROM {name}"


@query(f"{WITH}, {lod_sql(DEPTH)}, a AS ({LEVEL('medium', 200)} UNION ALL {LEVEL('low', 400)}) SELECT label, render_distance, seq, total_chunks, count(*) AS n_points FROM a GROUP BY ALL")
def lod_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, medium, low = lod(spark, sf_dir)
    sent = events.level_points(medium, 6, "medium", DEPTH - 1).unionByName(events.level_points(low, 7, "low", DEPTH - 2))
    return events.points_of(sent).select("label", "render_distance", "seq", "total_chunks", F.floor(F.size("values") / 8).alias("n_points"))


@query(f"{WITH} SELECT n AS n_points, 2 AS format_id, 26 AS record_length, CAST(0.01 AS DOUBLE) AS scale, x2 AS max_x, y1 AS min_up FROM h")
def header_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = events.header(spark, 2, las.read_header(point_file(spark, sf_dir)))
    got = m.select(F.from_json("payload", "PointCount bigint, FormatId int, StructSize int, ScaleFactors array<double>, MaximumBounds array<double>, MinimumBounds array<double>").alias("h"))
    return got.select(F.col("h.PointCount").alias("n_points"), F.col("h.FormatId").alias("format_id"), F.col("h.StructSize").alias("record_length"), F.get("h.ScaleFactors", F.lit(0)).alias("scale"), F.get("h.MaximumBounds", F.lit(0)).alias("max_x"), F.get("h.MinimumBounds", F.lit(2)).alias("min_up"))


def _told(spark: SparkSession, sf_dir: str, raw: dict[str, str]) -> DataFrame:
    """Messages of an upload by step, with the points that they hold."""
    sent = upload.process(spark, point_file(spark, sf_dir), Options.parse(raw), "s", depth=DEPTH).messages
    held = F.coalesce(F.floor(F.size(F.from_json("payload", "Points array<double>")["Points"]) / 8), F.lit(0))
    n = sent.select("step", "event", F.when(F.col("event").isin(events.POINTS, events.LOD), held).otherwise(0).alias("n"))
    return n.groupBy("step", "event").agg(F.count("*").alias("n_messages"), F.sum("n").alias("n_points"))


def told_sql(steps: list[tuple[int, str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {k} AS step, '{e}' AS event, CAST({m} AS BIGINT) AS n_messages, CAST({n} AS BIGINT) AS n_points" for k, e, m, n in steps)


def _of(table: str) -> tuple[str, str]:
    return f"(SELECT ceil(count(*) / CAST(162 AS DOUBLE)) FROM {table})", f"(SELECT count(*) FROM {table})"


START = [(0, "sessionId", "1", "0"), (1, "progress", "1", "0"), (2, "header", "1", "0")]
TREE = [(3, "progress", "1", "0"), (4, "progress", "1", "0"), (5, "points", *_of("base"))]
END = [(8, "file-ready", "1", "0"), (9, "done", "1", "0")]


@query(f"{WITH}, {lod_sql(DEPTH)} " + told_sql([*START, *TREE, (6, "lod-points", *_of("medium")), (7, "lod-points", *_of("low")), *END]))
def upload_with_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir, {"clustering": "true", "lod": "1", "density": "x"})


@query(f"{WITH}, {lod_sql(DEPTH)} " + told_sql([*START, *TREE, *END]))
def upload_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir, {"clustering": "T", "lod": "yes"})


@query(f"{WITH}, w AS (SELECT pos // 100000 AS w, count(*) AS n FROM p WHERE {HASHED} <= 400000 GROUP BY 1) " + told_sql([*START, (5, "points", "(SELECT sum(ceil(n / CAST(162 AS DOUBLE))) FROM w)", "(SELECT sum(n) FROM w)"), END[-1]]))
def upload_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without clustering levels are never made, whatever lod says."""
    return _told(spark, sf_dir, {"clustering": "False", "subsample": "true", "lod": "true", "density": "50"})


@query("""WITH o AS (SELECT event_id, ['true', 'T', '1', 'yes', '', 'TRUE', 'on', 't', 'false'][CAST(event_id % 9 AS INT) + 1] AS flag, ['0', '12.5', 'x', '', '100'][CAST(event_id % 5 AS INT) + 1] AS density FROM events)
SELECT event_id, flag IN ('1', 't', 'T', 'TRUE', 'true', 'True') AS flag, coalesce(TRY_CAST(density AS DOUBLE), 0) AS density, CAST(0.1 AS DOUBLE) + coalesce(TRY_CAST(density AS DOUBLE), 0) / 100 * CAST(0.6 AS DOUBLE) AS keep_rate FROM o""")
def parsed_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.pmod("event_id", F.lit(len(values))).cast("int"))
    flag, density = P.parsed_flag(pick(["true", "T", "1", "yes", "", "TRUE", "on", "t", "false"])), P.parsed_number(pick(["0", "12.5", "x", "", "100"]))
    return e.select("event_id", flag.alias("flag"), density.alias("density")).withColumn("keep_rate", F.lit(0.1) + F.col("density") / 100 * F.lit(0.6))


@query("""WITH e AS (SELECT user_id AS session, event_id AS seq, CASE WHEN event_id % 17 = 0 THEN 'done' ELSE 'points' END AS event, event_type AS payload FROM events),
f AS (SELECT session, min(seq) AS last FROM e WHERE event = 'done' GROUP BY session) SELECT session, seq, payload FROM e JOIN f USING (session) WHERE event = 'points' AND seq < last""")
def session_receive(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.pmod("event_id", F.lit(17)) == 0, "done").otherwise("points")
    return assembly.session_points(e.select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), kind.alias("event"), F.col("event_type").alias("payload")))
