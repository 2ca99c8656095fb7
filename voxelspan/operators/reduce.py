"""Reduction of cells, levels of detail, and distributed numbering of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelspan.operators.octree import parent
from voxelspan.sources.storage import stored

#: Points of a cell beyond which it is reduced in slices, so that no task gets more of it than that.
SLICE = 1 << 20
#: Levels of cells whose counts one task may order, and of which every task may hold a row each: 8 ** 4 rows.
COARSE_LEVELS = 4
#: Slices whose points are counted together before those of one of them are.
SLICES = 64


def numbered(df: DataFrame, group: str | list[str], order: list[Column | str], name: str = "rn", coarse: Column | None = None, total: str | None = None, ranges: int | None = None) -> DataFrame:
    """df with a running number from 1 over (group, order), and the count of all rows as ``total`` if that is named.

    Rows are numbered within their group; the groups' counts give what stands before each. ``coarse`` is a column over
    the group's columns, rising with them and of a few thousand values: counts are summed within each, and only one row
    for each of those meets in one task. Without it, the groups themselves have to be that few. With ``ranges`` rows are dealt
    to that many partitions by ranges of the group, and come out in their order; the groups have to be few enough to broadcast.
    """
    groups = [group] if isinstance(group, str) else list(group)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*groups).agg(F.count("*").alias("_c")).withColumn("_k", F.lit(0) if coarse is None else coarse)
    within = F.coalesce(F.sum("_c").over(before(Window.partitionBy("_k").orderBy(*groups))), F.lit(0))
    if coarse is None:
        starts = counts.select(*groups, within.alias("_s"), F.sum("_c").over(Window.partitionBy("_k")).alias("_t"))
    else:
        tops = counts.groupBy("_k").agg(F.sum("_c").alias("_c"))
        tops = tops.select("_k", F.coalesce(F.sum("_c").over(before(Window.orderBy("_k"))), F.lit(0)).alias("_s0"), F.sum("_c").over(Window.partitionBy()).alias("_t"))
        starts = counts.join(F.broadcast(tops), "_k").select(*groups, (F.col("_s0") + within).alias("_s"), "_t")  # some thousand rows
    dealt = df.repartitionByRange(ranges, *groups) if ranges else df  # the window and the join leave rows where they are
    local = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    out = local.join(F.broadcast(starts) if ranges else starts, groups).withColumn(name, F.col("_s") + F.col("_r"))
    if total:
        out = out.withColumn(total, F.col("_t"))
    return out.drop("_s", "_r", "_t")


#: Rows of a cell that can stay: its first, and those of its first half.
HALF = "_rn = 1 or _rn * 2 <= _n"


def _reduce_whole(cells: DataFrame, order: list[str]) -> DataFrame:
    """One shuffle, by cell."""
    cell = Window.partitionBy("cell_code")
    df = cells.withColumns({"_rn": F.row_number().over(cell.orderBy(*order)), "_n": F.col("_n") if "_n" in cells.columns else F.count("*").over(cell)}).where(HALF)
    df = df.withColumn("_fo", F.row_number().over(Window.partitionBy("cell_code", "x", "y", "z").orderBy("_rn")))
    df = df.withColumn("_keep", F.max(F.when(F.col("_fo") == 1, F.col("_rn"))).over(cell))
    return df.where("_rn <= _keep").drop("_rn", "_fo", "_n", "_keep")  # _n as first_halves() gives it too


def _starts(counts: DataFrame, part: list[str]) -> DataFrame:
    """Ranges (cell_code first) that reach into their cell's first half: the points before each, _b, and of the cell, _n."""
    cell = Window.partitionBy("cell_code")
    earlier = F.sum("n").over(cell.orderBy(*part[1:]).rowsBetween(Window.unboundedPreceding, -1))
    every = counts.select(*part, F.coalesce(earlier, F.lit(0)).alias("_b"), F.sum("n").over(cell).alias("_n"))
    return every.where("_b = 0 or _b * 2 < _n")


def slice_counts(cells: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """n points of each cell by ranges of pos, stored: cell_code, _s, n."""
    return stored(cells.groupBy("cell_code", F.floor(F.col("pos") / slice_rows).cast("bigint").alias("_s")).agg(F.count("*").alias("n")))


def first_halves(cells: DataFrame, counts: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """cells, with the count of their cell as _n, without the ranges of pos that lie behind its first half.

    ``counts`` are slice_counts(); one row a cell goes to every task, so nothing is moved.
    """
    last = _starts(counts, ["cell_code", "_s"]).groupBy("cell_code").agg(F.max("_s").alias("_last"), F.max("_n").alias("_n"))
    return cells.join(F.broadcast(last), "cell_code").where(F.floor(F.col("pos") / slice_rows) <= F.col("_last")).drop("_last")


def _up_to(order: list[str]) -> Column:
    """Rows up to the place in the order that _end_<column> name, that included."""
    *outer, last = order
    out = F.col(last) <= F.col(f"_end_{last}")
    for c in reversed(outer):
        out = (F.col(c) < F.col(f"_end_{c}")) | ((F.col(c) == F.col(f"_end_{c}")) & out)
    return out


def _half_ends(cells: DataFrame, order: list[str], slice_rows: int, counts: DataFrame | None = None) -> DataFrame:
    """Where each cell's first half ends (of a single point, at that): cell_code and _end_<column> of the order, stored.

    Counts lead there, each within what the one before found: by the columns before the last, by ranges of the last while
    some cell has more than slice_rows points in what was found, and by rank in a range. ``counts``, by the first of these, may be given.
    """
    *outer, last = order
    ranges = {"_w": SLICES * slice_rows, "_s": slice_rows} if counts is None else {"_s": slice_rows}
    steps = {c: F.col(c) for c in outer} | {k: F.floor(F.col(last) / w).cast("bigint") for k, w in ranges.items()} | {"_p": F.col(last)}
    keyed, cell = cells.select("cell_code", *[c.alias(k) for k, c in steps.items()]), Window.partitionBy("cell_code")
    found, known = None, []
    for k in steps:
        if found is None:
            rows = keyed.groupBy("cell_code", k).agg(F.count("*").alias("n")) if counts is None else counts
            rows = rows.withColumn("_left", F.greatest(F.floor(F.sum("n").over(cell) / 2), F.lit(1).cast("bigint")))
        elif k in ranges and (found.agg(F.max("_m")).first()[0] or 0) <= slice_rows:
            continue
        else:
            rows = keyed.join(found.drop("_m"), ["cell_code", *known])
            rows = rows.withColumn("n", F.lit(1)) if k == "_p" else rows.groupBy("cell_code", *known, "_left", k).agg(F.count("*").alias("n"))
        reached = F.sum("n").over(cell.orderBy(k).rowsBetween(Window.unboundedPreceding, 0))
        there = rows.withColumn("_u", reached).where("_u - n < _left and _left <= _u")
        known.append(k)
        found = stored(there.select("cell_code", *known, (F.col("_left") - F.col("_u") + F.col("n")).alias("_left"), F.col("n").alias("_m")))
    return found.select("cell_code", *[F.col(c).alias(f"_end_{c}") for c in outer], F.col("_p").alias(f"_end_{last}"))


def _reduce_sliced(cells: DataFrame, order: list[str], slice_rows: int, counts: DataFrame | None = None) -> DataFrame:
    """No point is moved: counts say where first halves end, an aggregate of their places where the last new one is, and
    points are held against that, a row a cell, where they are (if Spark finds these rows small). No rank of all points is
    taken; at most slice_rows of a cell are ordered in a task. Places of first halves are all that is shuffled, once.
    In the order of pos slice_counts() may be given."""
    *outer, last = order
    half = cells.join(_half_ends(cells, order, slice_rows, counts), "cell_code").where(_up_to(order))
    firsts = half.groupBy("cell_code", "x", "y", "z", *outer).agg(F.min(last).alias(last))
    if outer:
        key = F.col(outer[0]) if len(outer) == 1 else F.struct(*outer)
        firsts = firsts.groupBy("cell_code", "x", "y", "z").agg(*[F.min_by(c, key).alias(c) for c in order])
    tops = firsts.groupBy("cell_code", *outer).agg(F.max(last).alias(last))
    cuts = tops.groupBy("cell_code").agg(F.max(F.struct(*order)).alias("_c")).select("cell_code", *[F.col("_c")[c].alias(f"_end_{c}") for c in order])
    return cells.join(stored(cuts), "cell_code").where(_up_to(order)).select(*cells.columns)


def reduce_cells(cells: DataFrame, order: list[str] | None = None, slice_rows: int = SLICE, largest: int | None = None) -> DataFrame:
    """Observed reduction: each cell keeps the first half of its points, at most up to the last new place among them.

    Of n points in order, p_1 to p_keep stay, keep being the largest i <= n / 2 whose x, y, z none of p_1 to p_(i-1)
    has; a cell of one point keeps it. ``order`` ends with a whole number.

    Cells of more than slice_rows points are reduced in slices: the same rows, and no task holds such a cell whole.
    ``largest`` is the count of the fullest cell, or a bound, found by one aggregation where it isn't given.
    """
    order, counts = order or ["pos"], cells.groupBy("cell_code").agg(F.count("*").alias("n"))
    if largest is None:
        largest = counts.agg(F.max("n")).first()[0] or 0
    if largest <= slice_rows:
        return _reduce_whole(cells, order)
    hot = stored(counts.where(F.col("n") > slice_rows).select("cell_code"))  # at most a cell for slice_rows points
    if hot.isEmpty():
        return _reduce_whole(cells, order)
    sliced = _reduce_sliced(cells.join(hot, "cell_code", "left_semi").select(*cells.columns), order, slice_rows)
    return sliced.unionByName(_reduce_whole(cells.join(hot, "cell_code", "left_anti").select(*cells.columns), order))


def reduce_finest(cells: DataFrame, depth: int, slice_rows: int = SLICE) -> DataFrame:
    """reduce_cells of cells of a known depth: if they are few, points behind first halves go before any is moved."""
    if depth > COARSE_LEVELS:
        return reduce_cells(cells, ["pos"], slice_rows)
    width = max(1, slice_rows // 16)
    counts = slice_counts(cells, width)
    largest = counts.groupBy("cell_code").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    return _reduce_sliced(cells, ["pos"], width, counts) if largest > slice_rows else _reduce_whole(first_halves(cells, counts, width), ["pos"])


def reduce_hot_cells(cells: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """reduce_cells in slices, whatever the counts."""
    return _reduce_sliced(cells, ["pos"], slice_rows)


def coarser(cells: DataFrame, slice_rows: int = SLICE, largest: int | None = None) -> DataFrame:
    """One level up: what the children kept, in the order of the finest cells, reduced again. Needs leaf_code and pos."""
    up = cells.withColumns({"cell_code": parent(F.col("cell_code")), "depth": F.col("depth") - 1})
    return reduce_cells(up, ["leaf_code", "pos"], slice_rows, largest)


def levels_of_detail(cells: DataFrame, steps: int = 2, slice_rows: int = SLICE, watch: Callable[[int, DataFrame], DataFrame] = lambda k, level: level, depth: int | None = None) -> list[DataFrame]:
    """The reduced cells and ``steps`` coarser levels, each reduced from the one before over its own cells.

    One aggregation bounds what the fullest cell of each level has to reduce: all points of a finest cell, of a coarser
    one what its finest cells can have kept, halved once a level.
    Whole cells share one shuffle, by the coarsest; if a cell of any level is too full for one task, or the coarsest
    are too few to keep a cluster busy, each level has its own. What ``watch`` makes of a level stands in its place.

    ``depth`` is that of the cells; if it says that they are few, points behind a cell's first half go before any is moved.
    """
    held = depth is not None and depth <= COARSE_LEVELS
    width = max(1, slice_rows // 16)
    sliced = slice_counts(cells, width) if held else None
    counts = (sliced if held else cells).groupBy("cell_code").agg((F.sum("n") if held else F.count("*")).alias("n"))
    bound, tops = counts, []
    for k in range(steps + 1):
        tops.append(bound.agg(F.max("n").alias("n"), F.count("*").alias("m")).select(F.lit(k).alias("k"), "n", "m"))
        kept = F.greatest(F.floor(F.col("n") / 2), F.lit(1).cast("bigint"))
        bound = bound.groupBy(parent(F.col("cell_code")).alias("cell_code")).agg(F.sum(kept).alias("n"))
    every = tops[0]
    for t in tops[1:]:
        every = every.unionByName(t)
    found = {r["k"]: (r["n"] or 0, r["m"]) for r in every.collect()}
    base = cells.withColumn("leaf_code", F.col("cell_code"))
    hot = found[0][0] > slice_rows
    if held and not hot:
        base = first_halves(base, sliced, width)
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if found[steps][0] <= slice_rows and found[steps][1] >= 4 * tasks:
        base = base.repartition(parent(F.col("leaf_code"), steps))
    level = watch(0, _reduce_sliced(base, ["pos"], width, sliced) if held and hot else reduce_cells(base, ["pos"], slice_rows, found[0][0]))
    out = [level]
    for k in range(1, steps + 1):
        level = watch(k, coarser(level, slice_rows, found[k][0]))
        out.append(level)
    return out


def chunks(points: DataFrame, group: str, order: list[str], size: int = 162, depth: int = 0) -> DataFrame:
    """points with chunk_no (from 0) and total_chunks: messages of ``size`` points in (group, order).

    ``depth`` is that of the cells in ``group``; beyond COARSE_LEVELS levels, counts are summed by coarser cells first.
    """
    coarse = parent(F.col(group), depth - COARSE_LEVELS) if depth > COARSE_LEVELS else None
    df = numbered(points, group, order, coarse=coarse, total="_all")
    return df.withColumns({"chunk_no": F.floor((F.col("rn") - 1) / size), "total_chunks": F.ceil(F.col("_all") / F.lit(float(size)))}).drop("rn", "_all")


def window_chunks(points: DataFrame, window: int = 100_000, size: int = 162, sampled: bool = False) -> DataFrame:
    """points with window_no and chunk_no within it; pos counts from 0.

    Nothing is shuffled where all of a window's points are there; of sampled ones a window's are ranked, at most
    ``window`` of them.
    """
    number = F.floor(F.col("pos") / F.lit(window))
    place = F.row_number().over(Window.partitionBy("window_no").orderBy("pos")) - 1 if sampled else F.pmod(F.col("pos"), F.lit(window))
    return points.withColumn("window_no", number).withColumn("chunk_no", F.floor(place / F.lit(size)))


def messages(chunked: DataFrame, event: str = "points") -> DataFrame:
    """One JSON message a chunk, its points flat and in order."""
    row = F.struct("pos", F.array("x", "y", "z", "r", "g", "b", "intensity", "classification").alias("v"))
    flat = F.flatten(F.transform(F.sort_array(F.collect_list(row)), lambda s: s["v"]))
    packed = chunked.groupBy("chunk_no").agg(flat.alias("points"), F.max("total_chunks").alias("total"))
    return packed.select("chunk_no", F.to_json(F.struct(F.lit(event).alias("event"), "points", "total")).alias("payload"))
