"""Nearest points by cells: joins that go down a pyramid and leave what is too far, and rays that walk its cells."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelspan.operators import kdtree, octree
from voxelspan.operators.octree import Box
from voxelspan.operators.pyramid import Pyramid, high2, levels_of, low2
from voxelspan.sources.storage import stored

#: Points of a cell that isn't cut further, points of a box within it, and queries that are held against those at once.
CELL_POINTS, BOX_POINTS, AT_ONCE = 4096, 256, 4096
#: Cells that every task may hold.
SMALL = 1 << 17
#: Cells of a ray that are read first, and by how much later rounds grow.
FIRST_CELLS, GROWTH = 8, 8
#: Cells up to which a round's are named to the files.
NAMED = 4096


def depth_for(n: int) -> int:
    """Levels at which cells of n evenly spread points hold a few each."""
    depth = 1
    while 8**depth * 4 < n and depth < octree.MAX_DEPTH:
        depth += 1
    return depth


def closest(q: np.ndarray, bound: np.ndarray, p: np.ndarray, pos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """d2 and pos of the k of p that are nearest to each of q, the smallest pos first of equals; inf and -1 beyond.

    What lies farther than bound may be left out. Boxes of p are looked at whole: the nearest one, then those that can
    still hold something.
    """
    nodes, order = kdtree.grow(p, BOX_POINTS)
    boxes = nodes[nodes["left"] < 0]
    held = [o[np.argsort(pos[o])] for o in (order[b["start"] : b["stop"]] for b in boxes)]
    best, who = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)
    for start in range(0, len(q), AT_ONCE):
        some, d, w = q[start : start + AT_ONCE], best[start : start + AT_ONCE], who[start : start + AT_ONCE]
        limit = bound[start : start + AT_ONCE]
        low = np.zeros((len(some), len(boxes)))
        for a in range(3):
            away = np.maximum(np.maximum(boxes["low"][None, :, a] - some[:, a, None], some[:, a, None] - boxes["high"][None, :, a]), 0)
            low += away * away
        nearest = low.argmin(1)

        def look(rows: np.ndarray, i: int) -> None:
            own, n = p[held[i]], min(k, len(held[i]))
            v = [own[None, :, a] - some[rows, a, None] for a in range(3)]
            far = v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
            pick = far.argmin(1)[:, None] if n == 1 else np.argsort(far, 1, kind="stable")[:, :n]  # the first of equals has the smallest pos
            both = np.concatenate([d[rows], np.take_along_axis(far, pick, 1)], 1), np.concatenate([w[rows], pos[held[i]][pick]], 1)
            first = np.lexsort(both[::-1], axis=1)[:, :k]
            d[rows], w[rows] = np.take_along_axis(both[0], first, 1), np.take_along_axis(both[1], first, 1)

        for i in np.unique(nearest).tolist():
            look(np.flatnonzero(nearest == i), i)
        for i in range(len(boxes)):
            # widened by more than rounding can take
            rows = np.flatnonzero((nearest != i) & (low[:, i] <= np.minimum(d[:, -1], limit) * (1 + 1e-9) + 1e-300))
            if len(rows):
                look(rows, i)
    return best, who


def _held(queries: DataFrame, cells: DataFrame, keys: list[str], own: list[str], k: int, last: bool = False) -> DataFrame:
    """Queries (id, qx, qy, qz, hint) against the points of their cell: pos and d2 of the k nearest, or with last d2 of the k-th."""
    kinds = dict(queries.dtypes)
    names = [*own, "id", "d2"] if last else [*own, "id", "pos", "d2"]
    schema = ", ".join(f"`{n}` {kinds.get(n, {'pos': 'bigint', 'd2': 'double'}.get(n))}" for n in names)

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        numbers = lambda t, columns: np.stack([t.column(x).to_numpy() for x in columns], 1)
        if not q.num_rows or not c.num_rows:
            return pa.table({n: pa.array([], q.schema.field(n).type if n in q.schema.names else pa.int64() if n == "pos" else pa.float64()) for n in names})
        bound = q.column("hint").fill_null(float("inf")).to_numpy()
        d2, who = closest(numbers(q, ("qx", "qy", "qz")), bound, numbers(c, "xyz"), c.column("pos").to_numpy(), k)
        i, j = np.nonzero(who >= 0) if not last else (np.flatnonzero(who[:, -1] >= 0), -1)
        out = {n: q.column(n).take(pa.array(i)) for n in [*own, "id"]} | {"pos": who[i, j], "d2": d2[i, j]}
        return pa.table({n: out[n] for n in names})

    q = queries.select(*keys, "id", "qx", "qy", "qz", "hint")
    return q.groupBy(*keys).cogroup(cells.select(*keys, "pos", "x", "y", "z").groupBy(*keys)).applyInArrow(run, schema)


def nearest_join(queries: DataFrame, points: DataFrame, box: Box, depth: int, k: int = 1, by: str | None = None, cell_points: int = CELL_POINTS) -> DataFrame:
    """The k nearest of ``points`` (pos, x, y, z, intensity) to each of ``queries`` (id, x, y, z): id, rank, pos, d2.

    Of equally near ones the smallest pos comes first. Points outside ``box`` take no part; queries may lie anywhere.
    Fewer than k rows if there are fewer points. With ``by``, a column of both (not one of a pyramid's), a query looks among the points of its own
    group only; an id is then one within its group, and the group is returned too.

    Cells are cut until they hold at most ``cell_points`` points, or are of ``depth``. A query is held against the cell
    that it lies in, which gives a distance within which k points are; then, from the root on, it keeps the cells that
    reach into that distance, and is held against those. So a query is moved once for each cell near it. A query that
    lies where no k points are goes down by the cells' extents instead: those no farther, at their nearest, than a
    distance within which k points must be. Of points at the same place, no more than the first k are looked at.
    """
    own = [by] if by else []
    keys = [*own, "level", "cell"]
    at = tuple(F.col(f"q{a}") for a in "xyz")
    place = Window.partitionBy(*own, "x", "y", "z").orderBy("pos")
    if k > 1:
        first = points.select(*own, "pos", "x", "y", "z").withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= k)
    else:
        first = points.groupBy(*own, "x", "y", "z").agg(F.min("pos").alias("pos"))
    cells = stored(octree.assign_cells(first.select(*own, "pos", "x", "y", "z", F.lit(0.0).alias("intensity")), box, depth))
    ends = [f"{f}_{a}" for a in "xyz" for f in ("min", "max")]
    levels = stored(levels_of(cells, depth, own).select(*own, "level", F.col("cell_code").alias("cell"), "n_points", *ends))
    cut = levels.where(F.col("n_points") > cell_points).select(*own, (F.col("level") + 1).alias("level"), F.col("cell").alias("_up"))
    up = octree.parent(F.col("cell")).alias("_up")
    tree = levels.where("level = 0").select(*keys, F.lit(0).cast("bigint").alias("_up"), "n_points", *ends).unionByName(levels.where("level > 0").select("*", up).join(cut, [*own, "level", "_up"]))
    leaf = (F.col("n_points") <= cell_points) | (F.col("level") == depth)
    tree = stored(tree.withColumn("leaf", leaf))
    found = {(r["level"], r["leaf"]): r["n"] for r in tree.groupBy("level", "leaf").agg(F.count("*").alias("n")).collect()}
    told: Callable[[DataFrame], DataFrame] = F.broadcast if sum(found.values()) <= SMALL else lambda df: df
    ends_at = sorted(level for level, is_leaf in found if is_leaf)

    def placed(df: DataFrame) -> DataFrame:
        each = df.withColumn("level", F.explode(F.lit(ends_at).cast("array<int>"))).withColumn("cell", F.expr(f"shiftright(cell_code, 3 * ({depth} - level))"))
        return each.join(told(tree.where("leaf").select(*keys)), keys)

    held = placed(cells)
    asked = queries.select(*own, "id", *[F.col(a).alias(f"q{a}") for a in "xyz"])
    within = placed(octree.assign_cells(queries.select(*own, "id", "x", "y", "z"), box, depth)).withColumnsRenamed({a: f"q{a}" for a in "xyz"})
    hints = stored(_held(within.withColumn("hint", F.lit(None).cast("double")), held, keys, own, k, last=True).withColumnRenamed("d2", "hint"))
    seen, blind = asked.join(hints, [*own, "id"]), asked.join(hints, [*own, "id"], "left_anti").withColumn("hint", F.lit(None).cast("double"))
    one = Window.partitionBy(*own, "id")
    far = lambda bound: bound * (1 + 1e-9) + 1e-300  # noqa: E731  more than rounding can take

    def narrowed(near: DataFrame) -> DataFrame:
        near = near.withColumn("_held", F.sum("n_points").over(one.orderBy("_high", "level", "cell")))
        near = near.withColumn("_bound", F.min(F.when(F.col("_held") >= k, F.col("_high"))).over(one))
        return near.where(F.col("_bound").isNull() | (F.col("_low") <= far(F.col("_bound"))))

    def down(rows: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
        rows = rows.withColumns({"level": F.lit(0), "cell": F.lit(0).cast("bigint")})
        for level in range(1, max((lv for lv, _ in found), default=0) + 1):
            # a cell's children, or itself if it isn't cut
            below = tree.where(F.col("level") == level).withColumn("_level", F.lit(level - 1)).unionByName(tree.where(F.col("leaf") & (F.col("level") < level)).withColumns({"_up": F.col("cell"), "_level": F.col("level")}))
            rows = rows.withColumnsRenamed({"level": "_level", "cell": "_up"}).join(told(below), [*own, "_level", "_up"])
            rows = keep(rows.withColumns({"_low": low2(at), "_high": high2(at)})).select(*keys, "id", "qx", "qy", "qz", "hint")
        return rows

    met = down(seen, lambda near: near.where(F.col("_low") <= far(F.col("hint")))).unionByName(down(blind, narrowed))
    best = _held(met, held, keys, own, k).withColumn("rank", F.row_number().over(one.orderBy("d2", "pos")))
    return best.where(F.col("rank") <= k).select(*own, "id", "rank", "pos", "d2")


def cells_met(rays: DataFrame, box: Box, level: int, reach: float) -> DataFrame:
    """ray_id and cell_code of the cells within ``reach`` of each ray, and some that are a little farther.

    A ray (ox, oy, oz, and dx, dy, dz of length 1) is cut where it crosses a plane between cells; each stretch meets the
    cells between its ends, widened by reach on every axis. One shuffle, for cells that several stretches meet.
    """
    n = 1 << level
    step = [(hi - lo) / n for lo, hi in box]
    wide = [int(reach / s) + 1 if s else 0 for s in step]
    o, d = [F.col(f"o{a}") for a in "xyz"], [F.col(f"d{a}") for a in "xyz"]
    ends = [(lo - w * s - (0 if s else reach), hi + w * s + (0 if s else reach)) for (lo, hi), s, w in zip(box, step, wide)]
    enter = [F.when(di != 0, F.least((F.lit(a) - oi) / di, (F.lit(b) - oi) / di)).when(oi.between(a, b), F.lit(0.0)) for (a, b), oi, di in zip(ends, o, d)]
    leave = [F.when(di != 0, F.greatest((F.lit(a) - oi) / di, (F.lit(b) - oi) / di)).when(oi.between(a, b), F.lit(float("inf"))) for (a, b), oi, di in zip(ends, o, d)]
    never = F.lit(False)
    for e in enter:
        never = never | e.isNull()
    spans = rays.where(~never).withColumns({"_in": F.greatest(F.lit(0.0), *enter), "_out": F.least(*leave)}).where("_in <= _out")

    def crossings(lo: float, s: float, w: int, oi: Column, di: Column) -> Column:
        at = F.transform(F.sequence(F.lit(-w), F.lit(n + w)), lambda k: (F.lit(lo) + k * F.lit(s) - oi) / di)
        return F.when(di != 0, at).otherwise(F.array().cast("array<double>"))

    planes = [crossings(lo, s, w, oi, di) for (lo, _), s, w, oi, di in zip(box, step, wide, o, d) if s]
    crossed = F.filter(F.concat(*planes), lambda t: (t > F.col("_in")) & (t < F.col("_out"))) if planes else F.array().cast("array<double>")
    cuts = spans.withColumn("_t", F.array_sort(F.concat(F.array("_in"), crossed, F.array("_out"))))
    stretch = F.transform(F.sequence(F.lit(1), F.size("_t") - 1), lambda i: F.struct(F.get("_t", i - 1).alias("a"), F.get("_t", i).alias("b")))
    met = cuts.select("ray_id", *[f"o{a}" for a in "xyz"], *[f"d{a}" for a in "xyz"], F.explode(stretch).alias("_m"))
    for a, (lo, hi), s, oi, di in zip("xyz", box, step, o, d):
        if not s:
            met = met.withColumn(f"c{a}", F.lit(0).cast("bigint"))
            continue
        p, q = oi + di * F.col("_m.a"), oi + di * F.col("_m.b")
        more = F.lit(reach) + 1e-7 * (F.lit(abs(lo) + abs(hi) + reach) + F.abs(oi) + F.abs(F.col("_m.b")))  # than rounding can take
        first = F.greatest(F.floor((F.least(p, q) - more - F.lit(lo)) / F.lit(s)), F.lit(0).cast("bigint"))
        last = F.least(F.floor((F.greatest(p, q) + more - F.lit(lo)) / F.lit(s)), F.lit(n - 1).cast("bigint"))
        met = met.withColumn(f"c{a}", F.explode(F.when(first <= last, F.sequence(first, last))))
    visited = met.select("ray_id", "cx", "cy", "cz").distinct()
    return visited.select("ray_id", octree.encode(F.col("cx"), F.col("cy"), F.col("cz"), level).alias("cell_code"))


def _along(p: tuple[Column, Column, Column]) -> tuple[Column, Column]:
    """How far along a ray the foot of a place is, and its squared distance from the ray's line."""
    w = [v - F.col(f"o{a}") for a, v in zip("xyz", p)]
    t = w[0] * F.col("dx") + w[1] * F.col("dy") + w[2] * F.col("dz")
    return t, w[0] * w[0] + w[1] * w[1] + w[2] * w[2] - t * t


def pick_many(rays: DataFrame, cloud: Pyramid, reach: float, level: int | None = None) -> DataFrame:
    """The nearest point along each ray within ``reach`` of it: ray_id, pos, x, y, z, t, cells_read, cells_all.

    rays: ray_id (unique), ox, oy, oz, dx, dy, dz with directions of length 1. A ray that meets nothing has no row; of
    equally near points the smallest pos is picked. cells_read and cells_all count the cells of ``level``.

    A ray's cells are read in the order in which they may begin along it, some at first and more in each round, until
    the point found is nearer than all that is left can be. Files are read by ranges of cells.
    """
    level = min(level or 4, cloud.depth)
    all_cells = cloud.levels.where(F.col("level") == level)
    rays = stored(rays.select("ray_id", *[f"o{a}" for a in "xyz"], *[f"d{a}" for a in "xyz"]))
    met = cells_met(rays, cloud.box, level, reach).join(all_cells, "cell_code").join(rays, "ray_id")
    half = [(F.col(f"max_{a}") - F.col(f"min_{a}")) / 2 for a in "xyz"]
    radius = F.sqrt(half[0] * half[0] + half[1] * half[1] + half[2] * half[2])
    t, away = _along(tuple(F.col(f"min_{a}") + h for a, h in zip("xyz", half)))
    once = lambda c: F.explode(F.array(c))  # noqa: E731  an array of one row: what is read several times isn't copied into each expression
    met = met.withColumn("_e", once(F.lit(float(reach)) + 1e-7 * (1 + radius + F.abs(t) + F.sqrt(F.greatest(away, F.lit(0.0))))))  # more than rounding takes
    # along the ray, where it is within reach of the extent on every axis
    inf, low, high = F.lit(float("inf")), [], []
    for a in "xyz":
        lo, hi, di = (F.col(f"min_{a}") - F.col("_e") - F.col(f"o{a}")), (F.col(f"max_{a}") + F.col("_e") - F.col(f"o{a}")), F.col(f"d{a}")
        there = (lo <= 0) & (hi >= 0)
        low.append(F.when(di != 0, F.least(lo / di, hi / di)).otherwise(F.when(there, -inf).otherwise(inf)))
        high.append(F.when(di != 0, F.greatest(lo / di, hi / di)).otherwise(F.when(there, inf).otherwise(-inf)))
    met = met.withColumn("_span", once(F.struct(F.greatest(*low).alias("a"), F.least(*high).alias("b"))))
    met = met.withColumns({"_low": F.col("_span.a") - 1e-9 * (1 + F.abs("_span.a")), "_high": F.col("_span.b") + 1e-9 * (1 + F.abs("_span.b"))})
    near = met.where((F.col("_span.a") <= F.col("_span.b")) & (F.col("_high") >= 0))
    order = Window.partitionBy("ray_id").orderBy("_low", "cell_code")
    queue = stored(near.select("ray_id", "cell_code", "_low", F.row_number().over(order).alias("_k")))
    best = stored(rays.select("ray_id").where("false").withColumns({"hit": F.lit(None).cast("struct<t: double, pos: bigint, x: double, y: double, z: double>"), "_read": F.lit(0)}))
    start, stop = 0, FIRST_CELLS
    while True:
        left = queue.join(best.select("ray_id", F.col("hit.t").alias("_t")), "ray_id", "left").where(F.col("_t").isNull() | (F.col("_low") <= F.col("_t")))
        turn = stored(left.where((F.col("_k") > start) & (F.col("_k") <= stop)).select("ray_id", "cell_code"))
        codes = [r[0] for r in turn.select("cell_code").distinct().limit(NAMED + 1).collect()]
        if not codes:
            break
        points, width = cloud.points, 3 * (cloud.depth - level)
        if len(codes) <= NAMED:
            points = points.where(octree.in_ranges("cell_code", octree.few_ranges([(c << width, ((c + 1) << width) - 1) for c in sorted(codes)])))
        t, away = _along(tuple(F.col(a) for a in "xyz"))
        own = points.withColumn("cell_code", octree.parent(F.col("cell_code"), cloud.depth - level)).select("cell_code", "pos", "x", "y", "z")
        hits = own.join(turn, "cell_code").join(rays, "ray_id").withColumns({"t": t, "_off": away}).where((F.col("t") >= 0) & (F.col("_off") <= F.lit(float(reach * reach))))
        found = hits.groupBy("ray_id").agg(F.min(F.struct("t", "pos", "x", "y", "z")).alias("hit"))
        read = turn.groupBy("ray_id").agg(F.count("*").cast("int").alias("_read"))
        new = read.join(found, "ray_id", "left").select("ray_id", "hit", "_read")
        best = stored(best.unionByName(new).groupBy("ray_id").agg(F.min("hit").alias("hit"), F.sum("_read").cast("int").alias("_read")))  # min() leaves nulls out
        start, stop = stop, stop * GROWTH
    total = all_cells.agg(F.count("*").alias("cells_all"))  # one row
    return best.where(F.col("hit").isNotNull()).join(F.broadcast(total)).select("ray_id", "hit.pos", "hit.x", "hit.y", "hit.z", "hit.t", F.col("_read").alias("cells_read"), "cells_all")
