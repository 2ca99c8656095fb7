"""Clusters: nearest centroid, costs, means, Lloyd's iterations and the search for the number of clusters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelspan.operators import boxes, kdtree, neighbours, octree
from voxelspan.operators.kdtree import Centroids
from voxelspan.operators.octree import Box
from voxelspan.operators.pyramid import exact_sum
from voxelspan.schema import FIELDS
from voxelspan.sources.storage import stored

#: Centroids up to which the nearest is one expression (of more, its code is too long to be compiled), and numbers of
#: points that are ranked together.
WIDE, SLICE = 8, 1 << 20
TURN = 0.4142135


def squared(c: tuple[float, float, float]) -> Column:
    d = [F.col(a) - F.lit(float(v)) for a, v in zip("xyz", c)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def nearest(points: DataFrame, centroids: Centroids) -> DataFrame:
    """points with cluster_id and d2, the squared distance; of equal ones the first centroid. No join.

    One expression for up to WIDE centroids, else a pass over Arrow batches.
    """
    if len(centroids) > WIDE:
        return _nearest_in_batches(points, centroids)
    best = F.array_min(F.array(*[F.struct(squared(c).alias("d2"), F.lit(i).alias("i")) for i, c in enumerate(centroids)]))
    return points.withColumn("_best", best).withColumns({"cluster_id": F.col("_best.i"), "d2": F.col("_best.d2")}).drop("_best")


def _nearest_in_batches(points: DataFrame, centroids: Centroids) -> DataFrame:
    c = np.array(centroids, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                some = batch.slice(a, 2000)
                w = [some.column(x).to_numpy(zero_copy_only=False)[:, None] - c[None, :, i] for i, x in enumerate("xyz")]
                d2 = w[0] * w[0] + w[1] * w[1] + w[2] * w[2]
                label = d2.argmin(1)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(label.astype(np.int32)), pa.array(d2[np.arange(len(label)), label])], [*some.schema.names, "cluster_id", "d2"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInArrow(run, f"{fields}, cluster_id int, d2 double")


def cost(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster_id").agg(F.count("*").alias("n_points"), exact_sum("d2").alias("sse"))


def mean_cost(assigned: DataFrame, k: int, fields: int = 8) -> DataFrame:
    """The variant that divides by the count of centroid values."""
    return assigned.agg((exact_sum("d2") / F.lit(float(fields * k))).alias("mean_cost"))


def means(assigned: DataFrame) -> DataFrame:
    """Of every field, but for intensity the maximum."""
    avg = [F.avg(c).alias(c) for c in ("x", "y", "z", "r", "g", "b", "classification") if c in assigned.columns]
    return assigned.groupBy("cluster_id").agg(*avg, F.max("intensity").alias("intensity"))


def seeds(points: DataFrame, k: int) -> Centroids:
    """k distinct places, the first by a hash of the coordinates: the same whatever the partitions; the driver holds k rows."""
    start = points.select("x", "y", "z").distinct().orderBy(F.xxhash64("x", "y", "z"), "x", "y", "z").limit(k).collect()
    return [(r["x"], r["y"], r["z"]) for r in start]


def distinct_sample(points: DataFrame, k: int, by: Column) -> DataFrame:
    """k points, the first by a column that stands for chance, ties by pos."""
    return points.withColumn("_by", by).orderBy("_by", "pos").limit(k).drop("_by")


def lloyd(points: DataFrame, k: int, iterations: int = 10, start: Centroids | None = None) -> Centroids:
    """Centroids of all points from ``start`` (else seeds()), at most ``iterations`` passes; the driver holds k rows.

    Passes end once no centroid moves. A cluster that lost all its points keeps its centroid. Every pass reads the
    points again, so they should be stored ones.
    """
    centroids = list(start) if start is not None else sorted(seeds(points, k))
    for _ in range(iterations):
        rows = nearest(points, centroids).groupBy("cluster_id").agg(*[F.avg(a).alias(a) for a in "xyz"]).collect()
        moved = list(centroids)
        for r in rows:
            moved[r["cluster_id"]] = (r["x"], r["y"], r["z"])
        if moved == centroids:
            break
        centroids = moved
    return centroids


def two_means(points: DataFrame, iterations: int = 50, start: Centroids | None = None) -> DataFrame:
    """The viewer's clustering: two clusters of all points, their means."""
    return means(nearest(points, lloyd(points, 2, iterations, start)))


def by_sevens(points: DataFrame, width: int = 7) -> DataFrame:
    """What the viewer takes for points: the values of all points, one after another, read ``width`` at a time.

    points have FIELDS and pos, gapless from 0; returned are pos (of the group) and its values x, y, z, r, g, b, alpha, of
    which fewer are there for a smaller width. A run of ``width`` points ends where a group ends, so a task needs one
    such run. A last group that isn't full is left out: it would turn a mean into no number.
    """
    names = ("x", "y", "z", "r", "g", "b", "alpha")[:width]
    row = F.struct("pos", F.array(*FIELDS).alias("v"))
    runs = points.groupBy(F.floor(F.col("pos") / width).alias("_run")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(row)), lambda s: s["v"])).alias("_v"))
    place = F.explode(F.sequence(F.lit(0), F.lit(len(FIELDS) - 1))).alias("_k")
    whole = runs.select("_run", "_v", place).where((F.col("_k") + 1) * width <= F.size("_v"))
    return whole.select((F.col("_run") * len(FIELDS) + F.col("_k")).alias("pos"), *[F.get("_v", F.col("_k") * width + i).alias(n) for i, n in enumerate(names)])


def seven_means(groups: DataFrame, iterations: int = 50, start: Centroids | None = None) -> DataFrame:
    """The viewer's clustering as it is observed: two clusters of by_sevens(), best stored; alpha is the largest, at least 0."""
    found = nearest(groups, lloyd(groups, 2, iterations, start)).groupBy("cluster_id")
    return found.agg(F.count(F.lit(1)).alias("n_groups"), *[F.avg(c).alias(c) for c in ("x", "y", "z", "r", "g", "b")], F.greatest(F.max("alpha"), F.lit(0.0)).alias("alpha"))


def rounded(mean: Column) -> Column:
    """To a thousandth, so that the order of additions doesn't show; turned where no mean of hundredths lies."""
    return F.floor(mean * 1000 + TURN) / 1000


def lloyd_cells(cells: DataFrame, box: Box, share: float = 0.5, iterations: int = 10, cap: int = 1 << 22) -> DataFrame:
    """Intended reduction: every cell's n points become the means of at most share * n clusters, intensity the highest.

    Clusters start at points evenly spaced in the order of pos; their centres are rounded() means. A cell
    of up to ``cap`` points is one task's, which holds groups of its points against boxes of centres; a larger one is
    spread over the cluster, nearest centres by a join that goes down a pyramid of the centres within each cell. Both
    give the same rows. cells: of assign_cells, in which no pos stands twice; ``box`` holds them all. Columns that
    aren't needed are best left out before: all of them are moved.
    """
    every = list(cells.columns)
    names = [c for c in every if c != "cell_code"]
    how = {x: "mean" for x in names} | {"pos": "min", "depth": "min", "intensity": "max"}

    def run(rows: pa.Table) -> pa.Table:
        n, k = rows.num_rows, max(1, int(rows.num_rows * share))
        first = np.argsort(rows.column("pos").to_numpy())[np.arange(k) * (n - 1) // max(1, k - 1)]
        order, p = boxes.ordered(np.stack([rows.column(a).to_numpy() for a in "xyz"], 1))
        at = np.empty(n, np.int64)
        at[order] = np.arange(n)
        at, groups = at[first], boxes.Groups(p)
        c, moved = p[at], None
        for step in range(iterations):
            label = groups.assign(at, c, moved)
            if step == iterations - 1:
                break
            count = np.bincount(label, minlength=k)
            new = np.floor(np.stack([np.bincount(label, groups.coordinates(a), k) for a in range(3)], 1) / np.maximum(count, 1)[:, None] * 1000 + TURN) / 1000
            new[count == 0] = c[count == 0]
            moved = (new != c).any(1)
            if not moved.any():
                break
            c = new
        by = np.argsort(label, kind="stable")
        starts = np.flatnonzero(np.diff(label[by], prepend=-1))
        out = {}
        for x in every:
            v = rows.column(x).to_numpy()[order][by]  # nulls are no numbers, and left out
            if x == "cell_code":
                v = v[starts]
            elif how[x] == "mean":
                there = ~np.isnan(v)
                size = np.add.reduceat(there.astype(np.int64), starts)
                v = np.where(size > 0, np.add.reduceat(np.where(there, v, 0.0), starts) / np.maximum(size, 1), np.nan)
            else:
                v = (np.fmin if how[x] == "min" else np.fmax).reduceat(v, starts)
            out[x] = pa.array(v, from_pandas=True).cast(rows.schema.field(x).type, safe=False)
        return pa.table(out)

    sizes = cells.groupBy("cell_code").agg(F.count("*").alias("_n")).where(F.col("_n") > cap)
    crowded = [tuple(r) for r in sizes.collect()]  # one for cap points at most
    whole = cells if not crowded else cells.where(~F.col("cell_code").isin([c for c, _ in crowded]))
    whole = whole.groupBy("cell_code").applyInArrow(run, cells.schema)
    if not crowded:
        return whole
    large = stored(cells.join(F.broadcast(cells.sparkSession.createDataFrame(crowded, "cell_code bigint, _n bigint")), "cell_code"))
    label = _labels_spread(large, box, share, iterations)
    merged = {"mean": F.avg, "min": F.min, "max": F.max}
    means = large.join(label, ["cell_code", "pos"]).groupBy("cell_code", "_l").agg(*[merged[how[x]]("pos" if x == "pos" else x).alias(x) for x in names])
    kinds = dict(cells.dtypes)
    return whole.unionByName(means.select(*[F.col(c).cast(kinds[c]).alias(c) for c in every]))


def _labels_spread(points: DataFrame, box: Box, share: float, iterations: int) -> DataFrame:
    """cell_code, pos and _l, the number of its cluster, of the points (with _n) of large cells."""
    part = F.floor(F.col("pos") / SLICE)
    counts = points.groupBy("cell_code", part.alias("_p")).agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("cell_code").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("cell_code", "_p", F.coalesce(before, F.lit(0)).alias("_b"))
    ranked = points.withColumn("_p", part).withColumn("_r", F.row_number().over(Window.partitionBy("cell_code", "_p").orderBy("pos")) - 1).join(starts, ["cell_code", "_p"])
    rank, k, n = F.col("_b") + F.col("_r"), F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(share)).cast("bigint")), F.col("_n")
    gaps = F.greatest(F.lit(1), k - 1)
    # centre i starts at rank i * (n - 1) div (k - 1); several may start at one rank
    low, high = F.ceil(rank * gaps / (n - 1)) - 1, F.floor((rank + 1) * gaps / (n - 1)) + 1
    which = F.filter(F.sequence(F.greatest(low, F.lit(0).cast("bigint")), F.least(high, k - 1)), lambda i: F.floor(i * (n - 1) / gaps).cast("bigint") == rank)
    seeds_of = ranked.select("cell_code", F.explode(F.when(n == 1, F.array(F.lit(0).cast("bigint"))).otherwise(which)).alias("_l"), "x", "y", "z")
    centres, label = stored(seeds_of), None
    queries = points.select(F.col("cell_code").alias("_cell"), F.col("pos").alias("id"), "x", "y", "z")
    most, level = points.agg(F.max("_n"), F.max("depth")).first()
    depth = min(octree.MAX_DEPTH, level + neighbours.depth_for(most))
    wide = tuple((lo - w, hi + w) for lo, hi in box for w in (1e-3 + 1e-6 * max(abs(lo), abs(hi)),))  # a rounded mean may leave the box
    for step in range(iterations):
        near = neighbours.nearest_join(queries, centres.withColumnsRenamed({"_l": "pos", "cell_code": "_cell"}), wide, depth, by="_cell")
        label = stored(near.select(F.col("_cell").alias("cell_code"), F.col("id").alias("pos"), F.col("pos").alias("_l")))
        if step == iterations - 1:
            break
        moved = points.join(label, ["cell_code", "pos"]).groupBy("cell_code", "_l").agg(*[rounded(F.avg(a)).alias(f"n{a}") for a in "xyz"])
        changed = F.lit(False)
        for a in "xyz":
            changed = changed | F.coalesce(F.col(f"n{a}") != F.col(a), F.lit(False))
        new = stored(centres.join(moved, ["cell_code", "_l"], "left").select("cell_code", "_l", *[F.coalesce(f"n{a}", a).alias(a) for a in "xyz"], changed.alias("_moved")))
        if not new.where("_moved").limit(1).count():
            break
        centres = new.drop("_moved")
    return label


def unit(pos: Column, turn: int) -> Column:
    """A number from 0 to 1 that stands for chance: of pos and the turn alone."""
    return ((pos + turn * 48271) % 1000003 * 7919 + 104729) % 1000000 / F.lit(1000000.0)


def candidate_seeds(points: DataFrame, k: int, rounds: int = 3, factor: float = 2.0) -> list[tuple[int, float, float, float, int]]:
    """(pos, x, y, z, weight) of candidates for k seeds, by k-means|| (Bahmani et al., VLDB 2012).

    The first is chosen by chance. Each round takes points with a chance of factor * k * d2 / cost, about factor * k of
    them; the weight counts the points that are nearest to a candidate, and those without any are left out. Each round
    is two passes; the driver holds the candidates, about factor * k * rounds.
    """
    first = points.select("pos", "x", "y", "z").orderBy(unit(F.col("pos"), 0), "pos").limit(1).collect()
    found = [tuple(r) for r in first]
    for turn in range(1, rounds + 1) if found else ():
        near = nearest(points.select("pos", "x", "y", "z"), [c[1:] for c in found])
        cost = near.agg(F.sum("d2")).first()[0]
        if not cost:
            break
        taken = near.where(unit(F.col("pos"), turn) * F.lit(float(cost)) < F.lit(float(factor * k)) * F.col("d2"))
        found += [tuple(r) for r in sorted(taken.select("pos", "x", "y", "z").collect())]
    counts = nearest(points.select("x", "y", "z"), [c[1:] for c in found]).groupBy("cluster_id").agg(F.count("*").alias("n")).collect() if found else []
    return [(*found[r["cluster_id"]], r["n"]) for r in sorted(counts)]


def parallel_seeds(points: DataFrame, k: int, rounds: int = 3, factor: float = 2.0) -> Centroids:
    """k seeds among the candidates: the heaviest first, then each time that of the largest weight times squared distance."""
    found = candidate_seeds(points, k, rounds, factor)
    if not found:
        return []
    places, weight = np.array([c[1:4] for c in found], float), np.array([c[4] for c in found], float)
    chosen = [int(weight.argmax())]
    d2 = ((places - places[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(found)) and (weight * d2).max() > 0:
        chosen.append(int((weight * d2).argmax()))
        d2 = np.minimum(d2, ((places - places[chosen[-1]]) ** 2).sum(1))
    return [tuple(map(float, places[i])) for i in chosen]


def prefix_costs(points: DataFrame, order: str, k_max: int) -> DataFrame:
    """k and the cost of taking the first k points as centroids, for k up to k_max; the driver holds k_max points.

    A batch of points is one row a k. What stands before the point is added up as whole numbers within batches too, so
    neither the order of additions nor where batches end shows.
    """
    first = [(r["x"], r["y"], r["z"]) for r in points.orderBy(order).limit(k_max).select("x", "y", "z").collect()]

    def split(d2: np.ndarray) -> tuple[Decimal, float]:
        held = np.floor(np.where(d2 < 2.0**63, d2, 0.0))  # larger ones are added up as they are
        high, low = np.divmod(held.astype(np.int64), 1 << 31)
        return Decimal((int(high.sum()) << 31) + int(low.sum())), float((d2 - held).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [batch.column(a).to_numpy(zero_copy_only=False) for a in "xyz"]
            near, costs = np.full(batch.num_rows, np.inf), []
            for c in first:
                w = [v - o for v, o in zip(p, c)]
                near = np.fmin(near, w[0] * w[0] + w[1] * w[1] + w[2] * w[2])
                costs.append(split(near))
            if batch.num_rows:
                wholes, parts = zip(*costs)
                yield pa.RecordBatch.from_arrays([pa.array(range(1, len(first) + 1), pa.int32()), pa.array(wholes, pa.decimal128(38, 0)), pa.array(parts, pa.float64())], ["k", "whole", "part"])

    placed = points.select("x", "y", "z").where("x is not null and y is not null and z is not null")
    return placed.mapInArrow(run, "k int, whole decimal(38,0), part double").groupBy("k").agg((F.sum("whole").cast("double") + F.sum("part")).alias("cost"))


def largest_drop(costs: DataFrame) -> DataFrame:
    """The k before which the cost falls most, the first of equals: a few rows by construction."""
    drop = costs.withColumn("drop", F.lag("cost").over(Window.orderBy("k")) - F.col("cost"))
    return drop.where("drop is not null").agg(F.max_by("k", F.struct("drop", -F.col("k"))).alias("k"))


def observed_elbow(costs: DataFrame) -> DataFrame:
    """What the search over k = 1, 4, 7 ... really picks: the k from 4 with the largest cost, the first of equals."""
    return costs.where("k >= 4 and k % 3 = 1").agg(F.max_by("k", F.struct(F.col("cost"), -F.col("k"))).alias("k"))


def bisected_elbow(cost: Callable[[int], float], most: int) -> int:
    """A k whose fall of the cost is greater than its neighbours', found by halving 1 to most; most + 1 if none is met.

    Costs are asked for as they are needed, some log2(most) times three, and each once.
    """
    asked = cache(cost)
    fall = lambda k: abs(asked(k - 1) - asked(k)) if 1 < k <= most else 0.0
    low, high = 1, most + 1
    while low < high:
        k = (low + high) // 2
        left, here, right = fall(k - 1), fall(k), fall(k + 1)
        if left < here > right:
            return k
        low, high = (low, k) if left >= here >= right else (k + 1, high)
    return most + 1


def array_distance(a: Column, b: Column) -> Column:
    """Euclidean, of arrays of any length."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x))


def pick(points: DataFrame, origin: tuple, direction: tuple, threshold: float) -> DataFrame:
    """The nearest point along a ray within ``threshold`` of it; none if the ray meets nothing. direction has length 1."""
    w = [F.col(a) - F.lit(float(o)) for a, o in zip("xyz", origin)]
    d = [F.lit(float(v)) for v in direction]
    t = w[0] * d[0] + w[1] * d[1] + w[2] * d[2]
    away = w[0] * w[0] + w[1] * w[1] + w[2] * w[2] - t * t
    hits = points.withColumns({"t": t, "off2": away}).where((F.col("t") >= 0) & (F.col("off2") <= F.lit(threshold * threshold)))
    return hits.orderBy("t", "pos").limit(1)


def argmin_argmax(points: DataFrame, group: str, value: str) -> DataFrame:
    """Of each group the pos of its smallest and its largest value, the first of equals."""
    low, high = F.min_by("pos", F.struct(value, "pos")), F.max_by("pos", F.struct(F.col(value), -F.col("pos")))
    return points.groupBy(group).agg(low.alias("argmin_pos"), high.alias("argmax_pos"))
