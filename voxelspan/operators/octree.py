"""Octree cells by arithmetic: a cell is the path of its octants, three bits a level; the parent is code >> 3."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Box = tuple[tuple[float, float], tuple[float, float], tuple[float, float]]
#: Levels at most: an axis has 2 ** depth - 1 middles, which the plan carries as one literal.
MAX_DEPTH = 12


def in_box(box: Box) -> Column:
    """Inclusive at both ends, like a cell."""
    tests = [F.col(a).between(F.lit(lo), F.lit(hi)) for a, (lo, hi) in zip("xyz", box)]
    return tests[0] & tests[1] & tests[2]


def edges(lo: float, hi: float, depth: int) -> list[float]:
    """Ends of an axis's cells: each level puts a middle, lo + (hi - lo) / 2 of its own cell, between any two."""
    out = [float(lo), float(hi)]
    for _ in range(depth):
        out = [v for a, b in zip(out, out[1:]) for v in (a, a + (b - a) / 2)] + out[-1:]
    return out


def _spread(depth: int) -> Column:
    """A table: each number of ``depth`` bits with two zeros put before every bit."""
    return F.lit([sum((v >> k & 1) << 3 * k for k in range(depth)) for v in range(1 << depth)])


def assign_cells(points: DataFrame, box: Box, depth: int) -> DataFrame:
    """points within box with cell_code (bigint) and depth; points outside have no cell and go.

    Octants are numbered 0 LLL 1 LHL 2 LLH 3 LHH 4 HLH 5 HLL 6 HHL 7 HHH over (x, y, z), the first whose closed box
    holds the point: a middle belongs to the low half, but for z between high x and low y, where octant 4 comes first.

    An axis's place is the count of middles below the coordinate, guessed by a division and set right by the middles
    themselves, so it is what halving level by level gives. Then the three places' bits are combined for all levels at
    once. Projections only: no join, no shuffle, and no chain of levels for the optimizer to copy.
    """
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"a depth from 0 to {MAX_DEPTH}")
    own = [c for c in points.columns if c not in ("cell_code", "depth")]
    df, n = points.where(in_box(box)), 1 << depth
    flat = {a: lo == hi for a, (lo, hi) in zip("xyz", box)}
    middles = {a: edges(lo, hi, depth)[1:-1] for a, (lo, hi) in zip("xyz", box)}
    for a, (lo, hi) in zip("xyz", box):
        if not flat[a] and any(p >= q for p, q in zip([lo, *middles[a]], [*middles[a], hi])):
            raise ValueError(f"the box is too narrow on axis {a} for {depth} levels")
    one = F.lit(0).cast("bigint")
    guess = lambda a, lo, hi: F.least(F.greatest(F.floor((F.col(a) - F.lit(float(lo))) * F.lit(n / (hi - lo))), one), F.lit(n - 1).cast("bigint"))
    df = df.withColumns({f"_{a}": one if flat[a] or not depth else guess(a, lo, hi) for a, (lo, hi) in zip("xyz", box)})

    def place(a: str) -> Column:
        if flat[a] or not depth:
            return F.col(f"_{a}")
        i, m = F.col(f"_{a}"), F.lit(middles[a])
        below, above = F.get(m, (i - 1).cast("int")), F.get(m, i.cast("int"))  # null outside
        return F.when(F.col(a) <= below, i - 1).when(F.col(a) > above, i + 1).otherwise(i)

    # an array of one row: predicates on cell_code stay above it, instead of repeating every middle in the scan's filter
    df = df.withColumn("_p", F.explode(F.array(F.struct(*[place(a).alias(a) for a in "xyz"]))))
    x, y, z = F.col("_p.x"), F.col("_p.y"), F.col("_p.z")
    if flat["z"]:
        # every middle is the coordinate itself: high wherever octant 4 comes first
        z = x.bitwiseAND(F.bitwise_not(y))
    elif depth:
        # z on the middle after its place: that middle's level is the lowest bit of its number
        bit = (z + 1).bitwiseAND(-(z + 1))
        tie = (F.get(F.lit(middles["z"]), z.cast("int")) == F.col("z")) & (x.bitwiseAND(bit) != 0) & (y.bitwiseAND(bit) == 0)
        z = z + F.when(tie, F.lit(1)).otherwise(F.lit(0))
    return df.select(*own, encode(x, y, z, depth).alias("cell_code"), F.lit(depth).alias("depth"))


def encode(x: Column, y: Column, z: Column, depth: int) -> Column:
    """The cell at a place of whole numbers from 0 to 2 ** depth - 1 on each axis."""
    keep = lambda v: F.bitwise_not(v)
    middle = x.bitwiseAND(y).bitwiseOR(keep(x).bitwiseAND(z))
    low = x.bitwiseAND(keep(y.bitwiseXOR(z))).bitwiseOR(keep(x).bitwiseAND(y))
    spread = lambda v: F.get(_spread(depth), v.bitwiseAND(F.lit((1 << depth) - 1)).cast("int"))
    return (spread(x) * 4 + spread(middle) * 2 + spread(low)).cast("bigint")


def parent(code: Column, levels: int = 1) -> Column:
    return F.shiftright(code, 3 * levels)


def prefix_range(code: int, level: int, depth: int) -> Column:
    """Cells of the given depth below a cell of a shallower level: a range, so statistics of files that hold cell_code prune it."""
    width = 3 * (depth - level)
    return F.col("cell_code").between(F.lit(code << width), F.lit(((code + 1) << width) - 1))


def cell_box(code: int, level: int, box: Box) -> Box:
    """The closed box of a cell: what a scan of coordinates can prune by before any cell is computed."""
    ends = list(box)
    for k in range(level - 1, -1, -1):
        octant = code >> 3 * k & 7
        high_x = octant >= 4
        high_y = octant in (1, 3) if not high_x else octant >= 6
        high_z = octant in (2, 3) if not high_x else octant in (4, 7)
        for i, high in enumerate((high_x, high_y, high_z)):
            lo, hi = ends[i]
            m = lo + (hi - lo) / 2
            ends[i] = (m, hi) if high else (lo, m)
    return tuple(ends)


def cell_stats(cells: DataFrame) -> DataFrame:
    """Points, extent and highest intensity of every cell that has any."""
    ends = [f(a).alias(f"{f.__name__}_{a}") for a in "xyz" for f in (F.min, F.max)]
    return cells.groupBy("cell_code").agg(F.count("*").alias("n_points"), *ends, F.max("intensity").alias("max_intensity"))


def dropped(points: DataFrame, box: Box) -> DataFrame:
    """One row: points in all, and those that no cell holds."""
    return points.agg(F.count("*").alias("n_points"), F.coalesce(F.sum((~in_box(box)).cast("bigint")), F.lit(0)).alias("n_dropped"))


def meets(box: Box, part: Box) -> bool:
    return all(lo <= b and a <= hi for (lo, hi), (a, b) in zip(box, part))


def covering(part: Box, box: Box, level: int, depth: int, most: int = 64) -> list[tuple[int, int]]:
    """Ranges of cell codes of ``depth`` that hold every point of ``part``: at most ``most``, from cells of ``level``.

    Ranges that lie closest are joined until they are few enough, so what they hold beyond is read and dropped.
    """
    found, width = [], 3 * (depth - level)
    cells = [0] if meets(box, part) else []
    for k in range(1, level + 1):
        cells = [c * 8 + o for c in cells for o in range(8) if meets(cell_box(c * 8 + o, k, box), part)]
    for c in sorted(cells):
        if found and found[-1][1] + 1 == c << width:
            found[-1][1] = ((c + 1) << width) - 1
        else:
            found.append([c << width, ((c + 1) << width) - 1])
    return few_ranges([tuple(r) for r in found], most)


def few_ranges(ranges: list[tuple[int, int]], most: int = 64) -> list[tuple[int, int]]:
    """The same with the smallest gaps closed, until there are at most ``most``. ranges rise and don't overlap."""
    gaps = sorted(range(1, len(ranges)), key=lambda i: ranges[i][0] - ranges[i - 1][1], reverse=True)
    cut = sorted(gaps[: most - 1])
    return [(ranges[a][0], ranges[b - 1][1]) for a, b in zip([0, *cut], [*cut, len(ranges)])] if ranges else []


def in_ranges(column: str, ranges: list[tuple[int, int]]) -> Column:
    """A predicate that the statistics of sorted files can prune by."""
    out = F.lit(False)
    for lo, hi in ranges:
        out = out | F.col(column).between(F.lit(lo), F.lit(hi))
    return out
