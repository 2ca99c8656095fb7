"""Measurements between picked points. A point is a tuple of three columns (x, up, z)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelspan.functions.scalar import distance
from voxelspan.schema import ARITY

Point = tuple[Column, Column, Column]


def rounded(v: Column) -> Column:
    """To two places, halves upward, as the viewer does."""
    return F.floor(v * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)


def point_of(struct: str) -> Point:
    return F.col(f"{struct}.x"), F.col(f"{struct}.y"), F.col(f"{struct}.z")


def original(p: Point, low: Point, high: Point, mode: str = "observed") -> Point:
    """A centred point in file coordinates; low and high in point axes. Observed, the third axis uses a 22nd of its extent."""
    part = {"observed": 22.0, "intended": 2.0}[mode]
    return p[0] + (low[0] + (high[0] - low[0]) / 2), p[1] + (low[1] + (high[1] - low[1]) / 2), p[2] + (low[2] + (high[2] - low[2]) / F.lit(part))


def length(a: Point, b: Point) -> Column:
    return rounded(distance(a, b))


def middle(a: Point, b: Point) -> Point:
    return tuple(F.least(p, q) + F.abs(p - q) / 2 for p, q in zip(a, b))


def angle(a: Point, at: Point, c: Point) -> Column:
    """In degrees; null where an arm has no length."""
    u, v = [p - q for p, q in zip(a, at)], [p - q for p, q in zip(c, at)]
    dot = u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    sizes = (u[0] * u[0] + u[1] * u[1] + u[2] * u[2]) * (v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    cosine = F.try_divide(dot, F.sqrt(sizes))
    within = F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))  # these skip nulls
    return F.when(cosine.isNotNull(), rounded(F.acos(within) * F.lit(180.0) / F.lit(3.141592653589793)))


def triangle(p1: Point, p2: Point, p3: Point, variant: str = "first") -> tuple[Column, Column, Column]:
    """Angles at the three corners; after a drag the third is what the rounded others leave of 180."""
    a1, a2 = angle(p2, p1, p3), angle(p1, p2, p3)
    return a1, a2, angle(p1, p3, p2) if variant == "first" else rounded(F.lit(180.0) - a1 - a2)


def area(p1: Point, p2: Point, p3: Point, p4: Point) -> Column:
    """Of two triangles over opposite corners, from angles that are rounded first."""
    radians = lambda a: a * F.lit(3.141592653589793) / F.lit(180.0)
    s = F.sin(radians(angle(p1, p2, p3))), F.sin(radians(angle(p3, p4, p1)))
    return rounded(F.lit(0.5) * (distance(p1, p2) * distance(p3, p2) * s[0] + distance(p1, p4) * distance(p3, p4) * s[1]))


def height(p: Point, low_up: Column, high_up: Column) -> Column:
    """Of a centred point above the lowest."""
    return rounded(p[1] - (low_up - (low_up + (high_up - low_up) / 2)))


def mean_point(*points: Point) -> Point:
    total = lambda k: sum((p[k] for p in points[1:]), points[0][k])
    return tuple(total(k) / len(points) for k in range(3))


def edges(*points: Point) -> Column:
    """An array of (edge_no, length) of the closed polygon."""
    return F.array(*[F.struct(F.lit(i + 1).alias("edge_no"), length(p, q).alias("length")) for i, (p, q) in enumerate(zip(points, points[1:] + points[:1]))])


def number_text(v: Column) -> Column:
    """A value to two places as the viewer writes it: halves upward, no zeros at the end."""
    cents = F.floor(v * F.lit(100.0) + F.lit(0.5)).cast("bigint")
    size = F.abs(cents)
    rest = F.pmod(size, F.lit(100))
    places = F.when(rest == 0, F.lit("")).when(F.pmod(rest, F.lit(10)) == 0, F.concat(F.lit("."), F.floor(rest / 10).cast("string"))).otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 2, "0")))
    return F.concat(F.when(cents < 0, F.lit("-")).otherwise(F.lit("")), F.floor(size / 100).cast("string"), places)


def point_label(p: Point, low: Point, high: Point, mode: str = "observed") -> Column:
    """The point in file coordinates, in the file's order of axes."""
    x, up, z = original(p, low, high, mode)
    return F.concat_ws(", ", number_text(x), number_text(z), number_text(up))


def length_label(a: Point, b: Point) -> Column:
    return F.concat(number_text(distance(a, b)), F.lit("m"))


def line_annotations(*points: Point) -> Column:
    """An array of (edge_no, label, x, y, z): each edge's length, placed at its middle."""
    rows = []
    for i, (p, q) in enumerate(zip(points, points[1:] + points[:1]), 1):
        at = middle(p, q)
        rows.append(F.struct(F.lit(i).alias("edge_no"), length_label(p, q).alias("label"), *[c.alias(a) for a, c in zip("xyz", at)]))
    return F.array(*rows)


def moved(p: Point, by: tuple[float, float, float]) -> Point:
    return tuple(c + F.lit(float(v)) for c, v in zip(p, by))


def is_marker(tool: Column, points: Column) -> Column:
    """Whether an array of picked points is as long as the tool takes; an unknown tool is no marker's."""
    wanted = F.lit(None).cast("int")
    for name, n in ARITY.items():
        wanted = F.when(tool == name, F.lit(n)).otherwise(wanted)
    return F.coalesce(F.size(points) == wanted, F.lit(False))
