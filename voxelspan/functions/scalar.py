"""Column functions on points: scaling, centring, colour, view geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxelspan.schema import FILE_PALETTE, POINT_FIELDS, VIEW_PALETTE, Header


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scaled(raw: Column | str, scale: float, offset: float = 0.0) -> Column:
    """A stored whole number as a coordinate; only the intended mode has an offset."""
    value = col(raw) * F.lit(float(scale))
    return value + F.lit(offset) if offset else value


def centred(header: Header) -> dict[str, Column]:
    """x, y, z moved to the middle of the header's bounds; y is the file's z."""
    dx, dy, dz = header.shift
    return {"x": F.col("x") + F.lit(dx), "y": F.col("y") + F.lit(dz), "z": F.col("z") + F.lit(dy)}


def _entry(palette: tuple, cls: Column, channel: int) -> Column:
    return F.try_element_at(F.array(*[F.lit(float(c[channel])) for c in palette]), cls.cast("int") + 1)


def resolved_colour(raw: Column | str, cls: Column | str, channel: int, palette: tuple = FILE_PALETTE) -> Column:
    """Of one channel, 0 to 1: the stored value, else the class's, else 1. A class outside the palette gives 1."""
    stored, known = col(raw), (col(cls) >= 2) & (col(cls) < len(palette))
    return F.when(stored != 0, stored / F.lit(255.0)).when(known, _entry(palette, col(cls), channel) / F.lit(255.0)).otherwise(F.lit(1.0))


def class_colour(own: Column | str, cls: Column | str, channel: int, palette: tuple = VIEW_PALETTE) -> Column:
    """The palette's colour for classes 0 to 11, else the point's own."""
    return F.when(col(cls).between(0, 11), _entry(palette, col(cls), channel) / F.lit(255.0)).otherwise(col(own))


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of channels 0 to 255."""
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(c.cast("bigint"))), 2, "0") for c in (r, g, b)])


def parse_hex(text: Column | str, channel: int) -> Column:
    """Channel 0, 1 or 2 of #rrggbb, 0 to 255."""
    return F.conv(F.substring(col(text), 2 + 2 * channel, 2), 16, 10).cast("int")


def exaggerated(up: Column | str, percent: float) -> Column:
    return col(up) * F.lit(1.0 + 2.0 * (percent / 100.0))


def distance(a: tuple, b: tuple) -> Column:
    """Between two points, each of three columns or names."""
    d = [col(p) - col(q) for p, q in zip(a, b)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def point_size(size: float, dist: Column) -> Column:
    return F.lit(float(size)) / dist


def transformed(matrix: list[list[float]], point: tuple) -> list[Column]:
    """The four homogeneous coordinates of matrix times (point, 1)."""
    return [sum((F.lit(float(m)) * col(p) for m, p in zip(row, point)), F.lit(0.0)) + F.lit(float(row[3])) for row in matrix]


def screen_position(ndc: Column, size: int, sign: int) -> Column:
    """Pixel of a normalised device coordinate; sign is -1 for the vertical axis. Halves round up."""
    return F.floor((F.lit(0.5) + F.lit(float(sign)) * ndc / F.lit(2.0)) * F.lit(float(size)) + F.lit(0.5)).cast("int")


def marker_scale(dist: Column, field_of_view: float, orthographic: bool = False) -> Column:
    return dist / F.lit(100.0) * F.lit(1.0 if orthographic else field_of_view / 75.0)


def camera_place(kind: Column | str, dx: Column, dy: Column, dz: Column) -> list[Column]:
    """Where the camera stands for view types 1 and 2 (slanted) and 3 (from above)."""
    above = col(kind) == 3
    return [F.when(above, F.lit(0.0)).otherwise(F.lit(0.5) * dx), F.when(above, dy).otherwise(F.lit(0.75) * dy), F.when(above, F.lit(0.0)).otherwise(-dz)]


def lod_point_size(level: Column | str, size: float) -> Column:
    return F.when(col(level) == "low", F.lit(4.0 * size)).when(col(level) == "medium", F.lit(2.0 * size)).otherwise(F.lit(float(size)))


def progress(done: Column, total: Column) -> Column:
    """Percent, rounded up; null where no total is known."""
    return F.ceil(F.try_divide(done.cast("double"), total.cast("double")) * 100)


def chunk_count(floats_per_chunk: int, points: Column) -> Column:
    return F.ceil(points * F.lit(POINT_FIELDS) / F.lit(float(floats_per_chunk)))


def display_columns(top_intensity: Column) -> list[Column]:
    """What a display takes of a point: place and colour as 32-bit floats, alpha its share of the highest intensity, the class as a whole number."""
    narrow = [F.col(c).cast("float").alias(c) for c in ("x", "y", "z", "r", "g", "b")]
    return [*narrow, (F.col("intensity") / top_intensity).cast("float").alias("alpha"), F.col("classification").cast("int").alias("classification")]


def parsed_flag(text: Column) -> Column:
    """True for 1 t T TRUE true True; anything else, null too, is false."""
    return F.coalesce(text.isin("1", "t", "T", "TRUE", "true", "True"), F.lit(False))


def parsed_number(text: Column) -> Column:
    """The number, 0 if the text is none."""
    return F.coalesce(F.try_to_number(text, F.lit("S999999999.999999")).cast("double"), F.lit(0.0))
