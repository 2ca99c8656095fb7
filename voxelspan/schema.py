"""The point model: columns, file header, palettes and processing options."""

from __future__ import annotations

import math
from dataclasses import dataclass

POINT_SCHEMA = "pos bigint, x double, y double, z double, r double, g double, b double, intensity double, classification double"
FIELDS = ("x", "y", "z", "r", "g", "b", "intensity", "classification")

# Points in a message, records in a window, depth of the octree, distances of the levels of detail.
POINT_FIELDS = 8
CHUNK_FLOATS = 1296
CHUNK_POINTS = 162
WINDOW_POINTS = 100_000
OCTREE_DEPTH = 8
LOD_DISTANCES = {"base": 0, "medium": 200, "low": 400}

# Colours by class, red green blue. Class 0 and 1 of the file palette stand for "none".
FILE_PALETTE = (
    (0, 0, 0), (0, 0, 0), (161, 82, 46), (0, 255, 1), (0, 204, 0), (0, 153, 0), (255, 168, 0), (255, 0, 255), (0, 0, 255),
    (255, 255, 0), (255, 255, 255), (255, 255, 0), (255, 255, 0), (255, 255, 0), (255, 255, 0), (255, 255, 0), (255, 255, 0),
)
VIEW_PALETTE = (
    (255, 255, 255), (255, 255, 255), (161, 82, 46), (0, 255, 1), (0, 204, 0), (0, 153, 0), (255, 168, 0), (255, 0, 255),
    (0, 0, 255), (255, 255, 255), (255, 255, 0), (255, 255, 0), (255, 255, 0), (255, 255, 0), (255, 255, 0), (255, 255, 0),
)

# Points each measuring tool takes.
ARITY = {"point": 1, "height": 1, "distance": 2, "angle": 3, "area": 4}


@dataclass(frozen=True)
class Header:
    """What a point file says of its records. Bounds are in file order: x, y, z, where z is up."""

    count: int
    scale: tuple[float, float, float] = (1.0, 1.0, 1.0)
    offset: tuple[float, float, float] = (0.0, 0.0, 0.0)
    low: tuple[float, float, float] = (0.0, 0.0, 0.0)
    high: tuple[float, float, float] = (0.0, 0.0, 0.0)
    format_id: int = 0
    record_length: int = 20
    data_offset: int = 227

    @property
    def shift(self) -> tuple[float, float, float]:
        """What centring adds to each file axis."""
        return tuple(-((h - lo) / 2) - lo for lo, h in zip(self.low, self.high))

    @property
    def window(self) -> int:
        return min(WINDOW_POINTS, self.count)

    @property
    def total_chunks(self) -> int:
        """Messages expected for the whole file; 0 for an empty one."""
        if not self.window:
            return 0
        full, rest = divmod(self.count, self.window)
        return math.ceil(self.window * POINT_FIELDS / CHUNK_FLOATS) * full + math.ceil(rest * POINT_FIELDS / CHUNK_FLOATS)

    def box(self) -> tuple[tuple[float, float], tuple[float, float], tuple[float, float]]:
        """(low, high) of point axes x, y (up), z."""
        return (self.low[0], self.high[0]), (self.low[2], self.high[2]), (self.low[1], self.high[1])


@dataclass(frozen=True)
class Options:
    """Processing options, which arrive as strings."""

    clustering: bool = False
    subsample: bool = False
    lod: bool = False
    density: float = 0.0

    @classmethod
    def parse(cls, raw: dict[str, str]) -> Options:
        """True is one of 1 t T TRUE true True, anything else false; a density that is no number is 0."""
        flag = lambda k: raw.get(k, "") in ("1", "t", "T", "TRUE", "true", "True")
        try:
            density = float(raw.get("density", ""))
        except ValueError:
            density = 0.0
        return cls(flag("clustering"), flag("subsample"), flag("lod"), density)

    @property
    def keep_rate(self) -> float:
        return 0.1 + self.density / 100 * 0.6

    @property
    def levels(self) -> tuple[str, ...]:
        return ("base", "medium", "low") if self.clustering and self.lod else ("base",)
