"""Box expressions. ``offset`` is 0 for continuous coordinates, 1 where a box includes its last pixel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def polygon_area(ring: Column) -> Column:
    """Area inside a ring of any number of vertices, given as a flat list x, y, x, y, ...; fewer than three give 0."""
    n = F.floor(F.size(ring) / 2).cast("int")

    def corner(i: Column) -> Column:
        j = (i + 1) % n
        return F.get(ring, 2 * i) * F.get(ring, 2 * j + 1) - F.get(ring, 2 * j) * F.get(ring, 2 * i + 1)

    twice = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + corner(i))
    return F.when(n >= 3, F.abs(twice) / 2).otherwise(0.0)


def mask_area(rings: Column) -> Column:
    """Area of all rings; null or empty is 0."""
    return F.coalesce(F.aggregate(rings, F.lit(0.0), lambda s, ring: s + polygon_area(ring)), F.lit(0.0))


class Box:
    """Four corner columns, usable inside select, join conditions and higher-order lambdas."""

    def __init__(self, x1: Column, y1: Column, x2: Column, y2: Column):
        self.x1, self.y1, self.x2, self.y2 = x1, y1, x2, y2

    @classmethod
    def of(cls, prefix: str = "") -> "Box":
        return cls(*[F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2")])

    @classmethod
    def field(cls, struct: Column) -> "Box":
        return cls(struct["x1"], struct["y1"], struct["x2"], struct["y2"])

    @classmethod
    def from_xywh(cls, x: Column, y: Column, w: Column, h: Column) -> "Box":
        return cls(x, y, x + w, y + h)

    @classmethod
    def from_rotated(cls, cx: Column, cy: Column, w: Column, h: Column, degrees: Column) -> "Box":
        """Axis-aligned box around a rotated one."""
        c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
        half_w, half_h = (c * w + s * h) / 2, (c * h + s * w) / 2
        return cls(cx - half_w, cy - half_h, cx + half_w, cy + half_h)

    def to_xywh(self) -> tuple[Column, Column, Column, Column]:
        return self.x1, self.y1, self.x2 - self.x1, self.y2 - self.y1

    def area(self, offset: float = 0.0) -> Column:
        return (self.x2 - self.x1 + offset) * (self.y2 - self.y1 + offset)

    def centre(self) -> tuple[Column, Column]:
        return (self.x1 + self.x2) / 2, (self.y1 + self.y2) / 2

    def scaled(self, sx: float | Column, sy: float | Column) -> "Box":
        return Box(self.x1 * sx, self.y1 * sy, self.x2 * sx, self.y2 * sy)

    def clipped(self, width: Column, height: Column) -> "Box":
        def hold(v: Column, limit: Column) -> Column:
            return F.least(F.greatest(v, F.lit(0.0)), limit)

        return Box(hold(self.x1, width), hold(self.y1, height), hold(self.x2, width), hold(self.y2, height))

    def inside(self, width: Column, height: Column, margin: float = 0.0) -> Column:
        return (
            (self.x1 >= -margin) & (self.y1 >= -margin) & (self.x2 < width + margin) & (self.y2 < height + margin)
        )

    def sides_at_least(self, minimum: float, offset: float = 0.0, height: float | None = None) -> Column:
        """Both sides reach the minimum; ``height`` is the minimum of the vertical one where it differs."""
        tall = minimum if height is None else height
        return (self.x2 - self.x1 + offset >= minimum) & (self.y2 - self.y1 + offset >= tall)

    def nonempty(self, threshold: float = 0.0) -> Column:
        return (self.x2 - self.x1 > threshold) & (self.y2 - self.y1 > threshold)

    def intersection(self, other: "Box", offset: float = 0.0) -> Column:
        w = F.least(self.x2, other.x2) - F.greatest(self.x1, other.x1) + offset
        h = F.least(self.y2, other.y2) - F.greatest(self.y1, other.y1) + offset
        return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))

    def iou(self, other: "Box", offset: float = 0.0) -> Column:
        common = self.intersection(other, offset)
        return F.coalesce(
            F.try_divide(common, self.area(offset) + other.area(offset) - common), F.lit(0.0)
        )


def aspect_bucket(height: Column, width: Column, bounds: list[float]) -> Column:
    """Number of bounds at or below h/w (right bisect)."""
    ratio = height / width
    bucket = F.lit(0)
    for b in sorted(bounds):
        bucket = bucket + F.when(ratio >= b, 1).otherwise(0)
    return bucket
