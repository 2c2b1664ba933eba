"""Box algebra. A box is four Columns (x, y, x2, y2), y upwards."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x: Column
    y: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, alias: str = "", names: tuple[str, ...] = ("x", "y", "x2", "y2")) -> Box:
        return cls(*(F.col(f"{alias}.{n}" if alias else n) for n in names))


def area(a: Box) -> Column:
    return (a.x2 - a.x) * (a.y2 - a.y)


def overlap_x(a: Box, b: Box) -> Column:
    return F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x, b.x), F.lit(0.0))


def overlap_y(a: Box, b: Box) -> Column:
    return F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y, b.y), F.lit(0.0))


def intersection(a: Box, b: Box) -> Column:
    return overlap_x(a, b) * overlap_y(a, b)


def overlaps(a: Box, b: Box) -> Column:
    """P-BOX-OVERLAP: strict overlap in both directions."""
    return (a.x < b.x2) & (b.x < a.x2) & (a.y < b.y2) & (b.y < a.y2)


def ioa(a: Box, b: Box) -> Column:
    """P-IOA: share of the first box that the second covers; 0 for an empty first box."""
    return F.coalesce(F.try_divide(intersection(a, b), area(a)), F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """P-IOU: intersection over union."""
    return F.coalesce(F.try_divide(intersection(a, b), area(a) + area(b) - intersection(a, b)), F.lit(0.0))


def y_ratio(a: Box, b: Box) -> Column:
    """Vertical overlap over the smaller height."""
    return F.coalesce(F.try_divide(overlap_y(a, b), F.least(a.y2 - a.y, b.y2 - b.y)), F.lit(0.0))


def contains(outer: Box, inner: Box, share: float = 0.95, slack: float = 2.0) -> Column:
    """P-CONTAIN: the inner box lies in the outer one but for a tolerance."""
    wide = Box(outer.x - slack, outer.y - slack, outer.x2 + slack, outer.y2 + slack)
    return ioa(inner, wide) >= share


def distance(a: Box, b: Box) -> Column:
    """P-DIST: between the nearest points."""
    dx = F.greatest(a.x - b.x2, b.x - a.x2, F.lit(0.0))
    dy = F.greatest(a.y - b.y2, b.y - a.y2, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def transform(a: Box, b: Box) -> dict[str, Column]:
    """P-TRANSFORM: scale and shift that take the first box to the second; null for an empty box."""
    sx, sy = F.try_divide(b.x2 - b.x, a.x2 - a.x), F.try_divide(b.y2 - b.y, a.y2 - a.y)
    return {"scale_x": sx, "scale_y": sy, "shift_x": b.x - a.x * sx, "shift_y": b.y - a.y * sy}


def to_page(a: Box, width: Column, height: Column) -> Box:
    """P-COORD: image box (y downwards) to page box: flipped, padded by 1, whole, clipped to the page."""
    clip = lambda v, most: F.greatest(F.lit(0), F.least(v.cast("int"), (most - 1).cast("int"))).cast("double")
    return Box(clip(a.x - 1, width), clip(height - a.y2 - 1, height), clip(a.x2 + 1, width), clip(height - a.y + 1, height))


def multiply(m: tuple[Column, ...], n: tuple[Column, ...]) -> tuple[Column, ...]:
    """P-MATRIX: product of affine matrices (a, b, c, d, e, f), the first applied first."""
    a, b, c, d, e, f = m
    g, h, i, j, k, o = n
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + o)


def from_letterbox(a: Box, seen: tuple[Column, Column], page: tuple[Column, Column]) -> Box:
    """P-SCALE-BOX: a box in a padded image (height, width) back in the page's image, whose shape was kept."""
    gain = F.least(seen[0] / page[0], seen[1] / page[1])
    pad = lambda s, p: F.bround((s - p * gain) / 2 - 0.1)
    dx, dy = pad(seen[1], page[1]), pad(seen[0], page[0])
    return Box((a.x - dx) / gain, (a.y - dy) / gain, (a.x2 - dx) / gain, (a.y2 - dy) / gain)
