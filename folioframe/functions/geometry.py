"""Box operators. A box is four columns named prefix + x0, y0, x1, y1."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _b(p: str) -> list[Column]:
    return [F.col(p + c) for c in ("x0", "y0", "x1", "y1")]


def width(p: str = "") -> Column:
    return F.greatest(F.lit(0.0), F.col(p + "x1") - F.col(p + "x0"))


def height(p: str = "") -> Column:
    return F.greatest(F.lit(0.0), F.col(p + "y1") - F.col(p + "y0"))


def area(p: str = "") -> Column:
    return width(p) * height(p)


def intersection(p: str, q: str) -> Column:
    """The shared area; a box with a missing side shares none (greatest and least alone would skip it)."""
    a, b = _b(p), _b(q)
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    return F.when(reduce(add, a + b).isNotNull(), side(0) * side(1)).otherwise(0.0)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def coverage(p: str, q: str) -> Column:
    """The share of box p that lies in q."""
    return _share(intersection(p, q), area(p))


def overlap_of_smaller(p: str, q: str) -> Column:
    return _share(intersection(p, q), F.least(area(p), area(q)))


def iou(p: str, q: str) -> Column:
    both = intersection(p, q)
    return _share(both, area(p) + area(q) - both)


def center_inside(p: str, q: str) -> Column:
    a, b = _b(p), _b(q)
    return ((a[0] + a[2]) / 2).between(b[0], b[2]) & ((a[1] + a[3]) / 2).between(b[1], b[3])


def gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Distance of two intervals, 0 if they overlap."""
    return F.greatest(F.lit(0.0), b0 - a1, a0 - b1)


def distance(p: str, q: str) -> Column:
    a, b = _b(p), _b(q)
    return F.hypot(gap(a[0], a[2], b[0], b[2]), gap(a[1], a[3], b[1], b[3]))


def to_pixels(left: Column, top: Column, page_height: Column, dpi: int) -> tuple[Column, Column]:
    """Points with the origin at the bottom to pixels with the origin at the top."""
    return left * dpi / 72, (page_height - top) * dpi / 72


def corners(cx: Column, cy: Column, w: Column, h: Column, scale: tuple[float, float], offset: tuple[float, float] = (0.0, 0.0)) -> list[Column]:
    """x0, y0, x1, y1 of a box given by its centre and size as shares of an image."""
    (sx, sy), (ox, oy) = scale, offset
    return [(cx - w / 2) * sx + ox, (cy - h / 2) * sy + oy, (cx + w / 2) * sx + ox, (cy + h / 2) * sy + oy]


def padded_crop(p: str, pad: int, image: tuple[int, int]) -> list[Column]:
    """The box grown by pad to whole pixels, clamped to the image."""
    a = _b(p)
    low = [F.greatest(F.lit(0), F.floor(a[i]) - pad) for i in (0, 1)]
    high = [F.least(F.lit(image[i]), F.ceil(a[i + 2]) + pad) for i in (0, 1)]
    return [c.cast("int") for c in low + high]


def quad_order(points: Column) -> Column:
    """Top left, top right, bottom right, bottom left of an array of structs (x, y): extremes of x + y and y - x."""
    by = lambda f, last: F.get(F.transform(F.array_sort(F.transform(points, lambda q: F.struct(f(q).alias("k"), q.alias("q")))), lambda s: s["q"]), F.size(points) - 1 if last else F.lit(0))
    total, slope = (lambda q: q["x"] + q["y"]), (lambda q: q["y"] - q["x"])
    return F.array(by(total, False), by(slope, False), by(total, True), by(slope, True))


def unclip_offset(w: Column, h: Column, ratio: float) -> Column:
    """How far a rectangle's sides move out: area * ratio / perimeter."""
    return F.when(w + h > 0, w * h * ratio / (2 * (w + h))).otherwise(0.0)


def valid(p: str = "") -> Column:
    """Four finite numbers, not reversed."""
    a = _b(p)
    whole = ~(F.isnan(a[0]) | F.isnan(a[1]) | F.isnan(a[2]) | F.isnan(a[3]))
    finite = F.greatest(*[F.abs(c) for c in a]) < float("inf")
    return F.coalesce(whole & finite & (a[0] <= a[2]) & (a[1] <= a[3]), F.lit(False))
