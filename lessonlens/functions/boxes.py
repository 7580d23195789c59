"""Bounding-box arithmetic; a box is a struct of ``x1 y1 x2 y2``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS = 1e-6
UPPER_BODY = 0.68
CENTRE_NORM = 500.0


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    pairs = zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2))
    return F.struct(*[c.cast("double").alias(n) for n, c in pairs])


def _extent(low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0.0), high - low)


def area(b: Column) -> Column:
    return _extent(b.x1, b.x2) * _extent(b.y1, b.y2)


def iou(a: Column, b: Column) -> Column:
    inter = _extent(F.greatest(a.x1, b.x1), F.least(a.x2, b.x2)) * _extent(F.greatest(a.y1, b.y1), F.least(a.y2, b.y2))
    return inter / F.greatest(F.lit(EPS), area(a) + area(b) - inter)


def centre_x(b: Column) -> Column:
    return (b.x1 + b.x2) * 0.5


def centre_y(b: Column) -> Column:
    return (b.y1 + b.y2) * 0.5


def centre_distance(a: Column, b: Column, norm: float = CENTRE_NORM) -> Column:
    return F.hypot(centre_x(a) - centre_x(b), centre_y(a) - centre_y(b)) / norm


def clamp_box(b: Column, width: Column, height: Column) -> Column:
    """Whole-pixel box inside the frame (coordinates cut toward zero); NULL when nothing is left of it."""
    def inside(c: Column, size: Column) -> Column:
        return F.greatest(F.lit(0), F.least(size.cast("int") - 1, c.cast("int")))

    x1, x2 = inside(b.x1, width), inside(b.x2, width)
    y1, y2 = inside(b.y1, height), inside(b.y2, height)
    fitted = F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return F.when((x2 > x1) & (y2 > y1), fitted)


def upper_body_bottom(b: Column, ratio: float = UPPER_BODY) -> Column:
    """Lower edge of the head-and-upper-body part of a whole-pixel box, at least one pixel high."""
    height = b.y2 - b.y1
    kept = F.greatest(F.lit(1), F.least(height.cast("int"), F.rint(height * ratio).cast("int")))
    return b.y1 + kept


def scaled(b: Column, sx: Column, sy: Column) -> Column:
    """Box in another resolution, rounded half-even to whole pixels."""
    return F.struct(
        F.rint(b.x1 * sx).cast("int").alias("x1"), F.rint(b.y1 * sy).cast("int").alias("y1"),
        F.rint(b.x2 * sx).cast("int").alias("x2"), F.rint(b.y2 * sy).cast("int").alias("y2"),
    )
