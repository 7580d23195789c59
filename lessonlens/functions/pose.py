"""Pose arithmetic on ``array<struct<x,y,conf>>`` (17 keypoints) and sequences of such arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lessonlens.functions.numeric import array_sum, clamp, finite, let

VISIBLE = 0.2
EPS = 1e-6
MIN_WIDTH = 1e-4
MIN_MATCH_POINTS = 4
# left/right partner of each of the 17 keypoints.
MIRROR = (0, 2, 1, 4, 3, 6, 5, 8, 7, 10, 9, 12, 11, 14, 13, 16, 15)
LEFT_SHOULDER, RIGHT_SHOULDER = 5, 6
# The nine bones whose directions describe torso, arms and head.
BONES = ((5, 6), (5, 11), (6, 12), (5, 7), (7, 9), (6, 8), (8, 10), (5, 0), (6, 0))


def point(x: Column, y: Column, conf: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), conf.cast("double").alias("conf"))


def joint(pose: Column, index: int) -> Column:
    return F.element_at(pose, index + 1)


def pad_points(rows: Column, k: int = 17) -> Column:
    """``[[x, y, conf], ...]`` cut or zero-padded to ``k`` points; NULL gives all zeros."""
    rows = F.coalesce(rows, F.array().cast("array<array<double>>"))
    return F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda i: let(F.get(rows, i), lambda p: point(*[F.coalesce(F.get(p, F.lit(d)), F.lit(0.0)) for d in range(3)])),
    )


def _mean_centre(points: Column) -> Column:
    n = F.size(points).cast("double")
    return F.struct(
        (array_sum(points, lambda p: p.x) / n).alias("mx"),
        (array_sum(points, lambda p: p.y) / n).alias("my"),
    )


def _square_radius(points: Column, m: Column) -> Column:
    return array_sum(points, lambda p: (p.x - m.mx) * (p.x - m.mx) + (p.y - m.my) * (p.y - m.my)) / F.size(points)


def normalise_pose(pose: Column, visible: float = VISIBLE) -> Column:
    """Centre on the visible points and divide by their RMS radius; with none visible x and y are 0."""
    def scale(vis: Column) -> Column:
        moved = let(_mean_centre(vis), lambda m: let(
            F.sqrt(F.greatest(_square_radius(vis, m), F.lit(EPS))),
            lambda s: F.transform(pose, lambda p: point((p.x - m.mx) / s, (p.y - m.my) / s, p.conf)),
        ))
        hidden = F.transform(pose, lambda p: point(F.lit(0.0), F.lit(0.0), p.conf))
        return F.when(F.size(vis) > 0, moved).otherwise(hidden)

    return let(F.filter(pose, lambda p: p.conf >= visible), scale)


def mirror_pose(pose: Column) -> Column:
    """Left and right joints swapped and x negated."""
    order = F.array(*[F.lit(i + 1) for i in MIRROR])
    return F.transform(order, lambda i: let(F.element_at(pose, i), lambda p: point(-p.x, p.y, p.conf)))


def to_frame(pose: Column, pose_w: Column, pose_h: Column, crop_w: Column, crop_h: Column, x0: Column, y0: Column) -> Column:
    """Keypoints of a resized crop in frame coordinates; unchanged when a size is not positive."""
    valid = (F.least(pose_w, pose_h, crop_w, crop_h) > 0)
    sx = F.try_divide(crop_w.cast("double"), pose_w.cast("double"))
    sy = F.try_divide(crop_h.cast("double"), pose_h.cast("double"))
    return F.when(valid, F.transform(pose, lambda p: point(p.x * sx + x0, p.y * sy + y0, p.conf))).otherwise(pose)


def match_vector(pose: Column, visible: float = VISIBLE) -> Column:
    """Flat, centred and scaled coordinates for comparing two poses; empty when there are too few points."""
    empty = F.array().cast("array<double>")

    def build(points: Column) -> Column:
        flat = let(_mean_centre(points), lambda m: let(
            F.sqrt(_square_radius(points, m)) + EPS,
            lambda s: F.flatten(F.transform(points, lambda p: F.array((p.x - m.mx) / s, (p.y - m.my) / s))),
        ))
        return F.when(F.size(points) < MIN_MATCH_POINTS, empty).otherwise(flat)

    seen = F.filter(pose, lambda p: p.conf >= visible)
    chosen = F.when(F.size(seen) >= MIN_MATCH_POINTS, seen).otherwise(pose)
    return F.when(pose.isNull(), empty).otherwise(let(chosen, build))


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda u, v: u.cast("double") * v.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _comparable(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(a) == F.size(b))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 when the vectors are empty or of unequal length."""
    return F.when(_comparable(a, b), 1.0 - dot(a, b) / ((norm(a) + EPS) * (norm(b) + EPS))).otherwise(1.0)


def mean_l1(a: Column, b: Column) -> Column:
    total = array_sum(F.zip_with(a, b, lambda u, v: F.abs(u.cast("double") - v.cast("double"))))
    return F.when(_comparable(a, b), F.try_divide(total, F.size(a))).otherwise(1.0)


def unit_vector(v: Column) -> Column:
    """L2-normalised copy; vectors shorter than 1e-6 stay as they are."""
    return let(norm(v), lambda n: F.when(n > 1e-6, F.transform(v, lambda x: x / n)).otherwise(v))


def relative_points(pose: Column) -> Column:
    """Shoulder-centred coordinates in shoulder widths, with a validity flag per joint."""
    left, right = joint(pose, LEFT_SHOULDER), joint(pose, RIGHT_SHOULDER)
    frame = F.struct(
        ((left.x + right.x) / 2).alias("cx"), ((left.y + right.y) / 2).alias("cy"),
        F.hypot(left.x - right.x, left.y - right.y).alias("w"),
        ((left.conf >= VISIBLE) & (right.conf >= VISIBLE)).alias("both"),
    )

    def one(f: Column, p: Column) -> Column:
        ok = f.both & (p.conf >= VISIBLE) & (f.w > MIN_WIDTH)
        scale = F.greatest(f.w, F.lit(MIN_WIDTH))
        return F.struct(
            F.when(ok, clamp((p.x - f.cx) / scale, -5.0, 5.0)).otherwise(0.0).alias("x"),
            F.when(ok, clamp((p.y - f.cy) / scale, -5.0, 5.0)).otherwise(0.0).alias("y"),
            ok.alias("ok"),
        )

    return let(frame, lambda f: F.transform(pose, lambda p: one(f, p)))


def _bone(pose: Column, a: int, b: int) -> Column:
    start, end = joint(pose, a), joint(pose, b)
    dx, dy = end.x - start.x, end.y - start.y
    length = F.greatest(F.hypot(dx, dy), F.lit(MIN_WIDTH))
    shown = (start.conf >= VISIBLE) & (end.conf >= VISIBLE)
    return F.array(F.when(shown, dx / length).otherwise(0.0), F.when(shown, dy / length).otherwise(0.0))


def _flat_xy(points: Column) -> Column:
    return F.flatten(F.transform(points, lambda p: F.array(p.x, p.y)))


def frame_features(clean: Column, relative: Column, change: Column) -> Column:
    """The 103 numbers of one frame from its cleaned points, their relative places and the flat list of changes."""
    return F.concat(
        _flat_xy(relative), change, F.transform(clean, lambda p: p.conf), *[_bone(clean, a, b) for a, b in BONES])


def clean_pose(pose: Column) -> Column:
    zero = F.lit(0.0)
    return F.transform(pose, lambda p: point(
        F.coalesce(finite(p.x), zero), F.coalesce(finite(p.y), zero), clamp(F.coalesce(finite(p.conf), zero), 0.0, 1.0)))


def motion_features(sequence: Column) -> Column:
    """One 103-number vector per frame: relative points, change since the frame before, confidences, bone directions."""
    def per_frame(clean: Column, relative: Column, i: Column) -> Column:
        now = F.element_at(relative, i + 1)
        before = F.get(relative, i - 1)
        change = F.when(i > 0, F.flatten(F.zip_with(now, before, lambda p, q: F.array(
            F.when(p.ok & q.ok, p.x - q.x).otherwise(0.0), F.when(p.ok & q.ok, p.y - q.y).otherwise(0.0)))))
        still = F.array_repeat(F.lit(0.0), 34)
        return frame_features(F.element_at(clean, i + 1), now, F.coalesce(change, still))

    return let(F.transform(sequence, clean_pose), lambda clean: let(
        F.transform(clean, relative_points), lambda relative: F.transform(
            F.sequence(F.lit(0), F.size(clean) - 1), lambda i: per_frame(clean, relative, i))))
