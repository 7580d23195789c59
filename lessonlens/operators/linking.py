"""Stable ids for people whose tracker id changes: frame-to-frame linking by overlap, distance, pose and colour."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F, types as T

from lessonlens.operators import scans
from lessonlens.session import cut_lineage


# Pairs of a track and a box that are compared at once; tracks and boxes that lie together when there are more pairs.
PAIRS, TRACKS, BOXES = 1 << 15, 24, 64
# Room for rounding where a bound of costs meets a cost.
SLACK = 1e-9


@dataclass
class LinkRules:
    # Weights of the four cost terms and the bounds that admit a link.
    max_age: float = 40
    iou_min: float = 0.05
    w_iou: float = 2.5
    w_centre: float = 1.0
    w_pose: float = 1.6
    w_colour: float = 0.7
    centre_norm: float = 500.0


@dataclass
class Vectors:
    """Vectors of several sizes as one array, with zeros behind the end of a vector; ``sizes`` has 0 for those that are missing."""

    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    values: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))

    @classmethod
    def of(cls, vectors) -> "Vectors":
        if isinstance(vectors, cls):
            return vectors
        sizes = np.array([0 if v is None else len(v) for v in vectors], np.int64)
        values = np.zeros((len(sizes), sizes.max(initial=0)))
        for size in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == size)
            values[rows, :size] = np.array([vectors[i] for i in rows], dtype=float)
        return cls(sizes, values)

    @classmethod
    def laid_out(cls, sizes, flat) -> "Vectors":
        """Vectors given by their sizes and all their values in one row."""
        sizes = np.asarray(sizes, np.int64)
        values = np.zeros((len(sizes), sizes.max(initial=0)))
        values[np.arange(values.shape[1]) < sizes[:, None]] = flat
        return cls(sizes, values)

    def lists(self) -> list[list[float]]:
        return [v[:size] for v, size in zip(self.values.tolist(), self.sizes.tolist())]

    def take(self, rows: np.ndarray) -> "Vectors":
        return Vectors(self.sizes[rows], self.values[rows])

    def followed_by(self, other: "Vectors") -> "Vectors":
        sizes = np.concatenate([self.sizes, other.sizes])
        values = np.zeros((len(sizes), sizes.max(initial=0)))
        for part, v in ((values[:len(self.sizes)], self.values), (values[len(self.sizes):], other.values)):
            width = min(v.shape[1], values.shape[1])
            part[:, :width] = v[:, :width]
        return Vectors(sizes, values)

    def of_size(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.flatnonzero(self.sizes == size)
        return rows, np.ascontiguousarray(self.values[rows, :size])


@dataclass
class OpenTracks:
    """Tracks that may still be linked, one entry per track by rising id: last box, pose and colour vector, last time."""

    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    boxes: np.ndarray = field(default_factory=lambda: np.empty((0, 4)))
    poses: Vectors = field(default_factory=Vectors)
    colours: Vectors = field(default_factory=Vectors)
    seen: np.ndarray = field(default_factory=lambda: np.empty(0))
    next_id: int = 1


def link_frame(tracks: OpenTracks, now: float, boxes: np.ndarray, poses, colours, rules: LinkRules) -> tuple[np.ndarray, OpenTracks]:
    """Ids of one frame's boxes and the tracks after it.

    Every box asks for its cheapest track, and a track goes to the cheapest box that asks for it (ties to the smaller id and
    to the earlier box); boxes left over begin new tracks.
    """
    poses, colours = Vectors.of(poses), Vectors.of(colours)
    live = np.flatnonzero(now - tracks.seen <= rules.max_age)
    ids = np.zeros(len(boxes), np.int64)
    if len(live) and len(boxes):
        wanted, price = cheapest_tracks(tracks.boxes[live], boxes, tracks.poses.take(live), poses, tracks.colours.take(live), colours, rules)
        asking = np.argsort(price, kind="stable")[:int(np.isfinite(price).sum())]
        track, first = np.unique(wanted[asking], return_index=True)
        ids[asking[first]] = tracks.ids[live[track]]
    new = np.flatnonzero(ids == 0)
    ids[new] = tracks.next_id + np.arange(len(new))
    unseen = live[~np.isin(tracks.ids[live], ids)]
    known = np.concatenate([tracks.ids[unseen], ids])
    order = np.argsort(known)
    return ids, OpenTracks(
        known[order], np.concatenate([tracks.boxes[unseen], boxes])[order], tracks.poses.take(unseen).followed_by(poses).take(order),
        tracks.colours.take(unseen).followed_by(colours).take(order),
        np.concatenate([tracks.seen[unseen], np.full(len(boxes), float(now))])[order], tracks.next_id + len(new))


def cheapest_tracks(
    a: np.ndarray, b: np.ndarray, poses_a, poses_b, colours_a, colours_b, rules: LinkRules, pairs: int = PAIRS,
) -> tuple[np.ndarray, np.ndarray]:
    """For every box (of ``b``) its cheapest track (of ``a``; the first on ties) and that cost, infinite where there is none.

    Where there are more than ``pairs`` pairs, tracks and boxes lie in groups of like ones. A group of boxes meets the groups
    of tracks by rising lower bounds of their costs and stops where no bound is below what its boxes have found, so neither
    memory nor, where likeness tells tracks apart, the work of a box grows with the crowd.
    """
    poses_a, poses_b, colours_a, colours_b = (Vectors.of(v) for v in (poses_a, poses_b, colours_a, colours_b))
    if len(a) * len(b) <= pairs:
        cost = link_costs(a, b, poses_a, poses_b, colours_a, colours_b, rules)
        return cost.argmin(axis=0), cost.min(axis=0)
    tracks, boxes = Groups.of(a, poses_a, colours_a, rules, TRACKS), Groups.of(b, poses_b, colours_b, rules, BOXES)
    wanted, price = np.zeros(len(b), np.int64), np.full(len(b), np.inf)
    if tracks.starts[-1] and boxes.starts[-1]:
        step = max(1, pairs // len(tracks.area))
        for begin in range(0, len(boxes.area), step):
            some = np.arange(begin, min(begin + step, len(boxes.area)))
            rows, own, best = _cheapest_of_groups(tracks, boxes, some, rules, pairs)
            wanted[boxes.rows[rows]], price[boxes.rows[rows]] = own, best
    return wanted, price


def _cheapest_of_groups(tracks: "Groups", boxes: "Groups", some: np.ndarray, rules: LinkRules, pairs: int):
    """For the boxes of some groups: their places, their cheapest tracks and the costs."""
    rows = np.arange(boxes.starts[some[0]], boxes.starts[some[-1] + 1])
    group = np.repeat(np.arange(len(some)), np.diff(boxes.starts)[some])
    found, best = np.zeros(len(rows), np.int64), np.full(len(rows), np.inf)
    in_groups, alone = np.ascontiguousarray(tracks.values[:, tracks.place.T]), boxes.values[:, None]
    bound = lowest_costs(tracks, np.arange(len(tracks.area))[None], boxes, some[:, None], False, rules)
    order = np.argsort(bound, axis=1)
    bound = np.take_along_axis(bound, order, axis=1)

    def meet(box: np.ndarray, with_: np.ndarray) -> None:
        """Boxes (by their place in ``rows``, rising) meet the tracks of a group each."""
        like = boxes.sizes[:, rows[box]] * (boxes.sizes[:, rows[box]] == tracks.group_sizes[:, with_])
        kind = like[0] * (boxes.sizes[1].max() + 1) + like[1]
        cost, track = np.empty(len(box)), np.empty(len(box), np.int64)
        many = max(1, pairs // tracks.members.shape[1])
        for one in np.unique(kind):
            chosen = np.flatnonzero(kind == one)
            for at in range(0, len(chosen), many):
                own = chosen[at:at + many]
                pose, colour = like[:, own[0]]
                a, *of_a = tracks.layers(in_groups, with_[own], pose, colour)
                b, *of_b = boxes.layers(alone, rows[box[own]], pose, colour)
                costs = link_costs(a, b, of_a[0], of_b[0], of_a[1], of_b[1], rules)[:, 0]
                first = costs.argmin(axis=0)
                cost[own], track[own] = costs[first, np.arange(len(own))], tracks.members[with_[own], first]
        low, who = np.full(len(rows), np.inf), np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(low, box, cost)
        same = cost == low[box]
        np.minimum.at(who, box[same], track[same])
        better = (low < best) | (low == best) & (low < np.inf) & (who < found)
        best[better], found[better] = low[better], who[better]

    at, n, left = 0, 8, np.arange(len(rows))
    while at < order.shape[1] and len(left := left[(bound[group[left], at] <= best[left]) & (bound[group[left], at] < np.inf)]):
        n = max(1, min(n, pairs // len(left)))
        # the bounds of each box itself are sharper than those of its group
        with_, low = order[group[left], at:at + n], bound[group[left], at:at + n]
        box, column = np.nonzero((low <= best[left, None]) & (low < np.inf))
        sharp = np.full(low.shape, np.inf)
        sharp[box, column] = lowest_costs(tracks, with_[box, column], boxes, rows[left[box]], True, rules)
        nearest = sharp.argmin(axis=1)
        each = np.arange(len(left))
        may = sharp[each, nearest] <= best[left]
        may &= sharp[each, nearest] < np.inf
        meet(left[may], with_[each, nearest][may])
        sharp[each, nearest] = np.inf
        box, column = np.nonzero((sharp <= best[left, None]) & (sharp < np.inf))
        if len(box):
            meet(left[box], with_[box, column])
        at, n = at + n, 2 * n
    return rows, found, best


@dataclass
class Groups:
    """Boxes in groups of like ones, whose vectors have equal sizes.

    Boxes lie in the order of the groups (``rows``), and group g begins at ``starts[g]``; ``members`` are its rows, the last one
    repeated where it has less than others. ``low`` and ``high`` enclose the ``features`` of a group (corners, centres, the
    pose's direction and the colour vector), ``area`` is its smallest one. Boxes without a corner can be linked to nothing and
    are in no group.
    """

    rows: np.ndarray
    starts: np.ndarray
    members: np.ndarray
    place: np.ndarray
    values: np.ndarray
    widths: tuple[int, int]
    sizes: np.ndarray
    group_sizes: np.ndarray
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    areas: np.ndarray
    area: np.ndarray

    @classmethod
    def of(cls, boxes: np.ndarray, poses: Vectors, colours: Vectors, rules: LinkRules, most: int) -> "Groups":
        rows = np.flatnonzero(~np.isnan(boxes).any(axis=1))
        boxes, poses, colours = boxes[rows], poses.take(rows), colours.take(rows)
        with np.errstate(all="ignore"):
            extent = np.maximum(boxes[:, 2:] - boxes[:, :2], 0.0)
            direction = poses.values / _lengths(poses.values)[:, None]
            features = np.concatenate([boxes, (boxes[:, :2] + boxes[:, 2:]) / 2, direction, colours.values], axis=1)
            odd = ~np.isfinite(features).all(axis=1)
            # how much a cost may differ by one of each
            usual = np.maximum(np.median(extent[~odd], axis=0), 1e-6) if not odd.all() else np.ones(2)
            weight = np.concatenate([np.tile(rules.w_iou / usual, 2), np.zeros(2), np.full(direction.shape[1], rules.w_pose),
                                     np.full(colours.values.shape[1], rules.w_colour / max(1, colours.values.shape[1]))])
            order, starts = _likes(features * weight, np.stack([poses.sizes, colours.sizes, odd], axis=1), most)
        # by rising row within a group, so that the first of equal costs is the first track
        order = order[np.lexsort((order, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))]
        features, areas, begin = features[order].T.copy(), extent.prod(axis=1)[order], starts[:-1]
        place = np.minimum(begin[:, None] + np.arange(np.diff(starts).max(initial=1)), starts[1:, None] - 1)
        low, high, area = (f.reduceat(x, begin, axis=-1) if len(begin) else x for f, x in (
            (np.minimum, features), (np.maximum, features), (np.minimum, areas)))
        sizes = np.stack([poses.sizes[order], colours.sizes[order]])
        values = np.concatenate([boxes, poses.values, colours.values], axis=1)[order].T.copy()
        return cls(rows[order], starts, rows[order][place], place, values, (poses.values.shape[1], colours.values.shape[1]), sizes,
                   sizes[:, begin], features, low, high, areas, area)

    def layers(self, values: np.ndarray, chosen: np.ndarray, pose: int, colour: int):
        """Boxes, poses and colour vectors of the chosen layers of ``values``; vectors of size 0 where those are not compared."""
        pose_at, colour_at = 4, 4 + self.widths[0]
        taken = [np.moveaxis(np.take(values[at:at + n], chosen, axis=-1), 0, -1) for at, n in ((0, 4), (pose_at, pose), (colour_at, colour))]
        return taken[0], *[Vectors(np.full(x.shape[:-1], x.shape[-1]), x) for x in taken[1:]]


def _likes(features: np.ndarray, kinds: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and the places where it is cut into groups of one kind and ``most`` rows at most, in which rows
    are alike.

    Round by round, all groups that are too large are cut into four at most along the feature that spreads most in them.
    """
    order = np.lexsort(kinds.T)
    kinds, features = kinds[order], features[order]
    starts = np.append(np.flatnonzero(np.append(True, (kinds[1:] != kinds[:-1]).any(axis=1))[:len(order)]), len(order))
    while len(order) and (counts := np.diff(starts)).max() > most:
        low, high = (f.reduceat(features, starts[:-1], axis=0) for f in (np.minimum, np.maximum))
        spread = np.nan_to_num(high - low, nan=0.0, posinf=0.0)
        along, group = spread.argmax(axis=1), np.repeat(np.arange(len(counts)), counts)
        chosen = np.arange(len(counts)), along
        place = (features[np.arange(len(order)), along[group]] - low[chosen][group]) / np.maximum(spread[chosen], 1e-300)[group]
        again = np.argsort(group + np.clip(np.nan_to_num(place), 0.0, 1.0) * 0.99)
        order, features = order[again], features[again]
        pieces = np.minimum(4, -(-counts // most))
        piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.append(np.repeat(starts[:-1], pieces) + np.repeat(counts, pieces) * piece // np.repeat(pieces, pieces), len(order))
    return order, starts


def lowest_costs(tracks: Groups, i: np.ndarray, boxes: Groups, j: np.ndarray, single: bool, rules: LinkRules) -> np.ndarray:
    """What a pair costs at least, infinite where none overlaps enough: of groups ``i`` of tracks and groups ``j`` of boxes, or
    ``single`` boxes by their place."""
    if min(rules.w_iou, rules.w_centre, rules.w_pose, rules.w_colour) < 0 or rules.centre_norm <= 0:
        return np.full(np.broadcast_shapes(i.shape, j.shape), -np.inf)
    low_a, high_a, area_a, sizes_a = tracks.low, tracks.high, tracks.area[i], tracks.group_sizes
    low_b, high_b, area_b, sizes_b = (boxes.features, boxes.features, boxes.areas[j], boxes.sizes) if single else (
        boxes.low, boxes.high, boxes.area[j], boxes.group_sizes)

    def gap(k: int, m: int) -> np.ndarray:
        return np.maximum(np.maximum(low_b[m][j] - high_a[k][i], low_a[k][i] - high_b[m][j]), 0.0)

    def gaps(which: int, from_a: int, from_b: int, width: int, term, size) -> np.ndarray | float:
        total = sum([term(gap(from_a + k, from_b + k)) for k in range(width)])
        like = (sizes_a[which][i] == sizes_b[which][j]) & (sizes_a[which][i] > 0)
        return np.where(like, total / size(sizes_a[which][i]), 1.0)

    with np.errstate(all="ignore"):
        shared = 1.0
        for low, high in ((0, 2), (1, 3)):
            shared = shared * np.maximum(np.minimum(high_a[high][i], high_b[high][j]) - np.maximum(low_a[low][i], low_b[low][j]), 0.0)
        iou = shared / np.maximum(np.maximum(area_a, shared) + np.maximum(area_b, shared) - shared, 1e-6)
        cost = rules.w_iou * (1 - iou) + rules.w_centre * np.hypot(gap(4, 4), gap(5, 5)) / rules.centre_norm
        width = tracks.widths, boxes.widths
        # directions a and b have 1 - a.b >= |a - b|^2 / 2, as neither is longer than 1
        cost = cost + rules.w_pose * gaps(0, 6, 6, min(width[0][0], width[1][0]), np.square, lambda size: 2)
        cost = cost + rules.w_colour * gaps(1, 6 + width[0][0], 6 + width[1][0], min(width[0][1], width[1][1]), np.abs, lambda size: np.maximum(size, 1))
        cost = np.where(np.isnan(cost), -np.inf, cost - SLACK * (1 + np.abs(cost)))
        return np.where(iou < rules.iou_min - SLACK, np.inf, cost)


def link_costs(a: np.ndarray, b: np.ndarray, poses_a, poses_b, colours_a, colours_b, rules: LinkRules) -> np.ndarray:
    """Cost of every track (row) for every box (column), infinite where they overlap too little or a corner is missing.

    Tracks and boxes may have layers behind their first axis, and then costs have; all vectors of a side have one size then.
    """
    sides = [np.maximum(np.minimum(a[:, None, ..., k + 2], b[..., k + 2]) - np.maximum(a[:, None, ..., k], b[..., k]), 0.0) for k in (0, 1)]
    shared = sides[0] * sides[1]
    area_a, area_b = (np.maximum(x[..., 2] - x[..., 0], 0.0) * np.maximum(x[..., 3] - x[..., 1], 0.0) for x in (a, b))
    iou = shared / np.maximum(area_a[:, None] + area_b - shared, 1e-6)
    centre_a, centre_b = ([(x[..., k] + x[..., k + 2]) / 2 for k in (0, 1)] for x in (a, b))
    apart = np.hypot(*[x[:, None] - y for x, y in zip(centre_a, centre_b)])
    cost = (rules.w_iou * (1 - iou) + rules.w_centre * (apart / rules.centre_norm) + rules.w_pose * vector_gaps(poses_a, poses_b, _cosine_gaps)
            + rules.w_colour * vector_gaps(colours_a, colours_b, _mean_gaps))
    return np.where((iou >= rules.iou_min) & np.isfinite(cost), cost, np.inf)


def vector_gaps(a, b, gaps) -> np.ndarray | float:
    """``gaps`` of all vectors of equal size; 1 for vectors that are missing, empty or of different size."""
    a, b = Vectors.of(a), Vectors.of(b)
    if a.sizes.ndim > 1:
        return gaps(a.values, b.values) if 0 < a.values.shape[-1] == b.values.shape[-1] else 1.0
    out = np.ones((len(a.sizes), len(b.sizes)))
    for size in np.intersect1d(a.sizes, b.sizes):
        if size:
            (rows, left), (columns, right) = a.of_size(size), b.of_size(size)
            out[np.ix_(rows, columns)] = gaps(left, right)
    return out


def _lengths(vectors: np.ndarray) -> np.ndarray:
    """Lengths of the vectors, never zero."""
    return np.sqrt(sum([np.square(vectors[..., k]) for k in range(vectors.shape[-1])], np.zeros(vectors.shape[:-1]))) + 1e-6


def _cosine_gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1.0 - _summed(a, b, np.multiply) / (_lengths(a)[:, None] * _lengths(b))


def _mean_gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _summed(a, b, lambda x, y: np.abs(x - y)) / a.shape[-1]


def _summed(a: np.ndarray, b: np.ndarray, term) -> np.ndarray:
    """The sum of ``term`` over the values of two vectors, for all pairs and in one order: like vectors get equal sums anywhere."""
    out = term(a[:, None, ..., 0], b[..., 0])
    for k in range(1, a.shape[-1]):
        out += term(a[:, None, ..., k], b[..., k])
    return out


def link_detections(dets: DataFrame, rules: LinkRules | None = None, chunk_frames: float = 5000.0) -> DataFrame:
    """Add ``stable_id`` per video.

    ``dets``: ``video_path, frame_idx, det_id, x1, y1, x2, y2`` and optional ``pose_vec`` and ``colour_vec``. Linking is a
    fold over frames. After a pause longer than ``max_age`` no track is left, so a video is cut at its pauses and the
    pieces are linked in parallel; rows stream through a piece page by page and only its open tracks are kept.
    """
    rules = rules or LinkRules()
    none = F.array().cast("array<double>")
    full = dets.withColumns({c: none for c in ("pose_vec", "colour_vec") if c not in dets.columns})
    frames = full.select("video_path", "frame_idx").distinct()
    pause = F.col("frame_idx") - F.col("prev_row.frame_idx") > F.lit(rules.max_age)
    pieces = scans.run_ids(frames, ["video_path"], ["frame_idx"], pause, ["frame_idx"], scans.time_chunk("frame_idx", chunk_frames), "piece")
    placed = full.join(pieces.select("video_path", "frame_idx", "piece"), ["video_path", "frame_idx"])
    ordered = placed.repartition("video_path", "piece").sortWithinPartitions("video_path", "piece", "frame_idx", "det_id")
    out = T.StructType([*ordered.schema.fields, T.StructField("__local", T.LongType())])

    def fold(pages):
        import pandas as pd
        tracks, piece_before, rest = OpenTracks(), None, None
        for page in chain(pages, [None]):
            whole = rest if page is None else page if rest is None else pd.concat([rest, page], ignore_index=True)
            if whole is None or whole.empty:
                continue
            spot = whole[["video_path", "piece", "frame_idx"]]
            edges = np.append(np.flatnonzero((spot != spot.shift()).any(axis=1)), len(whole))
            if page is not None:
                edges = edges[:-1]  # the last frame may go on in the next page
            boxes = whole[["x1", "y1", "x2", "y2"]].to_numpy(float)
            videos, pieces_, frames_ = (spot[c].to_numpy() for c in spot)
            poses, colours = whole["pose_vec"].tolist(), whole["colour_vec"].tolist()
            local = np.zeros(int(edges[-1]), np.int64)
            for begin, end in zip(edges[:-1], edges[1:]):
                video, piece, frame = videos[begin], pieces_[begin], frames_[begin]
                if (video, piece) != piece_before:
                    tracks, piece_before = OpenTracks(), (video, piece)
                local[begin:end], tracks = link_frame(tracks, frame, boxes[begin:end], poses[begin:end], colours[begin:end], rules)
            if len(local):
                yield whole.iloc[:len(local)].assign(__local=local)
            rest = whole.iloc[len(local):]

    # Read twice below, and the fold is the costly part.
    linked = cut_lineage(ordered.mapInPandas(fold, out))
    used = linked.groupBy("video_path", "piece").agg(F.max("__local").alias("__used"))
    before = Window.partitionBy("video_path").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = used.select("video_path", "piece", F.coalesce(F.sum("__used").over(before), F.lit(0)).alias("__offset"))
    return linked.join(offsets, ["video_path", "piece"]).withColumn(
        "stable_id", F.col("__offset") + F.col("__local")).select(*dets.columns, "stable_id")


def _ship_with_tasks() -> None:
    """Send this module's classes along with the tasks, so that workers need no copy of the package."""
    import sys
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_with_tasks()
