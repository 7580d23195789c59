"""Step functions of the live path. Each keeps a small state, whose type it names, and handles one row."""

from __future__ import annotations

import math
import sys

import numpy as np
from pyspark import cloudpickle

from lessonlens.operators.linking import LinkRules, OpenTracks, Vectors, link_frame


CORNERS, VECTORS = ("x1", "y1", "x2", "y2"), ("pose_vec", "colour_vec")
DETECTION = ("det_id", *CORNERS, *VECTORS)
# A frame's detections as one array per field, its vectors as the sizes and all values in one row.
FRAME = (*DETECTION, *[f"{c}_sizes" for c in VECTORS])


def _typed(state: str, *reads: str):
    """Name the type of a step's state in DDL, and the columns that it reads besides the time."""
    def add(step):
        step.state, step.reads = state, reads
        return step

    return add


def _number(v) -> float | None:
    return None if v is None or not math.isfinite(v) else float(v)


def throttle(fps: float):
    """Let a row through when at least 1/fps has passed since the last one let through."""
    @_typed("double", "frame_idx")
    def step(last, row):
        t = row["t"]
        if last is None or t - last >= 1.0 / fps - 1e-9:
            return t, {"frame_idx": row["frame_idx"], "t": t}
        return last, None

    return step


def ring_buffer(size: int):
    """Keep the last ``size`` items; ready once they are that many."""
    @_typed("array<double>", "frame_idx", "item")
    def step(items, row):
        items = [*(items or []), row["item"]][-size:]
        return items, {"frame_idx": row["frame_idx"], "t": row["t"], "ready": len(items) >= size, "items": items}

    return step


def track_score(alpha: float = 0.3, every: float = 0.5, buffer: int = 1):
    """Score of one track as logged offline: rate-limited, smoothed, and begun anew after an exclusion.

    Emits the rows on which a prediction was due: raw and smoothed score.
    """
    @_typed("struct<n:int,smooth:double,last:double>", "frame_idx", "score", "excluded")
    def step(state, row):
        n, smooth, last = state or (0, None, None)
        t, raw = row["t"], _number(row["score"])
        if row.get("excluded"):
            return (0, None, None), None
        n = min(buffer, n + 1)
        due = n >= buffer and (last is None or t - last >= every - 1e-9)
        if not due or raw is None:
            return (n, smooth, last), None
        smooth = raw if smooth is None else (1 - alpha) * smooth + alpha * raw
        return (n, smooth, t), {"frame_idx": row["frame_idx"], "t": t, "raw_score": raw, "smooth_score": smooth}

    return step


def class_average(alpha: float = 0.2):
    """Average over the class in each frame, smoothed along time."""
    @_typed("double", "score")
    def step(old, row):
        value = _number(row["score"])
        if value is None:
            return old, None
        new = value if old is None else (1 - alpha) * old + alpha * value
        return new, {"t": row["t"], "class_score": value, "smooth_score": new}

    return step


def live_average(ttl: float = 3.0, alpha: float = 0.2):
    """Average over all tracks that are alive at a frame, scored in it or not, smoothed along time.

    A frame has the time ``t`` and its rows ``scores`` (time, track, score). A track is alive until it has had no score for
    longer than ``ttl``.
    """
    @_typed("struct<tracks:array<struct<id:bigint,seen:double,score:double>>,smooth:double>", "scores")
    def step(state, row):
        tracks, smooth = state or ([], None)
        known = {i: (seen, score) for i, seen, score in tracks}
        for t, i, score in sorted(row["scores"], key=lambda r: r[:2]):
            if _number(score) is not None:
                known[i] = (t, score)
        known = {i: v for i, v in known.items() if row["t"] - v[0] <= ttl}
        if known:
            value = sum(score for _, score in known.values()) / len(known)
            smooth = value if smooth is None else (1 - alpha) * smooth + alpha * value
        kept = [(i, seen, score) for i, (seen, score) in known.items()], smooth
        return kept, {"t": row["t"], "n_alive": len(known), "class_score": value, "smooth_score": smooth} if known else None

    return step


def situation_average(alpha: float = 0.15):
    """Evidence of all tracks of a video, normalised and smoothed."""
    @_typed("array<double>", "frame_idx", "probs")
    def step(old, row):
        raw = [float(v) for v in row["probs"]]
        total = max(1e-8, sum(raw))
        new = [v / total for v in raw]
        if old is not None:
            new = [(1 - alpha) * a + alpha * b for a, b in zip(old, new)]
            total = max(1e-8, sum(new))
            new = [v / total for v in new]
        best = max(range(len(new)), key=lambda i: (new[i], -i))
        return new, {"frame_idx": row["frame_idx"], "t": row["t"], "probs": new, "best": best, "confidence": new[best]}

    return step


def rolling_history(window: float = 60.0, spacing: float = 0.5):
    """The values of the last minute at most every half second, clamped to the scale; missing values are kept as gaps."""
    @_typed("array<struct<t:double,value:double>>", "score")
    def step(state, row):
        t, value = row["t"], _number(row["score"])
        # a clock that went back starts over; else only age removes a point
        restarted = bool(state) and state[-1][0] > t
        points = [p for p in state or [] if not restarted and p[0] >= t - window]
        if not points or t >= points[-1][0] + spacing - 1e-6:
            points.append((t, None if value is None else min(7.0, max(1.0, value))))
        known = [p[1] for p in points if p[1] is not None]
        return points, {"t": t, "n_points": len(points), "n_known": len(known), "mean": sum(known) / len(known) if known else None}

    return step


def face_vote(keep: int = 8, min_matches: int = 2, min_ratio: float = 0.5):
    """Exclusion of a track by the vote over its last observations."""
    @_typed("array<string>", "frame_idx", "matched_name")
    def step(seen, row):
        seen = [*(seen or []), row["matched_name"]][-keep:]
        names = [n for n in seen if n is not None]
        # The most frequent name; the one seen first on ties.
        best = max(dict.fromkeys(names), key=names.count, default=None)
        count = names.count(best) if best is not None else 0
        excluded = count > 0 and count >= min_matches and count / len(seen) >= min_ratio
        return seen, {"frame_idx": row["frame_idx"], "t": row["t"], "excluded": excluded, "name": best if excluded else None}

    return step


def stable_ids(rules: LinkRules | None = None):
    """Stable ids on a stream with one row per video frame.

    A fold goes ``inside``: it opens the state once, hands over frames as the arrays FRAME and closes the state at the end. The
    step itself takes a frame as its detections ``dets`` with the fields DETECTION; the two vectors may be missing.
    """
    rules = rules or LinkRules(max_age=3.0)

    def opened(state):
        if state is None:
            return OpenTracks()
        ids, boxes, poses, colours, seen, next_id = state
        return OpenTracks(np.array(ids, np.int64), np.array(boxes, float).reshape(-1, 4), Vectors.of(poses), Vectors.of(colours),
                          np.array(seen, float), next_id)

    def closed(tracks):
        return (tracks.ids.tolist(), tracks.boxes.tolist(), tracks.poses.lists(), tracks.colours.lists(), tracks.seen.tolist(),
                int(tracks.next_id))

    def advance(tracks, frame):
        det_ids = np.asarray(frame["det_id"])
        if len(det_ids) and det_ids.dtype.kind != "i":
            raise ValueError("a detection has no id")
        order = np.argsort(det_ids, kind="stable")
        boxes = np.stack([np.asarray(frame[c], float) for c in CORNERS], axis=1)[order]
        poses, colours = (Vectors.laid_out(frame[f"{c}_sizes"], frame[c]).take(order) for c in VECTORS)
        ids, tracks = link_frame(tracks, frame["t"], boxes, poses, colours, rules)
        return tracks, {"t": frame["t"], "det_ids": det_ids[order], "stable_ids": ids}

    @_typed("struct<ids:array<bigint>,boxes:array<array<double>>,poses:array<array<double>>,colours:array<array<double>>,"
            "seen:array<double>,next:bigint>", *FRAME)
    def step(state, row):
        dets = [q if isinstance(q, dict) else dict(zip(DETECTION, q)) for q in row["dets"]]
        frame = {"t": row["t"], **{c: [q[c] for q in dets] for c in ("det_id", *CORNERS)}}
        for c in VECTORS:
            vectors = [q.get(c) or [] for q in dets]
            frame |= {f"{c}_sizes": [len(v) for v in vectors], c: [float(x) for v in vectors for x in v]}
        tracks, out = advance(opened(state), frame)
        links = [{"det_id": d, "stable_id": i} for d, i in zip(out["det_ids"].tolist(), out["stable_ids"].tolist())]
        return closed(tracks), {"t": row["t"], "links": links}

    step.inside, step.arrays = (opened, advance, closed), FRAME
    return step


cloudpickle.register_pickle_by_value(sys.modules[__name__])
