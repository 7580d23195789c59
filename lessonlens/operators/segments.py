"""Time segments per track, the samples inside them and the frame sequences they hold."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import reduce
from itertools import chain
from operator import or_

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lessonlens.functions import boxes, pose
from lessonlens.functions.numeric import drawn
from lessonlens.operators import ranks, scans
from lessonlens.operators.joins import nearest_in_time

REFERENCE_FPS = 2.0
END_SLACK = 1e-6
# A segment with more frames than this is numbered chunk of time by chunk of time, not in one task.
MOST_FRAMES = 50_000
SIZE_BUCKETS = 1 << 16


def build_segments(
    detections: DataFrame, keys: Sequence[str], window: float = 5.0, step: float = 5.0, min_ratio: float = 0.6,
) -> DataFrame:
    """Windows ``[t_min + k*step, + window]`` of each track with enough detections; both ends count.

    A detection names the windows it falls into by arithmetic, so the counting is one combined aggregate.
    """
    keys = list(keys)
    need = max(1, int(window * REFERENCE_FPS * min_ratio))
    w, s = F.lit(float(window)), F.lit(float(step))
    bounds = detections.groupBy(*keys).agg(F.min("t").alias("__lo"), F.max("t").alias("__hi"))
    d = detections.select(*keys, "t").join(bounds, keys)
    offset = F.col("t") - F.col("__lo")
    # One candidate of slack at each side; the exact bounds are tested below.
    first = F.greatest(F.lit(0).cast("bigint"), F.ceil((offset - w) / s) - 1)
    last = F.floor(offset / s) + 1
    start = F.col("__lo") + F.col("__k") * s
    counted = (
        d.withColumn("__k", F.explode(F.sequence(first, last)))
        .withColumn("t_start", start).withColumn("t_end", start + w)
        .where((F.col("t_end") <= F.col("__hi") + F.lit(END_SLACK)) & F.col("t").between(F.col("t_start"), F.col("t_end")))
        .groupBy(*keys, "t_start", "t_end").agg(F.count(F.lit(1)).alias("n_detections"))
    )
    return counted.where(F.col("n_detections") >= need)


def materialise(segments: DataFrame, video: str = "video_path") -> tuple[DataFrame, DataFrame]:
    """Distinct windows and the (window, track) pairs; ids are hashes of the unique key, so a rerun gives the same ids."""
    window_id = F.xxhash64(video, "t_start", "t_end")
    windows = segments.select(window_id.alias("id"), video, "t_start", "t_end").dropDuplicates(["id", video, "t_start", "t_end"])
    pairs = segments.select(window_id.alias("window_id"), "track_id").dropDuplicates()
    return windows, pairs.select(F.xxhash64("window_id", "track_id").alias("id"), "window_id", "track_id")


def sample_grid(segments: DataFrame, fps: float = 2.0) -> DataFrame:
    """Sample times at the middle of each 1/fps slot of a segment, held inside the segment."""
    n = F.greatest(F.lit(1), F.floor((F.col("t_end") - F.col("t_start")) * F.lit(float(fps))).cast("int"))
    t = F.col("t_start") + (F.col("k") + F.lit(0.5)) * F.lit(1.0 / fps)
    slots = segments.withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
    return slots.withColumn("sample_t", F.least(F.greatest(t, F.col("t_start")), F.col("t_end")))


def sampled_detections(samples: DataFrame, detections: DataFrame, keys: Sequence[str]) -> DataFrame:
    payload = ["id", "frame_idx", "x1", "y1", "x2", "y2", "conf"]
    return nearest_in_time(samples, detections, keys, "sample_t", "t", payload)


def sequence_audit(segments: DataFrame, frames: DataFrame, ds: Sequence[str] = ()) -> DataFrame:
    """Per segment (of a store, where ``ds`` names its key): frames, distinct times, frames outside the half-open window and the span covered."""
    # Per distinct time first, so that repeated times combine before the shuffle on the segment.
    times = frames.groupBy(*ds, "segment_id", "t").agg(F.count(F.lit(1)).alias("__c"))
    outside = (F.col("t") < F.col("t_start")) | (F.col("t") >= F.col("t_end"))
    joined = segments.join(times, [*ds, "segment_id"], "left")
    return joined.groupBy(*ds, "segment_id", "t_start", "t_end").agg(
        F.coalesce(F.sum("__c"), F.lit(0)).alias("frames"), F.count("t").alias("distinct_t"),
        F.coalesce(F.sum(F.when(outside, F.col("__c"))), F.lit(0)).alias("outside"),
        (F.max("t") - F.min("t")).alias("span"))


def sequence_summary(audit: DataFrame, keys: Sequence[str] = (), expected: int = 10, length: float = 5.0) -> DataFrame:
    keys = list(keys)

    def n(condition: Column) -> Column:
        return F.count_if(condition)

    frames = F.col("frames")
    plain = audit.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("segments"),
        n(F.abs(F.col("t_end") - F.col("t_start") - length) > 1e-5).alias("off_length_windows"),
        n(frames == 0).alias("no_frames"), n(frames < expected).alias("fewer_frames"), n(frames == expected).alias("exact_frames"),
        n(frames > expected).alias("more_frames"), n(frames != F.col("distinct_t")).alias("duplicate_timestamps"),
        F.coalesce(F.sum("outside"), F.lit(0)).alias("frames_outside_window"),
        F.min("span").alias("span_min_sec"), F.max("span").alias("span_max_sec"))
    return ranks.with_stats(plain, audit, keys, "span", span_median_sec=ranks.median())


def by_size(frames: DataFrame, ds: Sequence[str] = (), most: int = MOST_FRAMES) -> tuple[DataFrame, DataFrame]:
    """The frames of segments with at most ``most`` frames, and those of the vast ones; frames without a segment are in neither.

    Of ``N`` frames no more than ``N / most`` segments are vast, so their list is sent around whatever the data look like. Frames
    are counted by the hash of their segment first, and by segment only where a hash has more than ``most``.
    """
    key = ["segment_id", *ds]
    hashed = frames.select(*key, F.pmod(F.xxhash64(*key), F.lit(SIZE_BUCKETS)).alias("__h"))
    crowded = hashed.groupBy("__h").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most).select("__h")
    counts = hashed.join(F.broadcast(crowded), "__h", "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    vast = F.broadcast(counts.where(F.col("__n") > most).select(*key))
    return frames.na.drop(subset=key).join(vast, key, "left_anti"), frames.join(vast, key, "left_semi")


def numbered(
    few: DataFrame, many: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
) -> tuple[DataFrame, DataFrame]:
    """Both parts of ``by_size`` with the 0-based position ``i`` in the key, by rising ``order``, and the key's row count ``n``.

    A key of the first part is one window of a sorted task; those of the second are cut into chunks. Rows without a chunk are
    counted but left out.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    short = few.withColumns({
        "n": F.count(F.lit(1)).over(whole), "i": F.row_number().over(window).cast("bigint") - 1}).where(chunk.isNotNull())
    counts = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    placed = scans.row_index(many, keys, list(order), "__i", chunk)
    return short, placed.join(counts, list(keys)).withColumn("i", F.col("__i") - 1).drop("__i")


def _frame_positions(frames, order=("t", "frame_idx"), chunk_width=1.0, ds=(), most=MOST_FRAMES):
    # The number goes first: rows are sorted by it, and a store's name is looked at where it does not decide.
    return numbered(*by_size(frames, ds, most), ["segment_id", *ds], order, scans.time_chunk("t", chunk_width))


def frame_positions(
    frames: DataFrame, order: Sequence[str] = ("t", "frame_idx"), chunk_width: float = 1.0, ds: Sequence[str] = (),
    most: int = MOST_FRAMES,
) -> DataFrame:
    """Frames with their 0-based position ``i`` in the segment and the segment's frame count ``n``."""
    short, long = _frame_positions(frames, order, chunk_width, ds, most)
    return short.unionByName(long)


def uniform_position(n: Column, wanted: int, k: Column) -> Column:
    spaced = F.rint(k * ((n - 1) / F.lit(float(max(1, wanted - 1))))).cast("int")
    return F.when(n >= wanted, spaced).otherwise(F.least(k, n.cast("int") - 1))


def uniform_positions(n: Column, wanted: int) -> Column:
    """Positions of ``wanted`` evenly spaced items out of ``n``, halves to even; short sequences repeat the last item."""
    return F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda k: uniform_position(n, wanted, k))


def contiguous_start(n: Column, wanted: int, seed: int, key: Column) -> Column:
    return (drawn(key, seed) % F.greatest(F.lit(1).cast("bigint"), n - wanted + 1)).cast("int")


def contiguous_positions(n: Column, wanted: int, seed: int, key: Column) -> Column:
    """A run of ``wanted`` positions from a start drawn for the key; short sequences repeat the last item."""
    start = contiguous_start(n, wanted, seed, key)
    return F.transform(F.sequence(F.lit(0), F.lit(wanted - 1)), lambda k: F.least(start + k, n.cast("int") - 1))


def assemble(
    frames: DataFrame, wanted: int, payload: Sequence[str], seed: int | None = None, ds: Sequence[str] = (),
    most: int = MOST_FRAMES,
) -> DataFrame:
    """One row per segment with exactly ``wanted`` frames in order.

    Frames are picked by position before any list is built, so a segment with a vast number of frames costs no more. The places
    of the list are an aggregate each, which sorted rows pass through without being kept: lists gathered per group would be sorted again.
    """
    if seed is None:
        at = [uniform_position(F.col("n"), wanted, F.lit(k)) for k in range(wanted)]
    else:
        at = [F.least(F.col("__start") + k, F.col("n").cast("int") - 1) for k in range(wanted)]
    picked = [F.col("i") == p for p in at]
    items = [F.max(F.when(hit, F.struct(F.lit(k).alias("k"), *payload))) for k, hit in enumerate(picked)]

    def gathered(placed: DataFrame) -> DataFrame:
        if seed is not None:
            placed = placed.withColumn("__start", contiguous_start(F.col("n"), wanted, seed, F.col("segment_id")))
        chosen = placed.where(reduce(or_, picked)).groupBy("segment_id", *ds).agg(
            F.max("n").alias("n_frames"), *[c.alias(f"__{k}") for k, c in enumerate(items)])
        return chosen.select(*ds, "segment_id", "n_frames", F.array_compact(F.array(*[f"__{k}" for k in range(wanted)])).alias("sequence"))

    # Each part is gathered where its segments were numbered, without another shuffle.
    short, long = _frame_positions(frames, ds=ds, most=most)
    return gathered(short).unionByName(gathered(long))


def animation_frames(
    frames: DataFrame, clips: DataFrame, fps: float = 2.0, max_frames: int = 60, ds: Sequence[str] = (),
    most: int = MOST_FRAMES,
) -> DataFrame:
    """Evenly spread crops of a clip: each path once at its earliest time, at most ``max_frames`` of them.

    ``clips`` has ``segment_id, clip_start, clip_end`` with a few rows per segment.
    """
    key = [*ds, "segment_id", "clip_start", "clip_end"]
    inside = (F.col("t") >= F.col("clip_start")) & (F.col("t") < F.col("clip_end"))
    by_number = ["segment_id", *ds, "clip_start", "clip_end"]

    def unique(part: DataFrame) -> DataFrame:
        return part.join(clips, ["segment_id", *ds]).where(inside).groupBy(*by_number, "crop_path").agg(F.min("t").alias("t"))

    few, many = by_size(frames.where(F.coalesce(F.col("crop_path"), F.lit("")) != ""), ds, most)
    short, long = numbered(unique(few), unique(many), by_number, ["t", "crop_path"], scans.time_chunk("t", 1.0))
    placed = short.unionByName(long)
    by_length = F.greatest(F.lit(1), F.rint((F.col("clip_end") - F.col("clip_start")) * F.lit(float(fps))).cast("int"))
    placed = placed.withColumn("m", F.least(F.lit(max_frames), by_length, F.col("n").cast("int")))
    hits = F.filter(
        F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda k: F.when(
            F.rint(k * (F.col("n") - 1) / (F.col("m") - 1).cast("double")).cast("bigint") == F.col("i"), k)),
        lambda k: k.isNotNull())
    single = F.when(F.col("i") == F.floor(F.col("n") / 2), F.array(F.lit(0)))
    slots = F.when(F.col("m") == 1, single).otherwise(F.when(F.col("m") > 1, hits))
    return placed.withColumn("position", F.explode(slots)).select(*key, "position", "t", "crop_path")


def overlay_boxes(
    detections: DataFrame, keys: Sequence[str], label_fps: float, sx: Column, sy: Column,
) -> DataFrame:
    """The last box of each track per label frame, scaled to another resolution, with the label's start and end."""
    fps = max(1.0, float(label_fps))
    frame = F.greatest(F.lit(0), F.rint(F.col("t") * F.lit(fps)).cast("int"))
    corners = boxes.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    last = F.max_by(boxes.scaled(corners, sx, sy), F.struct("t", "id"))
    start = F.col("label_frame") / F.lit(fps)
    return detections.groupBy(*keys, "track_id", frame.alias("label_frame")).agg(last.alias("b")).select(
        *keys, "track_id", "label_frame", "b.*", start.alias("label_start"), (start + F.lit(1.0 / fps)).alias("label_end"))


def pose_changes(frames: DataFrame, column: str = "kpts", chunk_width: float = 60.0, ds: Sequence[str] = ()) -> DataFrame:
    """Joint displacement since the previous frame of the segment, 0 unless both joints are valid.

    ``column`` holds structs ``x, y, ok``.
    """
    near = scans.neighbours(frames, [*ds, "segment_id"], ["t"], ["t", column], scans.time_chunk("t", chunk_width))
    before = F.col("prev_row")[column]
    moved = F.zip_with(column, before, lambda p, q: F.struct(
        F.when(p.ok & q.ok, p.x - q.x).otherwise(0.0).alias("dx"), F.when(p.ok & q.ok, p.y - q.y).otherwise(0.0).alias("dy")))
    still = F.transform(F.col(column), lambda _p: F.struct(F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy")))
    return near.withColumn("change", F.when(before.isNull(), still).otherwise(moved)).drop("prev_row", "next_row")


def motion_feature_rows(frames: DataFrame, chunk_width: float = 60.0, ds: Sequence[str] = ()) -> DataFrame:
    """Motion features frame by frame, for sequences too long to be assembled; ``kpts`` is replaced by ``features``."""
    clean = frames.withColumn("kpts", pose.clean_pose(F.col("kpts")))
    moved = pose_changes(clean.withColumn("__rel", pose.relative_points(F.col("kpts"))), "__rel", chunk_width, ds)
    change = F.flatten(F.transform("change", lambda c: F.array(c.dx, c.dy)))
    features = pose.frame_features(F.col("kpts"), F.col("__rel"), change)
    return moved.withColumn("features", features).drop("kpts", "__rel", "change")


def nearest_frames(frames: DataFrame, centres: DataFrame, k: int = 8, ds: Sequence[str] = ()) -> DataFrame:
    """The ``k`` frames of each segment nearest to its centre; Spark cuts each partition to ``k`` before the shuffle."""
    order = Window.partitionBy(*ds, "segment_id").orderBy("distance", "t", "frame_idx")
    near = frames.join(centres, [*ds, "segment_id"]).withColumn("distance", F.abs(F.col("t") - F.col("centre")))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("centre")


def slot_samples(log: DataFrame, keys: Sequence[str], fps: float) -> DataFrame:
    """The first row of each 1/fps slot."""
    slot = F.floor(F.col("t") * F.lit(float(fps)) + F.lit(1e-9))
    rest = F.struct("t", *[c for c in log.columns if c not in (*keys, "t")])
    return log.groupBy(*keys, slot.alias("slot")).agg(F.min(rest).alias("r")).select(*keys, "slot", "r.*")


def rate_limited(log: DataFrame, keys: Sequence[str], step: float, chunk_width: float | None = None) -> DataFrame:
    """Rows let through by a limiter that opens when at least ``step`` has passed since the last row it let through.

    Which row comes next depends on the present one alone, so a row has a pointer to its successor. A key's time is cut into
    chunks. In every chunk the pointers are followed by doubling, from each row that may be the first one let through there to
    the last one; as a row before the chunk closes the limiter for one ``step`` at most, these are few. Only these tables are
    walked in order, chunk by chunk. Then each chunk marks its rows from its own first one, again by doubling. So a burst without
    a pause is as many tasks as it has chunks. Of rows with equal times the first by ``frame_idx`` counts; rows without a time
    are left out.
    """
    keys, limit = list(keys), step - 1e-9
    width = max(step, chunk_width if chunk_width is not None else 256 * step)
    timed = log.where(F.col("t").isNotNull()).withColumn("__chunk", F.floor(F.col("t") / F.lit(float(width))))
    cell, names = [*keys, "__chunk"], log.columns

    def successors(t):
        """The first later row of each row that is due after it; the number of rows where there is none."""
        import numpy as np
        after = np.searchsorted(t, t + limit, "left")
        while True:  # t + limit is rounded: settle it by the limiter's own comparison
            early = (after > 0) & (t[np.maximum(after - 1, 0)] - t >= limit)
            late = (after < len(t)) & (t[np.minimum(after, len(t) - 1)] - t < limit)
            if not (early | late).any():
                return after
            after = after - early + late

    def last_reached(t):
        """For each row the last one that following the pointers leads to."""
        import numpy as np
        after = successors(t)
        jump = np.where(after < len(t), after, np.arange(len(t)))
        while (jump[jump] != jump).any():
            jump = jump[jump]
        return jump

    def reached_from(t, first):
        """The rows that following the pointers from one row meets, by doubling."""
        import numpy as np
        jump, reached = np.append(successors(t), len(t)), np.array([first])
        while (jump < len(t)).any():
            reached = np.unique(np.append(reached, jump[reached]))
            jump = jump[jump]
        return reached[reached < len(t)]

    def tables_of(batches):
        import numpy as np
        import pyarrow as pa
        for rows, edges in whole_groups(batches, cell):
            times, chunks, begins, ends = rows.column("t").to_numpy(), rows.column("__chunk").to_numpy(), [], []
            for low, high in zip(edges[:-1], edges[1:]):
                t = times[low:high]
                t = t[np.append(True, t[1:] > t[:-1])]
                few = min(len(t), np.searchsorted(t, chunks[low] * width + step, "right") + 1)
                begins.append(t[:few].tolist())
                ends.append(t[last_reached(t)[:few]].tolist())
            heads = rows.take(edges[:-1]).select(cell)
            yield from heads.append_column("__in", [begins]).append_column("__out", [ends]).combine_chunks().to_batches()

    ddl = [timed.schema[c] for c in cell]
    spans = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("__in", "__out")]
    times = timed.select(*cell, F.col("t").cast("double").alias("t")).repartition(*cell).sortWithinPartitions(*cell, "t")
    tables = times.mapInArrow(tables_of, T.StructType([*ddl, *spans]))

    def walk(batches):
        import numpy as np
        import pyarrow as pa
        present, last = None, None
        for batch in batches:
            firsts = []
            for *key, begins, ends in zip(*[c.to_pylist() for c in batch.columns]):
                if key[:-1] != present:
                    present, last = key[:-1], None
                at = 0 if last is None else int(np.argmax(np.append(np.asarray(begins) - last >= limit, True)))
                firsts.append(begins[at] if at < len(begins) else None)
                last = ends[at] if at < len(begins) else last
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(cell)], pa.array(firsts, pa.float64())], names=[*cell, "__first"])

    # a key's tables in order, a row per chunk; they come page by page
    walked = tables.repartition(*keys).sortWithinPartitions(*cell).mapInArrow(walk, T.StructType([*ddl, T.StructField("__first", T.DoubleType())]))
    entered = timed.join(walked.where(F.col("__first").isNotNull()).select(*[F.col(c).alias(f"__w{i}") for i, c in enumerate(cell)], "__first"),
                         [F.col(c).eqNullSafe(F.col(f"__w{i}")) for i, c in enumerate(cell)])

    def marked(batches):
        import numpy as np
        for rows, edges in whole_groups(batches, cell):
            times, firsts, kept = rows.column("t").to_numpy(), rows.column("__first").to_numpy(), []
            for low, high in zip(edges[:-1], edges[1:]):
                place = np.flatnonzero(np.append(True, times[low + 1:high] > times[low:high - 1]))
                t = times[low:high][place]
                kept.append(low + place[reached_from(t, int(np.searchsorted(t, firsts[low])))])
            yield from rows.take(np.concatenate(kept)).select(names).combine_chunks().to_batches()

    ordered = entered.select(*log.columns, "__chunk", "__first").repartition(*cell).sortWithinPartitions(*cell, "t", "frame_idx")
    return ordered.mapInArrow(marked, log.schema)


def whole_groups(batches, keys: Sequence[str]):
    """Sorted Arrow batches as tables that hold whole groups of equal ``keys``, each with the borders of its groups."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    rest = None
    for batch in chain(batches, [None]):
        parts = [x for x in (rest, None if batch is None else pa.Table.from_batches([batch])) if x is not None and x.num_rows]
        if not parts:
            continue
        rows = pa.concat_tables(parts).combine_chunks()
        changed = np.zeros(rows.num_rows - 1, bool)
        for key in keys:
            codes = pc.dictionary_encode(rows.column(key).combine_chunks()).indices.fill_null(-1).to_numpy(zero_copy_only=False)
            changed |= codes[1:] != codes[:-1]
        edges = np.concatenate([[0], np.flatnonzero(changed) + 1, [rows.num_rows]])
        if batch is not None:
            rest, edges = rows.slice(edges[-2]), edges[:-1]  # the last group may go on in the next batch
        if len(edges) > 1:
            yield rows.slice(0, edges[-1]), edges


# The functions above travel with the tasks, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
