"""The live path as streaming queries: throttling, track scores, class figures, votes, linking and time bins.

Streams have ``t`` (seconds since the lesson began) and ``at`` (the instant; see ``lesson_clock``).
"""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Sequence
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lessonlens.operators.rollups import LOW_SCORE
from lessonlens.session import keyed_state, scratch_path
from lessonlens.streaming import steps
from lessonlens.streaming.folds import LATE_DELAY, LESSON_TTL, fold_stream

TRACK = ("video_path", "track_id")
TRACK_TTL = 3.0
_TRACK_DDL = "video_path string, track_id bigint"


def lesson_clock(stream: DataFrame, start: Column) -> DataFrame:
    """Add ``at``: the instant the lesson began, ``start``, plus the seconds ``t``."""
    return stream.withColumn("at", F.timestamp_micros(F.unix_micros(start) + F.round(F.col("t") * 1e6).cast("bigint")))


def throttled(stream: DataFrame, fps: float, keys: Sequence[str] = TRACK, ttl: float = LESSON_TTL) -> DataFrame:
    return fold_stream(stream, keys, steps.throttle(fps), f"{_TRACK_DDL}, frame_idx bigint, t double", ("t", "frame_idx"), ttl)


def buffered(stream: DataFrame, size: int, ttl: float = TRACK_TTL) -> DataFrame:
    """Ring buffer of column ``item`` per track; tracks unseen for ``ttl`` seconds begin with an empty one."""
    ddl = f"{_TRACK_DDL}, frame_idx bigint, t double, ready boolean, items array<double>"
    return fold_stream(stream, TRACK, steps.ring_buffer(size), ddl, ("t", "frame_idx"), ttl)


def track_scores(
    stream: DataFrame, alpha: float = 0.3, every: float = 0.5, buffer: int = 1, ttl: float = TRACK_TTL, delay: str = LATE_DELAY,
) -> DataFrame:
    """Log rows of the live path; append them to a table with the checkpointed file sink."""
    ddl = f"{_TRACK_DDL}, frame_idx bigint, t double, at timestamp, raw_score double, smooth_score double"
    return fold_stream(stream, TRACK, steps.track_score(alpha, every, buffer), ddl, ("t", "frame_idx"), ttl, delay)


def class_scores(scores: DataFrame, frame_sec: float = 0.5, alpha: float = 0.2, ttl: float = LESSON_TTL) -> DataFrame:
    """Mean of the smoothed scores that ``track_scores`` found within a frame span, then smoothed per lesson.

    The mean is combined before the shuffle, so the last step sees one row per lesson and frame span. ``t`` is that of the
    span's first row.
    """
    spans = (
        scores.groupBy("video_path", F.window("at", f"{round(frame_sec * 1000)} milliseconds").alias("w"))
        .agg(F.avg("smooth_score").alias("score"), F.min("t").alias("t")))
    spans = spans.select("video_path", F.window_time("w").alias("at"), "t", "score")
    ddl = "video_path string, t double, class_score double, smooth_score double"
    return fold_stream(spans, ["video_path"], steps.class_average(alpha), ddl, ttl=ttl, delay=None)


def live_class_scores(scores: DataFrame, frame_sec: float = 0.5, alpha: float = 0.2, track_ttl: float = TRACK_TTL, ttl: float = LESSON_TTL) -> DataFrame:
    """The class figure on the screen: after each frame span with a score, the mean over all tracks still alive, then smoothed.

    ``scores`` are those of ``track_scores``; ``t`` is that of the span's last row, and a track lives for ``track_ttl`` after its
    last score.
    """
    frames = scores.groupBy("video_path", F.window("at", f"{round(frame_sec * 1000)} milliseconds").alias("w")).agg(
        F.collect_list(F.struct("t", "track_id", F.col("smooth_score").alias("score"))).alias("scores"), F.max("t").alias("t"))
    frames = frames.select("video_path", F.window_time("w").alias("at"), "t", "scores")
    ddl = "video_path string, t double, n_alive int, class_score double, smooth_score double"
    return fold_stream(frames, ["video_path"], steps.live_average(track_ttl, alpha), ddl, ttl=ttl, delay=None)


def situations(stream: DataFrame, alpha: float = 0.15) -> DataFrame:
    ddl = "video_path string, frame_idx bigint, t double, probs array<double>, best int, confidence double"
    return fold_stream(stream, ["video_path"], steps.situation_average(alpha), ddl, ("t", "frame_idx"))


def history(stream: DataFrame, window: float = 60.0, spacing: float = 0.5) -> DataFrame:
    ddl = "video_path string, t double, n_points int, n_known int, mean double"
    return fold_stream(stream, ["video_path"], steps.rolling_history(window, spacing), ddl, ("t", "frame_idx") if "frame_idx" in stream.columns else ("t",))


def rolling_mean(stream: DataFrame, window: str = "60 seconds", slide: str = "0.5 seconds", delay: str = LATE_DELAY) -> DataFrame:
    """The last minute's mean with built-in sliding windows."""
    return (
        stream.withWatermark("at", delay)
        .groupBy("video_path", F.window("at", window, slide).alias("w")).agg(F.avg("score").alias("score"))
        .select("video_path", F.col("w.end").alias("window_end"), "score"))


def exclusions(stream: DataFrame, keep: int = 8, min_matches: int = 2, min_ratio: float = 0.5, ttl: float = TRACK_TTL) -> DataFrame:
    ddl = f"{_TRACK_DDL}, frame_idx bigint, t double, excluded boolean, name string"
    return fold_stream(stream, TRACK, steps.face_vote(keep, min_matches, min_ratio), ddl, ("t", "frame_idx"), ttl)


def stable_ids(stream: DataFrame, max_age: float = 3.0, delay: str | None = LATE_DELAY) -> DataFrame:
    """One row per video frame with its detections ``dets`` (id, box corners and, where there are any, ``pose_vec`` and
    ``colour_vec``); gives each a stable id."""
    found = {f.name for f in stream.schema["dets"].dataType.elementType.fields}
    none = F.array().cast("array<double>")
    frame = {c: F.col("dets")[c].cast(f"array<{'bigint' if c == 'det_id' else 'double'}>") for c in ("det_id", *steps.CORNERS)}
    for c in steps.VECTORS:
        vectors = F.transform(F.col("dets")[c].cast("array<array<double>>"), lambda v: F.coalesce(v, none)) if c in found else F.transform("dets", lambda q: none)
        frame |= {f"{c}_sizes": F.transform(vectors, F.size), c: F.flatten(vectors)}
    ddl = "video_path string, t double, det_ids array<bigint>, stable_ids array<bigint>"
    linked = fold_stream(stream.withColumns(frame).drop("dets"), ["video_path"], steps.stable_ids(steps.LinkRules(max_age=max_age)), ddl, delay=delay)
    return linked.select("video_path", "t", F.inline(F.arrays_zip(F.col("det_ids").alias("det_id"), F.col("stable_ids").alias("stable_id"))))


def frames_of(boxes: DataFrame, span: str, delay: str = LATE_DELAY) -> DataFrame:
    """Detections that come one by one, gathered into frames: all of a lesson within a span of time, which is as long as a frame.

    ``boxes`` has the columns of a detection, ``video_path``, ``t`` and ``at``. ``t`` is that of the frame's first row.
    """
    fields = [c for c in steps.DETECTION if c in boxes.columns]
    frames = boxes.withWatermark("at", delay).groupBy("video_path", F.window("at", span).alias("w")).agg(
        F.collect_list(F.struct(*fields)).alias("dets"), F.min("t").alias("t"))
    return frames.select("video_path", F.window_time("w").alias("at"), "t", "dets")


def _value_at(position: Column) -> Column:
    """Of the sorted counts ``v``: the value at a 0-based position, NULL if there is none."""
    start = F.struct(F.lit(0).cast("bigint").alias("below"), F.lit(None).cast("double").alias("found"))
    return F.aggregate("v", start, lambda a, x: F.struct(
        (a.below + x.c).alias("below"), F.when((a.below <= position) & (position < a.below + x.c), x.score).otherwise(a.found).alias("found")), lambda a: a.found)


def _kept_mean(cut: Column) -> Column:
    """Of the sorted counts ``v`` of ``n`` values: the mean without ``cut`` values at each end."""
    cut = F.when(2 * cut < F.col("n"), cut).otherwise(F.lit(0))
    start = F.struct(F.lit(0).cast("bigint").alias("below"), F.lit(0.0).alias("s"))
    kept = lambda a, x: F.greatest(F.lit(0), F.least(a.below + x.c, F.col("n") - cut) - F.greatest(a.below, cut))
    total = F.aggregate("v", start, lambda a, x: F.struct((a.below + x.c).alias("below"), (a.s + x.score * kept(a, x)).alias("s")), lambda a: a.s)
    return F.when(F.col("n") > 0, total / (F.col("n") - 2 * cut))


def binned_scores(
    stream: DataFrame, span: str, keys: Sequence[str] = ("situation",), delay: str = LATE_DELAY, trim: float = 0.1,
) -> DataFrame:
    """Streaming counterpart of the binned class figures: mean per track, then over tracks, in tumbling windows.

    Tracks without a known score count as tracks but not in the figures.
    """
    tracks = (
        stream.withWatermark("at", delay).groupBy(F.window("at", span).alias("w"), *keys, "video_path", "track_id")
        .agg(F.avg("score").alias("score"), F.avg("score_clamped").alias("clamped"), F.avg("situation_confidence").alias("confidence")))
    # equal scores are counted before they meet, so what a class holds when its bin closes is its distinct scores
    values = tracks.groupBy("w", *keys, "score").agg(
        F.count(F.lit(1)).alias("c"), F.sum("clamped").alias("clamped"), F.count("clamped").alias("n_clamped"),
        F.sum("confidence").alias("confidence"), F.count("confidence").alias("n_confidence"))
    known, low = F.col("score").isNotNull(), F.col("score") <= LOW_SCORE
    classes = values.groupBy("w", *keys).agg(
        F.sum("c").alias("n_tracks"), F.array_sort(F.collect_list(F.when(known, F.struct("score", "c")))).alias("v"),
        (F.sum(F.when(low, F.col("c")).otherwise(0)) / F.sum("c")).alias("low_score_ratio"),
        F.try_divide(F.sum("confidence"), F.sum("n_confidence")).alias("situation_confidence"),
        F.try_divide(F.sum("clamped"), F.sum("n_clamped")).alias("clamped_mean"))
    classes = classes.withColumn("n", F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x.c)).withColumns({
        "score_mean": _kept_mean(F.lit(0)), "score_trimmed_mean": _kept_mean(F.floor(F.col("n") * F.lit(trim))),
        "score_p50": (_value_at(F.floor((F.col("n") - 1) / 2)) + _value_at(F.floor(F.col("n") / 2))) / 2})
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.c * (x.score - F.col("score_mean")) * (x.score - F.col("score_mean")))
    classes = classes.withColumn("score_std", F.when(F.col("n") > 1, F.sqrt(square / (F.col("n") - 1)))).drop("v", "n")
    figures = [c for c in classes.columns if c not in ("w", *keys)]
    return classes.select(*keys, F.col("w.start").alias("bin_start"), F.col("w.end").alias("bin_end"), *figures)


def flagged_sessions(stream: DataFrame, gap: str, keys: Sequence[str] = ("video_path",), delay: str = LATE_DELAY) -> DataFrame:
    """Intervals of flagged rows that pause for less than ``gap``."""
    return (
        stream.where("is_ab").withWatermark("at", delay).groupBy(F.session_window("at", gap).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"))


class LateRows:
    """Counts the rows a running query leaves out because their instant is behind the watermark, over all its batches."""

    def __init__(self, running):
        self.running, self.by_batch = running, {}

    def count(self) -> int:
        """Rows left out so far; call it now and then, as Spark keeps the reports of recent batches only."""
        for p in self.running.recentProgress:
            # a batch without rows reports under the number of the next one
            self.by_batch[p.batchId, p.timestamp] = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)
        return sum(self.by_batch.values())

    def to_the_end(self, every: float = 2.0) -> int:
        """Wait until the query ends, and count."""
        while not self.running.awaitTermination(every):
            self.count()
        return self.count()


    def while_running(self, work: Callable[[], None], every: float = 2.0) -> int:
        """Count beside ``work``, which waits for the query."""
        done = threading.Event()

        def look() -> None:
            while not done.wait(every):
                self.count()

        looking = threading.Thread(target=look, daemon=True)
        looking.start()
        try:
            work()
        finally:
            done.set()
            looking.join()
        return self.count()


def _writer(stream: DataFrame, base: str):
    return (stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/rows")
            .option("checkpointLocation", f"{base}/progress"))


def _start(writer, spark: SparkSession, keyed: bool):
    with keyed_state(spark) if keyed else nullcontext():
        return writer.start()


def _report(late: int) -> None:
    if late:
        logging.getLogger(__name__).warning("%d late rows were left out", late)


def drain(stream: DataFrame, name: str, keyed: bool = True) -> DataFrame:
    """Run a stream over all that is there now, into a table in the shared folder, and read the table back.

    ``keyed`` is for streams with a step fold; built-in windows run on the session's own state store. Windows and rows that
    the watermark has not passed are not in the table; ``drain_closed`` has them too.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    _report(LateRows(_start(_writer(stream, base).trigger(availableNow=True), spark, keyed)).to_the_end())
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def drain_closed(source: DataFrame, build: Callable[[DataFrame], DataFrame], name: str, keyed: bool = True, **mark: Column) -> DataFrame:
    """``drain`` of ``build(source)`` with its last rows and windows: once the source is read, a closing mark moves the watermark.

    The mark is a row of NULLs at the end of all time, in a window of its own that never closes. ``mark`` names values it
    needs to get past the filters of ``build``. Rows that come after it are late.
    """
    spark: SparkSession = source.sparkSession
    base = scratch_path(spark, name)
    marks = f"{base}/marks"
    end = {"at": F.lit("9999-01-01 00:00:00").cast("timestamp"), **mark}
    row = spark.range(1).select(*[end.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in source.schema.fields])
    row.limit(0).write.parquet(marks)
    stream = build(source.unionByName(spark.readStream.schema(source.schema).parquet(marks)))
    running = _start(_writer(stream, base), spark, keyed)

    def close() -> None:
        running.processAllAvailable()
        row.write.mode("append").parquet(marks)
        running.processAllAvailable()  # returns when no batch is left to run, those that only move the watermark included

    try:
        _report(LateRows(running).while_running(close))
    finally:
        running.stop()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Append scored rows to a table as they come, one folder per video; exactly once across restarts."""
    writer = (
        stream.writeStream.format("parquet").outputMode("append").partitionBy("video_path").option("path", path)
        .option("checkpointLocation", checkpoint))
    with keyed_state(stream.sparkSession):
        return writer.start()
