"""Merging the stores of several raters into one set of labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lessonlens.operators.quality import require_empty

WINDOW_KEY = ["fps", "width", "height", "frame_count", "t_start", "t_end"]
SEGMENT_KEY = [*WINDOW_KEY, "track_id"]
DEFAULT_REASON = "adult"


def _whole(c: str) -> Column:
    return F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c)


def _micro(c: str) -> Column:
    return F.bround(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 6).alias(c)


def window_keys(windows: DataFrame, videos: DataFrame) -> DataFrame:
    """Natural key of each window with its situation: what must be equal in every rater's copy."""
    joined = windows.join(videos, "video_id")
    return joined.select(
        _micro("fps"), _whole("width"), _whole("height"), _whole("frame_count"), _micro("t_start"), _micro("t_end"),
        "window_id", "situation", "situation_locked")


def segment_keys(segments: DataFrame, windows: DataFrame, videos: DataFrame) -> DataFrame:
    return window_keys(windows, videos).join(segments, "window_id").select(*SEGMENT_KEY, "segment_id")


def remap(source: DataFrame, base: DataFrame) -> DataFrame:
    """Segment ids of one store beside the ids the same segments have in another."""
    return source.select(*SEGMENT_KEY, F.col("segment_id").alias("source_segment")).join(
        base.select(*SEGMENT_KEY, F.col("segment_id").alias("segment_id")), SEGMENT_KEY).select("source_segment", "segment_id")


def topology_differences(source: DataFrame, base: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows present on one side only; empty when both stores describe the same windows or segments."""
    sides = source.select(*columns, F.lit(1).alias("__side")).unionByName(base.select(*columns, F.lit(2).alias("__side")))
    # one bit per side, so a side of a group is one number; no row is sorted or repeated
    found = sides.groupBy(*columns).agg(F.bit_or("__side").alias("__side")).where(F.col("__side") != 3)
    return found.select(*columns, F.when(F.col("__side") == 1, "source").otherwise("base").alias("side"))


def new_sources(sources: DataFrame, imported: DataFrame) -> DataFrame:
    """Sources not imported before, each content once (the first in order)."""
    first = sources.groupBy("source_sha256").agg(F.min_by(F.struct("source_order", "source_name"), "source_order").alias("s"))
    return first.join(imported, "source_sha256", "left_anti").select("source_sha256", "s.*")


def judge_labels(labels: DataFrame) -> DataFrame:
    """One row per segment and rater over all stores: the first label, how many repeat it, and whether scores conflict.

    ``labels``: ``source_order`` (the base store lowest), ``id``, ``segment_id``, ``rater``, ``score``.
    """
    rater = F.trim("rater").alias("rater")
    first = F.min_by(F.struct("source_order", "score"), F.struct("source_order", "id"))
    return labels.groupBy("segment_id", rater).agg(
        first.alias("f"), (F.count(F.lit(1)) - 1).alias("duplicates"), (F.min("score") != F.max("score")).alias("conflict"),
    ).select("segment_id", "rater", "f.score", "f.source_order", "duplicates", "conflict")


def merge_labels(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted labels and conflicts; a caller stops on conflicts before it writes anything."""
    judged = judge_labels(labels)
    return judged.where(~F.col("conflict")).drop("conflict"), judged.where("conflict").select("segment_id", "rater")


def checked_merge(labels: DataFrame) -> DataFrame:
    """Accepted labels; raises on blank raters or conflicting scores."""
    require_empty(labels.where(F.coalesce(F.trim("rater"), F.lit("")) == ""), "blank rater name")
    accepted, conflicts = merge_labels(labels)
    require_empty(conflicts, "conflicting labels")
    return accepted


def merge_exclusions(exclusions: DataFrame) -> DataFrame:
    """The last source decides; an exclusion without a reason gets the default one."""
    reason = F.coalesce(F.nullif(F.col("reason"), F.lit("")), F.lit(DEFAULT_REASON))
    last = F.max_by(F.struct(reason.alias("reason"), "excluded_by"), "source_order")
    return exclusions.groupBy("segment_id").agg(last.alias("l")).select("segment_id", "l.*")


def merge_observations(observations: DataFrame) -> DataFrame:
    """The last source decides; clip columns a source does not have become NULL."""
    columns = ["source_clip_start", "source_clip_end", "source_clip_sec", "updated_at"]
    have = set(observations.columns)
    filled = observations.withColumns({
        c: F.lit(None).cast("timestamp_ntz" if c == "updated_at" else "double") for c in columns if c not in have})
    last = F.max_by(F.struct(*columns), "source_order")
    return filled.groupBy("segment_id", "rater").agg(last.alias("l")).select("segment_id", "rater", "l.*")


def provenance(accepted: DataFrame) -> DataFrame:
    """Imported labels and the sorted rater list of each source."""
    counts = accepted.groupBy("source_order", "rater").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("source_order").agg(
        F.sum("n").alias("label_count"), F.array_join(F.sort_array(F.collect_set("rater")), ",").alias("raters"))


def normalise_legacy(segments: DataFrame, skips: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flat segments (video, times, situation, track) split into windows and segments, and skips moved to window ids.

    Window ids are hashes of the natural key. Skips carry no video in the old layout and then apply to every window
    with the same times, which repeats them over videos; when they do carry one they stay with it.
    """
    key = ["video_id", "t_start", "t_end"]
    windows = segments.groupBy(*key).agg(F.max("situation").alias("situation"))
    windows = windows.withColumn("window_id", F.xxhash64(*key))
    placed = segments.join(windows.drop("situation"), key).select("segment_id", "window_id", "track_id")
    on = key if "video_id" in skips.columns else key[1:]
    moved = skips.join(windows.select(*key, "window_id").drop(*[k for k in key if k not in on]), on)
    return windows, placed, moved.select("rater", "window_id").distinct() if on == key else moved.select("rater", "window_id")
