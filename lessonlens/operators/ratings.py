"""Human ratings: progress, series, consensus and the order in which raters see segments.

Ids are unique per store; ``ds`` names the columns (usually ``dataset_id``) that qualify them when many stores are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lessonlens.functions.text import blind_code
from lessonlens.operators import scans
from lessonlens.operators.joins import interval_join
from lessonlens.schemas import SCORES, UNSET_SITUATION

Keys = Sequence[str]
TOUCH = 1e-6


def centre() -> Column:
    return (F.col("t_start") + F.col("t_end")) / 2.0


def star(segments: DataFrame, windows: DataFrame, videos: DataFrame | None = None, ds: Keys = ()) -> DataFrame:
    """Segments with their window and, if given, video."""
    out = segments.join(windows, [*ds, "window_id"])
    return out if videos is None else out.join(videos, [*ds, "video_id"])


def with_frames_and_labels(segments: DataFrame, frames: DataFrame, labels: DataFrame, ds: Keys = ()) -> DataFrame:
    key = [*ds, "segment_id"]
    return segments.join(frames, key, "left_semi").join(labels, key, "left_semi")


def without_excluded(df: DataFrame, excluded: DataFrame, ds: Keys = ()) -> DataFrame:
    return df.join(excluded, [*ds, "segment_id"], "left_anti")


def without_skips(df: DataFrame, skips: DataFrame, ds: Keys = ()) -> DataFrame:
    """Drop rows whose rater skipped the window."""
    return df.join(skips, [*ds, "window_id", "rater"], "left_anti")


def labels_in_windows(labels: DataFrame, segments: DataFrame, windows: DataFrame, skips: DataFrame, ds: Keys = ()) -> DataFrame:
    """Labels with track and window columns, skipped windows left out; the base of all rater statistics."""
    placed = labels.join(segments, [*ds, "segment_id"])
    return without_skips(placed, skips, ds).join(windows, [*ds, "window_id"])


def rater_summary(labels: DataFrame, ds: Keys = ()) -> DataFrame:
    return labels.groupBy(*ds, "rater").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("score_mean"),
        F.min("score").alias("score_min"), F.max("score").alias("score_max"))


def minute_heatmap(placed: DataFrame, ds: Keys = (), columns: int = 10) -> DataFrame:
    """Ratings per minute of each rater over all minutes from the first to the last, placed on a grid."""
    key = [*ds, "rater"]
    minutes = placed.groupBy(*key, F.floor(F.col("t_start") / 60.0).cast("int").alias("minute")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("score_mean"))
    span = minutes.groupBy(*key).agg(F.min("minute").alias("lo"), F.max("minute").alias("hi"))
    dense = span.withColumn("minute", F.explode(F.sequence("lo", "hi")))
    offset = F.col("minute") - F.col("lo")
    return dense.join(minutes, [*key, "minute"], "left").select(
        *key, "minute", F.coalesce("n", F.lit(0)).alias("n"), "score_mean",
        F.floor(offset / columns).cast("int").alias("grid_row"), (offset % columns).alias("grid_col"))


def person_stats(placed: DataFrame, ds: Keys = ()) -> DataFrame:
    """Per rater and track: figures and a zero-filled histogram over the seven scores."""
    histogram = [F.count_if(F.col("score") == s).alias(f"score_{s}") for s in SCORES]
    return placed.groupBy(*ds, "rater", "track_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("score_mean"),
        F.min("score").alias("score_min"), F.max("score").alias("score_max"), *histogram)


def situation_cross(placed: DataFrame, ds: Keys = ()) -> DataFrame:
    named = F.coalesce("situation", F.lit(UNSET_SITUATION)).alias("situation")
    return placed.groupBy(*ds, "rater", named, "track_id").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score_mean"))


def consensus(labels: DataFrame, ds: Keys = ()) -> DataFrame:
    """Consensus per segment; skips and exclusions do not enter.

    The deviation comes from whole-number sums, so a limit on it does not depend on the order of the rows.
    """
    score, n = F.col("score").cast("bigint"), F.count(F.lit(1))
    return labels.groupBy(*ds, "segment_id").agg(
        F.avg("score").alias("mean_score"), n.alias("rater_count"),
        (F.sqrt(n * F.sum(score * score) - F.sum(score) * F.sum(score)) / n).alias("score_std"),
        F.min("score").alias("score_min"), F.max("score").alias("score_max"))


def chosen_scores(labels: DataFrame, raters: Sequence[str], how: str = "mean", ds: Keys = ()) -> DataFrame:
    """Mean or median over the chosen raters; a segment has at most one score from each of them."""
    figure = F.median("score") if how == "median" else F.avg("score")
    return labels.where(F.col("rater").isin(*raters)).groupBy(*ds, "segment_id").agg(figure.alias("label"))


def for_each_rater(rows: DataFrame, raters: DataFrame, ds: Keys = ()) -> DataFrame:
    """Every row once for each rater of its store. The raters of a store, a handful of people, are one list."""
    lists = raters.where(F.col("rater").isNotNull()).groupBy(*ds).agg(F.collect_set("rater").alias("__raters"))
    wide = rows.join(lists, list(ds)) if ds else rows.withColumn("__raters", lists.scalar())
    return wide.withColumn("rater", F.explode("__raters")).drop("__raters")


def rater_series(
    windows: DataFrame, segments: DataFrame, labels: DataFrame, skips: DataFrame, excluded: DataFrame,
    raters: Sequence[str] | None = None, track_id: int | None = None, ds: Keys = (),
) -> DataFrame:
    """Every window for every rater, with the mean of that rater's labels; skips and exclusions are left out."""
    chosen = labels if raters is None else labels.where(F.col("rater").isin(*raters))
    dense = for_each_rater(windows, chosen, ds)
    placed = chosen.where(F.col("score").isNotNull()).join(segments, [*ds, "segment_id"])
    if track_id is not None:
        placed = placed.where(F.col("track_id") == track_id)
    valid = without_skips(without_excluded(placed, excluded, ds), skips, ds)
    means = valid.groupBy(*ds, "window_id", "rater").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n_labeled"))
    return dense.join(means, [*ds, "window_id", "rater"], "left").select(
        *ds, "window_id", "t_start", "t_end", "rater", "score", F.coalesce("n_labeled", F.lit(0)).alias("n_labeled"))


def line_points(series: DataFrame, keys: Keys, chunk_width: float = 600.0) -> DataFrame:
    """Points at window centres in minutes, with an empty point in the middle of every time gap."""
    near = scans.neighbours(series, keys, ["t_start"], ["t_end"], scans.time_chunk("t_start", chunk_width))
    before = F.col("prev_row.t_end")
    gap = F.when(F.col("t_start") > before + TOUCH, F.struct(
        ((before + F.col("t_start")) / 120.0).alias("x"), F.lit(None).cast("double").alias("score")))
    here = F.struct(((F.col("t_start") + F.col("t_end")) / 120.0).alias("x"), F.col("score").cast("double").alias("score"))
    return near.select(*keys, F.inline(F.array_compact(F.array(gap, here))))


def smooth_series(series: DataFrame, keys: Keys, window: int, order: str = "t_start", chunk_width: float = 600.0) -> DataFrame:
    """Centred moving mean inside every unbroken run of values; missing values stay missing and are never bridged."""
    if window < 1 or window % 2 == 0:
        raise ValueError("the smoothing window must be an odd number of at least 1")
    chunk = scans.time_chunk(order, chunk_width)
    gaps = scans.running_total(series, keys, [order], F.when(F.col("score").isNull(), 1).otherwise(0), "__run", chunk)
    placed = scans.row_index(gaps, keys, [order], "__at", chunk)
    known = scans.moving_mean(placed.where(F.col("score").isNotNull()), [*keys, "__run"], "__at", "score", "smoothed", window // 2)
    missing = placed.where(F.col("score").isNull()).withColumn("smoothed", F.lit(None).cast("double"))
    return known.unionByName(missing).drop("__run", "__at")


def window_progress(
    windows: DataFrame, segments: DataFrame, labels: DataFrame, skips: DataFrame, rater: str, ds: Keys = (),
    only_unlabelled: bool = False,
) -> DataFrame:
    """Segments and labels of one rater per window; skips and exclusions only flag, they do not reduce the counts."""
    mine = labels.where(F.col("rater") == rater).select(*ds, "segment_id", "score")
    counts = segments.join(mine, [*ds, "segment_id"], "left").groupBy(*ds, "window_id").agg(
        F.count(F.lit(1)).alias("total"), F.count("score").alias("labelled"), F.avg("score").alias("score_mean"),
        F.min("score").alias("score_min"), F.max("score").alias("score_max"))
    skipped = skips.where(F.col("rater") == rater).select(*ds, "window_id", F.lit(True).alias("skipped")).distinct()
    out = windows.join(counts, [*ds, "window_id"]).join(skipped, [*ds, "window_id"], "left")
    out = out.withColumn("skipped", F.coalesce("skipped", F.lit(False)))
    return out.where(~F.col("skipped") & (F.col("labelled") < F.col("total"))) if only_unlabelled else out


def unfinished_windows(
    windows: DataFrame, segments: DataFrame, labels: DataFrame, skips: DataFrame, excluded: DataFrame, rater: str, ds: Keys = (),
) -> DataFrame:
    """Windows the rater has not skipped that hold a segment neither labelled by them nor excluded."""
    mine = labels.where(F.col("rater") == rater)
    open_segments = without_excluded(segments.join(mine, [*ds, "segment_id"], "left_anti"), excluded, ds)
    skipped = skips.where(F.col("rater") == rater)
    key = [*ds, "window_id"]
    return windows.join(skipped, key, "left_anti").join(open_segments, key, "left_semi")


def next_unfinished(
    windows: DataFrame, unfinished: DataFrame, start: float, situation: str | None = None, ds: Keys = (),
) -> DataFrame:
    """The next unfinished window from ``start`` on, one of the preferred situation before any other."""
    key = [*ds, "window_id"]
    ahead = windows.where(F.col("t_start") >= start).join(unfinished.select(*key), key, "left_semi")
    other = F.lit(0) if situation is None else F.when(F.col("situation").eqNullSafe(situation), 0).otherwise(1)
    first = F.min_by(F.struct("window_id", "t_start", "t_end", "situation"), F.struct(other, "t_start", "window_id"))
    return ahead.groupBy(*ds).agg(first.alias("w")).where(F.col("w").isNotNull()).select(*ds, "w.*")


def windows_in_clips(windows: DataFrame, clips: DataFrame, keys: Keys, width: float) -> DataFrame:
    """Each window with the clip that contains its centre."""
    return interval_join(windows.withColumn("centre", centre()), clips, keys, "centre", "clip_start", "clip_end", width)


def clip_progress(
    in_clips: DataFrame, segments: DataFrame, labels: DataFrame, skips: DataFrame, excluded: DataFrame, rater: str,
    clip: Keys, ds: Keys = (),
) -> DataFrame:
    """Progress per clip; a clip remains when it is not skipped throughout and an eligible segment lacks a label."""
    mine = labels.where(F.col("rater") == rater).select(*ds, "segment_id", "score")
    out_of_play = excluded.select(*ds, "segment_id", F.lit(True).alias("__x")).distinct()
    rows = segments.join(mine, [*ds, "segment_id"], "left").join(out_of_play, [*ds, "segment_id"], "left")
    eligible = F.col("__x").isNull()
    counts = rows.groupBy(*ds, "window_id").agg(
        F.count(F.lit(1)).alias("total"), F.count("score").alias("labelled"), F.sum("score").alias("s"),
        F.min("score").alias("score_min"), F.max("score").alias("score_max"),
        F.count_if(eligible).alias("e_total"), F.count(F.when(eligible, F.col("score"))).alias("e_labelled"))
    skipped = skips.where(F.col("rater") == rater).select(*ds, "window_id", F.lit(1).alias("__s")).distinct()
    joined = in_clips.join(counts, [*ds, "window_id"], "left").join(skipped, [*ds, "window_id"], "left")

    def total(c: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    out = joined.groupBy(*clip).agg(
        F.count(F.lit(1)).alias("n_windows"), total("total").alias("total"), total("labelled").alias("labelled"),
        F.try_divide(F.sum("s"), F.sum("labelled")).alias("score_mean"), F.min("score_min").alias("score_min"),
        F.max("score_max").alias("score_max"), (F.count("__s") == F.count(F.lit(1))).alias("skipped"),
        (total("e_labelled") < total("e_total")).alias("__open"))
    return out.withColumn("remaining", ~F.col("skipped") & F.col("__open")).drop("__open")


def clip_situations(in_clips: DataFrame, clip: Keys) -> DataFrame:
    """Situation and setter when the clip's windows agree on them, and whether all are locked."""
    def agreed(c: str) -> Column:
        return F.when((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)), F.min(c))

    out = in_clips.groupBy(*clip).agg(
        agreed("situation").alias("situation"), agreed("situation_set_by").alias("situation_set_by"),
        F.bool_and("situation_locked").alias("__locked"))
    return out.withColumn("locked", F.col("__locked") & F.col("situation").isNotNull()).drop("__locked")


def blind_assignments(
    windows: DataFrame, segments: DataFrame, raters: DataFrame, existing: DataFrame | None = None, ds: Keys = (),
) -> DataFrame:
    """Chronological display order and code per rater over the segments of locked windows.

    Raters that already have assignments (per store) keep them and get none here.
    """
    ready = windows.where(F.col("situation").isNotNull() & F.coalesce("situation_locked", F.lit(False)))
    rows = segments.join(ready, [*ds, "window_id"])
    order = ["video_id", "t_start", "t_end", "track_id", "segment_id"]
    # The order is the same for every rater, so it is computed once per store.
    chunk = [
        F.struct("video_id", scans.time_chunk("t_start", 60.0).alias("c")),
        F.struct("t_start", "t_end", F.floor(F.col("track_id") / 64).alias("c"))]
    ordered = scans.row_index(rows, ds, order, "display_order", chunk).select(*ds, "segment_id", "display_order")
    wanted = raters.select(*ds, F.trim("rater").alias("rater")).where(F.col("rater") != "")
    if existing is not None:
        wanted = wanted.join(existing, [*ds, "rater"], "left_anti")
    return for_each_rater(ordered, wanted, ds).select(
        *ds, "rater", "segment_id", blind_code(F.col("rater"), F.col("segment_id")).alias("blind_code"), "display_order")


def clip_blind_order(in_clips: DataFrame, segments: DataFrame, assignments: DataFrame, clip: Keys, ds: Keys = ()) -> DataFrame:
    placed = assignments.join(segments, [*ds, "segment_id"]).groupBy(*ds, "window_id", "rater").agg(F.min("display_order").alias("o"))
    return in_clips.join(placed, [*ds, "window_id"]).groupBy(*clip, "rater").agg(F.min("o").alias("display_order"))


def representatives(in_clips: DataFrame, segments: DataFrame, clip: Keys, ds: Keys = ()) -> DataFrame:
    """Per clip and track the segment whose window centre is nearest the clip's centre."""
    mid = (F.col("clip_start") + F.col("clip_end")) / 2.0
    rows = in_clips.join(segments, [*ds, "window_id"])
    near = F.min(F.struct(F.abs(F.col("centre") - mid).alias("distance"), "segment_id"))
    return rows.groupBy(*clip, "track_id").agg(near.alias("n")).select(*clip, "track_id", "n.segment_id", "n.distance")


def latest_events(events: DataFrame, keys: Keys, limit: int = 60) -> DataFrame:
    """The newest ``limit`` events per rater; every partition is cut to ``limit`` per rater before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("id"))
    return events.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def label_export(labels: DataFrame, segments: DataFrame, windows: DataFrame, skips: DataFrame, ds: Keys = ()) -> DataFrame:
    skipped = skips.select(*ds, "window_id", "rater", F.lit(1).alias("__s")).distinct()
    rows = star(labels.join(segments, [*ds, "segment_id"]), windows, ds=ds).join(skipped, [*ds, "window_id", "rater"], "left")
    return rows.select(
        *ds, "rater", "segment_id", "track_id", "t_start", "t_end", "score", F.coalesce("situation", F.lit("")).alias("situation"),
        F.coalesce("__s", F.lit(0)).alias("skipped_window"))
