"""The slim extract handed to raters: no tracks, no poses, crops under unique names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lessonlens.functions.text import CROPS, base_name

# Fixed value: where the proxy video lies in the extract.
PROXY_VIDEO = "videos/proxy.mp4"


def packaged_names(frames: DataFrame, path: str, frame_id: str, ds: Sequence[str] = ()) -> DataFrame:
    """A file name per source file (of a store). The file that shows up first keeps its name; another one whose name is equal but for
    case gets the id of its first frame in front."""
    files = frames.where(F.col(path).isNotNull()).groupBy(*ds, path).agg(F.min(frame_id).alias("__first"))
    files = files.withColumn("__name", base_name(F.col(path))).withColumn("__folded", F.lower("__name"))
    owners = files.groupBy(*ds, "__folded").agg(F.min(F.struct("__first", path)).alias("__owner"))
    prefixed = F.concat(F.lit("sf"), F.col("__first").cast("string"), F.lit("_"), F.col("__name"))
    named = F.when(F.col("__owner")[path] == F.col(path), F.col("__name")).otherwise(prefixed)
    return files.join(owners, [*ds, "__folded"]).select(*ds, path, named.alias("packaged"))


def labelling_extract(
    videos: DataFrame, windows: DataFrame, segments: DataFrame, frames: DataFrame, ds: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """The four tables of the extract, with the video path rewritten and the pose paths blanked."""
    names = packaged_names(frames, "crop_path", "id", ds)
    crops = frames.join(names, [*ds, "crop_path"], "left").withColumns({
        "crop_path": F.concat(F.lit(CROPS), F.col("packaged")), "pose_path": F.lit(None).cast("string")}).drop("packaged")
    return {
        "videos": videos.withColumn("path", F.lit(PROXY_VIDEO)), "windows": windows, "segments": segments, "segment_frames": crops}
