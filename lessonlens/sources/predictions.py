"""Readers and filters for the prediction logs."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from lessonlens.functions.numeric import finite
from lessonlens.schemas import require_columns

AB = "AB"


def _or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def matches_regex(column: Column, pattern: str | None) -> Column:
    """Regular expression found anywhere in the text; NULL text does not match."""
    return F.lit(True) if not pattern else F.coalesce(column.rlike(pattern), F.lit(False))


def contains_text(column: Column, text: str | None) -> Column:
    """Literal, case-sensitive substring; NULL text does not match."""
    return F.lit(True) if not text else F.coalesce(column.contains(text), F.lit(False))


def like_text(column: Column, text: Column) -> Column:
    """LIKE ``%text%`` without regard to ASCII case; ``%`` and ``_`` stay wildcards, a backslash is a character like others.

    A NULL or empty filter matches all. The escape character that Spark asks for is doubled, so it stands for itself.
    """
    plain = lambda c: F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    pattern = F.concat(F.lit("%"), F.replace(plain(text), F.lit("!"), F.lit("!!")), F.lit("%"))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(True)).otherwise(F.like(plain(column), pattern, F.lit("!")))


def in_interval(t: Column, start: Column | float, end: Column | float) -> Column:
    return (t >= start) & (t < end)


def read_predictions(log: DataFrame, video_filter: str | None = None) -> DataFrame:
    """Offline log with overrides laid over situations; ``video_filter`` is a regular expression. NaN becomes NULL."""
    require_columns(log, {"video_path", "t", "track_id", "situation", "score", "score_clamped"}, "predictions")
    situation = F.col("situation")
    if "situation_override" in log.columns:
        situation = F.coalesce(F.col("situation_override"), situation)
    boxes = [c for c in ("det_conf", "x1", "y1", "x2", "y2", "frame_idx") if c in log.columns]
    return log.where(matches_regex(F.col("video_path"), video_filter)).select(
        "video_path", F.col("t").cast("double").alias("t"), F.col("track_id").cast("bigint").alias("track_id"),
        situation.alias("situation"), finite(_or_null(log, "situation_confidence", "double")).alias("situation_confidence"),
        finite(F.col("score")).alias("score"), F.col("score_clamped").cast("int").alias("score_clamped"), *boxes)


def read_predictions_ab(log: DataFrame, video_filter: str | None = None) -> DataFrame:
    """Live or offline log with the base situation kept and ``is_ab`` flagging the intervention rows."""
    have = set(log.columns)

    def first_of(*names: str) -> str | None:
        return next((n for n in names if n in have), None)

    score, video = first_of("score", "yhat"), first_of("video_path", "video_id")
    missing = sorted({"t", "track_id", "situation"} - have)
    if missing or score is None or video is None:
        raise ValueError(f"predictions: missing columns {missing}")
    clamped = first_of("score_clamped", "score_int") or score
    out = log.select(
        F.col(video).cast("string").alias("video_path"), finite(F.col("t")).alias("t"),
        F.col("track_id").cast("bigint").alias("track_id"), finite(F.col(score)).alias("score"),
        finite(F.col(clamped)).alias("score_clamped"), F.col("situation").cast("string").alias("base_situation"),
        F.coalesce(_or_null(log, "situation_override", "string") == AB, F.lit(False)).alias("is_ab"),
        finite(_or_null(log, "situation_confidence", "double")).alias("situation_confidence"))
    return out.where(contains_text(F.col("video_path"), video_filter)).na.drop(subset=["t", "track_id", "score"])
