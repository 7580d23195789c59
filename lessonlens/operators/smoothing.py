"""Exponential averages of situation probabilities and boxes along time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lessonlens.functions import probs
from lessonlens.functions.numeric import array_sum, let
from lessonlens.operators import scans
from lessonlens.schemas import SITUATIONS

FLOOR = 1e-8


def smooth_situations(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, alpha: float = 0.15, chunk_width: float = 600.0,
) -> DataFrame:
    """Add the smoothed probabilities, the situation they name and its probability.

    Normalised inputs keep a sum of 1 under the average, so each class is averaged by itself.
    """
    unit = let(F.greatest(array_sum(F.col(column)), F.lit(FLOOR)), lambda s: F.transform(column, lambda v: v / s))
    d = df.withColumn("__u", unit)
    parts = {f"__s{i}": f"__p{i}" for i in range(len(SITUATIONS))}
    d = d.withColumns({f"__p{i}": F.element_at("__u", i + 1) for i in range(len(SITUATIONS))})
    smooth = scans.exponential_average(d, keys, order, parts, alpha, scans.time_chunk(order[0], chunk_width))
    out = F.array(*[F.col(c) for c in parts])
    named = smooth.withColumn("smoothed_probs", out)
    return named.select(
        *df.columns, "smoothed_probs", probs.best_situation(F.col("smoothed_probs")).alias("smoothed_situation"),
        probs.confidence(F.col("smoothed_probs")).alias("smoothed_confidence"))


def smooth_boxes(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], alpha: float, chunk_width: float = 600.0,
) -> DataFrame:
    corners = {f"smooth_{c}": c for c in ("x1", "y1", "x2", "y2")}
    return scans.exponential_average(df, keys, order, corners, alpha, scans.time_chunk(order[0], chunk_width))
