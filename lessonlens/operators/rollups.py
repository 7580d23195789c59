"""Roll-ups of a prediction log: overall, per track, per second and per time bin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from lessonlens.operators import ranks, scans
from lessonlens.session import cut_lineage

LOW_SCORE = 3.0


def overall_stats(log: DataFrame) -> DataFrame:
    """One row over everything; on an empty log the counts are 0 and the rest NULL."""
    plain = log.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("track_id").alias("n_tracks"),
        F.min("t").alias("t_min"), F.max("t").alias("t_max"),
        F.avg("score").alias("score_mean"), F.stddev_pop("score").alias("score_std"),
        F.avg("score_clamped").alias("clamped_mean"))
    quantiles = ranks.overall_quantiles(log, "score", score_p10=0.1, score_p50=0.5, score_p90=0.9)
    return plain.join(quantiles, how="left")


def by_track(log: DataFrame, min_samples: int = 30) -> DataFrame:
    keys = ["situation", "track_id"]
    log = log.where(F.col("situation").isNotNull())
    plain = log.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.avg("score_clamped").alias("clamped_mean"))
    out = ranks.with_stats(
        plain, log, keys, "score", score_mean=ranks.mean(), score_std=ranks.deviation(), score_p50=ranks.median())
    return out.where(F.col("n") >= min_samples).withColumn("duration_sec", F.col("t_max") - F.col("t_min"))


def per_track_means(log: DataFrame, keys: Sequence[str], **means: str) -> DataFrame:
    """First level of every class figure: each track counts once per cell, however often it was sampled."""
    return log.groupBy(*keys, "track_id").agg(*[F.avg(c).alias(a) for a, c in means.items()])


def timeseries_per_sec(log: DataFrame) -> DataFrame:
    keys = ["situation", "sec"]
    log = log.where(F.col("situation").isNotNull()).withColumn("sec", F.floor("t").cast("int"))
    tracks = cut_lineage(per_track_means(log, keys, score="score", clamped="score_clamped"))
    plain = tracks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tracks"), F.avg("clamped").alias("clamped_mean"))
    return ranks.with_stats(plain, tracks, keys, "score", score_mean=ranks.mean(), score_p50=ranks.median())


def timeseries_binned(log: DataFrame, bin_sec: float = 5.0, trim: float = 0.1) -> DataFrame:
    """Class figures per situation and bin.

    The track means, far fewer than the log's rows, are a written table: the rank table reads them twice, the log is read
    once. Tracks without a score count, only the figures of scores leave them out.
    """
    keys = ["situation", "bin"]
    log = log.where(F.col("situation").isNotNull()).withColumn("bin", F.floor(F.col("t") / F.lit(float(bin_sec))).cast("int"))
    tracks = cut_lineage(per_track_means(
        log, keys, score="score", clamped="score_clamped", situation_confidence="situation_confidence"))
    plain = tracks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_tracks"), F.avg(F.when(F.col("score") <= LOW_SCORE, 1.0).otherwise(0.0)).alias("low_score_ratio"),
        F.avg("situation_confidence").alias("situation_confidence"), F.avg("clamped").alias("clamped_mean"))
    out = ranks.with_stats(
        plain, tracks, keys, "score", score_mean=ranks.mean(), score_trimmed_mean=ranks.trimmed_mean(trim),
        score_p50=ranks.median(), score_std=ranks.deviation())
    width = F.lit(float(bin_sec))
    return out.select(
        "situation", (F.col("bin") * width).alias("bin_start"), ((F.col("bin") + 1) * width).alias("bin_end"),
        "n_tracks", "score_mean", "score_trimmed_mean", "score_p50", "score_std", "low_score_ratio",
        "situation_confidence", "clamped_mean")


def trimmed_means(df: DataFrame, keys: Sequence[str], value: str, proportion: float) -> DataFrame:
    return ranks.group_stats(df, keys, value, trimmed_mean=ranks.trimmed_mean(proportion), n=F.max("n"))


def situation_spans(rows: DataFrame, keys: Sequence[str], x: str = "x", chunk_width: float = 600.0) -> DataFrame:
    """Runs of equal situation along ``x``; a span ends where the next begins, the last one a typical step later."""
    keys = list(keys)
    chunk = scans.time_chunk(x, chunk_width)
    changed = ~F.col("situation").eqNullSafe(F.col("prev_row.situation"))
    runs = scans.run_ids(rows.select(*keys, x, "situation"), keys, [x], changed, [x, "situation"], chunk)
    spans = runs.groupBy(*keys, "run_id").agg(
        F.min(x).alias("span_start"), F.first("situation").alias("situation"),
        F.max_by(F.col("next_row")[x], x).alias("next_start"), F.max(x).alias("last_x"))
    gaps = runs.where(F.col(x) > F.col("prev_row")[x]).select(*keys, (F.col(x) - F.col("prev_row")[x]).alias("gap"))
    step = ranks.group_stats(gaps, keys, "gap", dt=ranks.upper_median())
    joined = spans.join(step, keys, "left") if keys else spans.join(step, how="left")
    end = F.coalesce("next_start", F.col("last_x") + F.coalesce(F.col("dt"), F.lit(1.0)))
    return joined.select(*keys, "span_start", end.alias("span_end"), "situation")


def nice_ticks(df: DataFrame, keys: Sequence[str], value: str, count: int = 7) -> DataFrame:
    """Axis ticks at 1-2-5 steps over the value range of each key."""
    span = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    raw = (F.col("hi") - F.col("lo")) / max(1, count - 1)
    scaled = span.withColumn("__raw", raw).withColumn("__ten", F.pow(F.lit(10.0), F.floor(F.log10("__raw"))))
    base = F.col("__raw") / F.col("__ten")
    step = F.when(base <= 1, 1.0).when(base <= 2, 2.0).when(base <= 5, 5.0).otherwise(10.0) * F.col("__ten")
    stepped = scaled.withColumn("step", step).withColumn("__first", F.floor(F.col("lo") / F.col("step")))
    # Past the upper end by at most half a step.
    count_up = F.sequence(F.lit(0), F.floor((F.col("hi") + F.col("step") * 0.5) / F.col("step") - F.col("__first")).cast("int"))
    ticks = F.transform(count_up, lambda i: F.round((F.col("__first") + i) * F.col("step"), 6))
    ticks = F.filter(ticks, lambda v: v >= F.col("lo") - F.col("step") * 0.5)
    return stepped.select(*keys, F.when(F.col("hi") <= F.col("lo"), F.array("lo")).otherwise(ticks).alias("ticks"))
