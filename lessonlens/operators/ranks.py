"""Exact medians, quantiles, trimmed means and average ranks without gathering a group.

Equal values are merged into counts first (combined on the map side), the distinct values are cut into buckets, and a
value's rank is its rank inside its bucket plus the size of the buckets below. The borders of the buckets are quantiles of
the values themselves, sketched in a first pass, so a bucket holds about ``rows`` rows however close together the values
lie, and no task holds more than one bucket. Ranks do not depend on where the borders are. Keys must not be NULL.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lessonlens.session import cut_lineage

BUCKET_ROWS = 200_000
MOST_BUCKETS = 4096


def _borders(df: DataFrame, value: str, rows: int) -> list[float]:
    """Rising values that cut the rows into parts of about ``rows``; a few thousand numbers at most."""
    v = F.col(value).cast("double")
    known = df.where(v.isNotNull() & ~F.isnan(v))
    n = known.count()
    parts = min(MOST_BUCKETS, max(1, math.ceil(n / max(1, rows))))
    if parts == 1:
        return []
    # one more shuffle-free pass; the sketch's error is a small part of a bucket
    picked = known.agg(F.percentile_approx(v, [k / parts for k in range(1, parts)], max(10_000, 4 * parts))).first()[0]
    return sorted({x + 0.0 for x in picked if math.isfinite(x)})


def _bucket(value: Column, borders: list[float]) -> Column:
    """How many borders the value reaches, by halving; NaN is above all."""
    if not borders:
        return F.lit(0)
    table = F.from_json(F.lit(json.dumps(borders)), "array<double>")
    steps = [1 << k for k in range(len(borders).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: F.when(
        F.get(table, at + step - 1) <= value.cast("double"), at + step).otherwise(at))


def value_ranks(
    df: DataFrame, keys: Sequence[str], value: str, rows: int = BUCKET_ROWS, **extra: Column,
) -> DataFrame:
    """One row per key and distinct value: ``value``, ``cnt``, ``below`` (rows with smaller values) and ``n``.

    NULL values are left out. ``extra`` are aggregates over the rows of each distinct value. ``rows`` is how many distinct values a
    bucket should have and affects speed only. The merged values are a written table, so a job runs when this is called.
    """
    merged = cut_lineage(
        df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("value"))
        .agg(F.count(F.lit(1)).alias("cnt"), *[c.alias(name) for name, c in extra.items()]))
    counts = merged.withColumn("__bucket", _bucket(F.col("value"), _borders(merged, "value", rows)))
    sizes = counts.groupBy(*keys, "__bucket").agg(F.sum("cnt").alias("__size"))
    group = Window.partitionBy(*keys)
    lower = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "__bucket",
        F.coalesce(F.sum("__size").over(lower), F.lit(0)).alias("__offset"),
        F.sum("__size").over(group).alias("n"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.withColumn("__less", F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
        .join(offsets, [*keys, "__bucket"])
        .select(*keys, "value", "cnt", *extra, (F.col("__offset") + F.col("__less")).alias("below"), "n")
    )


def _value_at(position: Column) -> Column:
    """Aggregate over ``value_ranks``: the value at a 0-based position."""
    hit = (F.col("below") <= position) & (position < F.col("below") + F.col("cnt"))
    return F.max(F.when(hit, F.col("value")))


def quantile(p: float) -> Column:
    """Aggregate over ``value_ranks``: quantile with linear interpolation."""
    position = F.lit(float(p)) * (F.col("n") - 1)
    low, high = _value_at(F.floor(position)), _value_at(F.ceil(position))
    return low + (high - low) * F.max(position - F.floor(position))


def median() -> Column:
    return quantile(0.5)


def upper_median() -> Column:
    """Aggregate over ``value_ranks``: the element at index ``n // 2``."""
    return _value_at(F.floor(F.col("n") / 2))


def trimmed_mean(proportion: float) -> Column:
    """Aggregate over ``value_ranks``: mean after cutting ``floor(n * proportion)`` values from each end."""
    cut = F.floor(F.col("n") * F.lit(float(proportion)))
    cut = F.when(2 * cut < F.col("n"), cut).otherwise(F.lit(0))
    kept = F.greatest(
        F.lit(0), F.least(F.col("below") + F.col("cnt"), F.col("n") - cut) - F.greatest(F.col("below"), cut))
    return F.try_divide(F.sum(F.col("value") * kept), F.sum(kept))


def mean() -> Column:
    """Aggregate over ``value_ranks``."""
    return F.try_divide(F.sum(F.col("value") * F.col("cnt")), F.sum("cnt"))


def share_at_most(limit: float) -> Column:
    """Aggregate over ``value_ranks``: fraction of rows with a value of at most ``limit``."""
    return F.try_divide(F.sum(F.when(F.col("value") <= limit, F.col("cnt")).otherwise(0)).cast("double"), F.sum("cnt"))


def deviation(origin: float = 4.0, population: bool = False) -> Column:
    """Aggregate over ``value_ranks``: sample (or population) standard deviation; the sample one is NULL for one row.

    ``origin`` is a value near the mean.
    """
    off = F.col("value") - F.lit(origin)
    n, total = F.sum("cnt"), F.sum(off * F.col("cnt"))
    spread = F.greatest(F.lit(0.0), F.sum(off * off * F.col("cnt")) - total * total / n)
    return F.sqrt(F.try_divide(spread, n if population else n - 1))


def average_rank() -> Column:
    """Over ``value_ranks``: 1-based rank, ties sharing their mean."""
    return F.col("below") + (F.col("cnt") + 1) / F.lit(2.0)


def group_stats(df: DataFrame, keys: Sequence[str], value: str, rows: int = BUCKET_ROWS, **aggs: Column) -> DataFrame:
    """One row per key with the requested aggregates over ``value_ranks``."""
    ranks = value_ranks(df, keys, value, rows)
    return ranks.groupBy(*keys).agg(*[c.alias(name) for name, c in aggs.items()])


def overall_quantiles(df: DataFrame, value: str, rows: int = BUCKET_ROWS, **ps: float) -> DataFrame:
    """One row with quantiles over all rows, NULL on none.

    A first pass counts the buckets; only the rows of the few buckets that hold a wanted position are ranked, so hardly
    anything is shuffled however many rows there are.
    """
    bucket = _bucket(F.col(value), _borders(df, value, rows))
    d = df.where(F.col(value).isNotNull()).select(bucket.alias("__bucket"), F.col(value).cast("double").alias("value"))
    sizes = d.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__size"))
    whole = Window.partitionBy()
    lower = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__bucket", "__size", F.coalesce(F.sum("__size").over(lower), F.lit(0)).alias("__offset"), F.sum("__size").over(whole).alias("n"))
    at = [f(F.lit(float(p)) * (F.col("n") - 1)) for p in ps.values() for f in (F.floor, F.ceil)]
    hit = F.exists(F.array(*at), lambda i: (i >= F.col("__offset")) & (i < F.col("__offset") + F.col("__size")))
    # At most two buckets per quantile, so this side is always small enough to send around.
    wanted = F.broadcast(offsets.where(hit).select("__bucket", "__offset", "n"))
    counts = d.join(wanted, "__bucket").groupBy("__bucket", "__offset", "n", "value").agg(F.count(F.lit(1)).alias("cnt"))
    inside = Window.partitionBy("__bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    near = counts.withColumn("below", F.col("__offset") + F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
    return near.agg(*[quantile(p).alias(name) for name, p in ps.items()])


def with_stats(
    plain: DataFrame, df: DataFrame, keys: Sequence[str], value: str, rows: int = BUCKET_ROWS, **aggs: Column,
) -> DataFrame:
    """Join rank-based aggregates of ``df`` to ``plain``, which holds the ordinary aggregates per key."""
    if not keys:
        return plain.join(group_stats(df, keys, value, rows, **aggs), how="left")
    return plain.join(group_stats(df, keys, value, rows, **aggs), list(keys), "left")
