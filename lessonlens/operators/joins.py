"""Joins Spark has no operator for: interval, nearest in time, substring."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lessonlens.operators import scans

FILTER_BLOCKS = 32


def interval_join(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: float,
    how: str = "inner",
) -> DataFrame:
    """Pair each point with the intervals ``[start, end)`` that contain it.

    Both sides get a time bucket as an equality key (an interval one per bucket it touches), so the plan is a hash or
    sort-merge join on key and bucket rather than a nested loop, and a busy key is spread over its buckets.
    """
    bucket = F.floor(F.col(at) / F.lit(float(width)))
    touched = F.sequence(F.floor(F.col(start) / F.lit(float(width))), F.floor(F.col(end) / F.lit(float(width))))
    left = points.withColumn("__bucket", bucket)
    right = intervals.where(F.col(end) > F.col(start)).withColumn("__rb", F.explode(touched))
    right = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], "__rb",
                         *[c for c in intervals.columns if c not in keys])
    same = F.col("__bucket") == F.col("__rb")
    for k in keys:
        same = same & (F.col(k) == F.col(f"__r_{k}"))
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    return left.join(right, same & inside, how).drop("__bucket", "__rb", *[f"__r_{k}" for k in keys])


def nearest_in_time(
    samples: DataFrame, detections: DataFrame, keys: Sequence[str], sample_t: str, det_t: str, payload: Sequence[str],
    chunk_width: float = 300.0,
) -> DataFrame:
    """Give each sample the detection of its key whose time is nearest, as struct ``hit``; samples without any drop out.

    On equal distance the earlier detection wins, then the smaller first payload column. Samples and detections are
    unioned and filled forward and backward along time, so the work is linear and no pairs are formed.
    """
    keys = list(keys)
    pay = F.struct(F.col(det_t).alias("t"), *payload)
    known = detections.groupBy(*keys, F.col(det_t).alias("__t")).agg(F.min(pay).alias("__d"))
    none = F.lit(None)
    carry = F.struct(*[c for c in samples.columns if c not in keys])
    points = samples.select(*keys, F.col(sample_t).alias("__t"), F.lit(1).alias("__kind"), carry.alias("__s"))
    both = known.select(*keys, "__t", F.lit(0).alias("__kind"), none.cast(points.schema["__s"].dataType).alias("__s"), "__d") \
        .unionByName(points.withColumn("__d", none.cast(known.schema["__d"].dataType)))
    filled = scans.fill_sides(both, keys, ["__t", "__kind"], F.col("__d"), scans.time_chunk("__t", chunk_width))
    back, ahead = F.col("__t") - F.col("before.t"), F.col("after.t") - F.col("__t")
    hit = F.when(F.col("after").isNull() | (back <= ahead), F.col("before")).otherwise(F.col("after"))
    return (
        filled.where("__kind = 1").withColumn("hit", F.when(F.col("before").isNull(), F.col("after")).otherwise(hit))
        .where(F.col("hit").isNotNull()).select(*keys, "__s.*", "hit")
    )


def text_matches(
    names: DataFrame, name: str, filters: DataFrame, needle: str, test: Callable[[Column, Column], Column],
) -> DataFrame:
    """Pair each row of ``names`` with the filter rows whose text passes ``test(name, needle)``; an empty text fits all.

    The filters lie in ``FILTER_BLOCKS`` lists by their hash, and every name meets every list by its number: an equality
    join at any size, in which Spark sends the lists around while they are small. No pair is formed that does not match.
    """
    def fits(text: Column) -> Column:
        return (F.coalesce(text, F.lit("")) == "") | test(F.col(name), F.coalesce(text, F.lit("")))

    block = F.pmod(F.xxhash64(*filters.columns), F.lit(FILTER_BLOCKS)).cast("int")
    lists = filters.groupBy(block.alias("__block")).agg(F.collect_list(F.struct(*filters.columns)).alias("__filters"))
    met = names.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(FILTER_BLOCKS - 1)))).join(lists, "__block")
    hits = F.filter("__filters", lambda row: fits(row[needle]))
    return met.select(*names.columns, F.explode(hits).alias("__f")).select(*names.columns, "__f.*")


def substring_matches(names: DataFrame, name: str, filters: DataFrame, needle: str) -> DataFrame:
    return text_matches(names, name, filters, needle, lambda text, part: F.contains(text, part))
