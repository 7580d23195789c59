"""Rating clips: neighbouring windows joined into longer spans that never mix situations or lock states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from lessonlens.operators import scans
from lessonlens.operators.joins import interval_join
from lessonlens.session import cut_lineage

TOUCH = 1e-4
SLACK = 1e-6
CHUNK = 300.0


def _runs(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Touching windows of one context, in order of start, as one row per run.

    The first pass compresses the windows, whose number grows with the tracks; what is left grows with the number of
    context changes in a lesson only.
    """
    order = ["t_start", "t_end", "__id"]
    w = windows.select(
        *keys, "t_start", "t_end", "situation", "situation_locked", F.col("window_id").alias("__id"),
        ((F.col("t_start") + F.col("t_end")) / 2.0).alias("__centre"))
    context = F.struct("situation", "situation_locked")
    w = w.withColumn("__context", context)
    changed = ~F.col("__context").eqNullSafe(F.col("prev_row.__context"))
    chunk = scans.time_chunk("t_start", CHUNK)
    stretches = scans.run_ids(w, keys, order, changed, ["__context", "__centre"], chunk, "__stretch")
    stretches = stretches.withColumn("__prior_centre", F.col("prev_row.__centre")).drop("prev_row", "next_row")
    reach = scans.running_max(stretches, [*keys, "__stretch"], order, F.col("t_end"), "__reach", chunk)
    split = F.when(F.col("__reach").isNull() | (F.col("t_start") > F.col("__reach") + F.lit(TOUCH)), 1).otherwise(0)
    numbered = scans.running_total(reach, keys, order, split, "__run", chunk)
    first = F.struct(*order)
    return numbered.groupBy(*keys, "__run").agg(
        F.min("t_start").alias("start"), F.max("t_end").alias("end"),
        F.min_by("t_end", first).alias("first_end"), F.min_by("__centre", first).alias("first_centre"),
        F.min_by("__prior_centre", first).alias("centre_before"), F.first("__context").alias("context"))


def _bounded_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs with the borders between overlapping ones moved to the middle of the two centres next to the border.

    A border may not lie before the (moved) start of the run it closes, which is a running maximum over the borders.
    """
    along = Window.partitionBy(*keys).orderBy("__run")
    prior_end = F.lag("end").over(along)
    r = runs.withColumn("__overlaps", F.coalesce(F.col("start") <= prior_end + F.lit(TOUCH), F.lit(False)))
    middle = (F.col("centre_before") + F.col("first_centre")) / 2.0
    border = F.when(F.col("__overlaps"), F.least(middle, F.greatest(prior_end, F.col("first_end")))).otherwise(F.col("start"))
    r = r.withColumn("__border", border)
    r = r.withColumn("__chain", F.sum(F.when(F.col("__overlaps"), 0).otherwise(1)).over(along))
    chain = Window.partitionBy(*keys, "__chain").orderBy("__run").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("run_start", F.max("__border").over(chain))
    closes = F.lead("__overlaps").over(along) & F.lit(True)
    return r.withColumn("run_end", F.when(F.coalesce(closes, F.lit(False)), F.lead("run_start").over(along)).otherwise(F.col("end")))


def rating_clips(windows: DataFrame, keys: Sequence[str], max_seconds: float) -> DataFrame:
    """Clips ``clip_start, clip_end`` of at most ``max_seconds`` that each hold the centre of a window.

    ``windows``: ``window_id, t_start, t_end, situation, situation_locked``. A piece without a centre joins the clip
    it touches on the left. Without a maximum the windows themselves are the clips.
    """
    keys = list(keys)
    if max_seconds <= 0:
        return windows.select(*keys, F.col("t_start").alias("clip_start"), F.col("t_end").alias("clip_end"))
    marker = keys or ["__one"]
    source = windows if keys else windows.withColumn("__one", F.lit(1))
    length = F.lit(float(max_seconds))
    # Few rows from here on, read by several steps.
    runs = _bounded_runs(cut_lineage(_runs(source, marker)), marker).where(F.col("run_end") - F.col("run_start") > F.lit(SLACK))
    pieces = F.greatest(F.lit(1).cast("bigint"), F.ceil((F.col("run_end") - F.lit(SLACK) - F.col("run_start")) / length))
    cut = runs.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)))
    begin = F.col("run_start") + F.col("__k") * length
    cut = cut.select(
        *marker, "__run", "__k", begin.alias("clip_start"), F.least(begin + length, F.col("run_end")).alias("clip_end"))
    centres = source.select(*marker, ((F.col("t_start") + F.col("t_end")) / 2.0).alias("__centre")).distinct()
    filled = interval_join(centres, cut, marker, "__centre", "clip_start", "clip_end", max_seconds)
    filled = filled.select(*marker, "__run", "__k", F.lit(True).alias("__full")).distinct()
    # From here on one row per clip: as many as the lesson is long.
    along = Window.partitionBy(*marker).orderBy("__run", "__k")
    c = cut.join(filled, [*marker, "__run", "__k"], "left").withColumn("__full", F.coalesce("__full", F.lit(False)))
    apart = F.coalesce(F.abs(F.lag("clip_end").over(along) - F.col("clip_start")) >= F.lit(TOUCH), F.lit(True))
    c = c.withColumn("__opens", F.col("__full") | apart)
    c = c.withColumn("__group", F.sum(F.when(F.col("__opens"), 1).otherwise(0)).over(along))
    merged = c.groupBy(*marker, "__group").agg(
        F.min("clip_start").alias("clip_start"), F.max("clip_end").alias("clip_end"), F.bool_or("__full").alias("__full"))
    return merged.where("__full").select(*keys, "clip_start", "clip_end")
