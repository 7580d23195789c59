"""Ordered operators that never put one key's whole history into one task.

A key's rows are cut into chunks that follow the order (usually a span of time). Each chunk is scanned by itself with a
window; what crosses a chunk border is read from a table with one row per key and chunk, which is built with a
map-side-combining aggregate and is as long as the timeline, not as long as the data. Keys must not be NULL.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lessonlens.session import cut_lineage

_CHUNK = "__chunk"


def time_chunk(t: str | Column, width: float) -> Column:
    c = F.col(t) if isinstance(t, str) else t
    return F.floor(c / F.lit(float(width)))


def _levels(chunk: Column | Sequence[Column]) -> dict[str, Column]:
    chunks = list(chunk) if isinstance(chunk, (list, tuple)) else [chunk]
    return {f"{_CHUNK}{i}": c for i, c in enumerate(chunks)}


def _sum_before(sums: DataFrame, keys: Sequence[str], levels: list[str]) -> DataFrame:
    """Add ``__carry`` to a table of chunk sums ``__s``: the sum over all earlier chunks of the key.

    With several levels, from coarse to fine, the earlier chunks inside the same coarse one are summed by a window over
    that coarse chunk only, and the coarse ones before it by the same rule one level up.
    """
    *outer, last = levels
    inside = Window.partitionBy(*keys, *outer).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
    own = sums.withColumn("__carry", F.coalesce(F.sum("__s").over(inside), F.lit(0)))
    if not outer:
        return own.drop("__s")
    above = _sum_before(sums.groupBy(*keys, *outer).agg(F.sum("__s").alias("__s")), keys, outer)
    joined = own.join(above.withColumnRenamed("__carry", "__above"), [*keys, *outer])
    return joined.withColumn("__carry", F.col("__carry") + F.col("__above")).drop("__above", "__s")


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, out: str,
    chunk: Column | Sequence[Column],
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the key's rows up to and including this one.

    Where a key has too many chunks for one window, ``chunk`` is a list from coarse to fine.
    """
    levels = _levels(chunk)
    d = df.withColumns({**levels, "__v": value})
    sums = d.groupBy(*keys, *levels).agg(F.sum("__v").alias("__s"))
    carried = _sum_before(sums, keys, list(levels))
    local = Window.partitionBy(*keys, *levels).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        d.withColumn("__local", F.coalesce(F.sum("__v").over(local), F.lit(0)))
        .join(carried, [*keys, *levels])
        .withColumn(out, F.col("__carry") + F.col("__local"))
        .select(*df.columns, out)
    )


def row_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str, chunk: Column | Sequence[Column],
) -> DataFrame:
    """Add ``out``: the 1-based position of the row among its key's rows."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), out, chunk)


def number_rows(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Add ``out``: the 1-based position of the row among all rows, which are dealt to tasks by ranges of ``order``.

    Spark draws the borders of the ranges from a sample of the rows, so the tasks are even whatever the values look like (long
    common beginnings of names included). The dealt rows are a written table; a window numbers each range, and only the
    sizes of the ranges, as many as there are shuffle partitions, are summed in one place.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn(out, place).join(F.broadcast(offsets), "__part").withColumn(out, F.col("__before") + F.col(out)).select(*df.columns, out)


def running_max(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, out: str, chunk: Column,
) -> DataFrame:
    """Add ``out``: the largest ``value`` among the key's earlier rows (NULL on the first)."""
    d = df.withColumn(_CHUNK, chunk).withColumn("__v", value)
    tops = d.groupBy(*keys, _CHUNK).agg(F.max("__v").alias("__m"))
    before = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = tops.select(*keys, _CHUNK, F.max("__m").over(before).alias("__carry"))
    local = Window.partitionBy(*keys, _CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        d.withColumn("__local", F.max("__v").over(local))
        .join(carried, [*keys, _CHUNK])
        .withColumn(out, F.greatest("__carry", "__local"))
        .select(*df.columns, out)
    )


def neighbours(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], chunk: Column,
) -> DataFrame:
    """Add ``prev_row`` and ``next_row``: structs of ``columns`` of the rows just before and after (NULL at the ends)."""
    d = df.withColumn(_CHUNK, chunk).withColumn("__row", F.struct(*columns))
    rank = F.struct(*order)
    edges = d.groupBy(*keys, _CHUNK).agg(
        F.min_by("__row", rank).alias("__first"), F.max_by("__row", rank).alias("__last"))
    along = Window.partitionBy(*keys).orderBy(_CHUNK)
    edges = edges.select(
        *keys, _CHUNK, F.lag("__last").over(along).alias("__from"), F.lead("__first").over(along).alias("__to"))
    local = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    return (
        d.withColumn("__lag", F.lag("__row").over(local)).withColumn("__lead", F.lead("__row").over(local))
        .join(edges, [*keys, _CHUNK])
        .withColumn("prev_row", F.coalesce("__lag", "__from"))
        .withColumn("next_row", F.coalesce("__lead", "__to"))
        .select(*df.columns, "prev_row", "next_row")
    )


def run_ids(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], starts_run: Column, columns: Sequence[str], chunk: Column,
    out: str = "run_id",
) -> DataFrame:
    """Add ``out``: number of runs begun so far; ``starts_run`` may use ``prev_row`` (NULL on the first row)."""
    near = neighbours(df, keys, order, columns, chunk)
    begun = F.when(F.col("prev_row").isNull() | starts_run, 1).otherwise(0)
    return running_total(near, keys, order, begun, out, chunk)


def fill_sides(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, chunk: Column,
) -> DataFrame:
    """Add ``before`` (last non-NULL ``value`` up to this row) and ``after`` (first one from this row on)."""
    d = df.withColumn(_CHUNK, chunk).withColumn("__v", value)
    rank = F.struct(*order)
    known = F.col("__v").isNotNull()
    edges = d.groupBy(*keys, _CHUNK).agg(
        F.min_by("__v", F.when(known, rank)).alias("__first"), F.max_by("__v", F.when(known, rank)).alias("__last"))
    along = Window.partitionBy(*keys).orderBy(_CHUNK)
    edges = edges.select(
        *keys, _CHUNK,
        F.last("__last", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("__from"),
        F.first("__first", True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("__to"))
    local = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    return (
        d.withColumn("__b", F.last("__v", True).over(local.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("__a", F.first("__v", True).over(local.rowsBetween(0, Window.unboundedFollowing)))
        .join(edges, [*keys, _CHUNK])
        .withColumn("before", F.coalesce("__b", "__from"))
        .withColumn("after", F.coalesce("__a", "__to"))
        .select(*df.columns, "before", "after")
    )


def moving_mean(
    df: DataFrame, keys: Sequence[str], index: str, value: str, out: str, radius: int, block: int = 4096,
) -> DataFrame:
    """Add ``out``: mean of ``value`` over the rows at most ``radius`` positions away inside the same key.

    Rows near a block border are copied into the neighbouring block, so each block is averaged on its own.
    """
    block = max(block, radius + 1)
    home = F.floor(F.col(index) / block)
    copies = F.sequence(F.floor((F.col(index) - radius) / block), F.floor((F.col(index) + radius) / block))
    spread = df.withColumn("__home", home).withColumn("__block", F.explode(copies))
    near = Window.partitionBy(*keys, "__block").orderBy(index).rowsBetween(-radius, radius)
    return (
        spread.withColumn(out, F.avg(value).over(near))
        .where(F.col("__home") == F.col("__block"))
        .select(*df.columns, out)
    )


def ema_block(alpha: float) -> int:
    """Rows per block such that older blocks are below double precision but the weights do not overflow."""
    if alpha >= 1.0:
        return 1 << 20
    return max(1, min(1 << 20, int(200.0 / -math.log10(1.0 - alpha))))


def exponential_average(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], values: Mapping[str, str], alpha: float, chunk: Column,
) -> DataFrame:
    """Add smoothed columns ``out: in``; the first row keeps its value, then ``(1 - alpha) * old + alpha * new``.

    A row with a NULL among its values is passed over: it keeps the average so far, NULL before the first complete row.

    The recurrence is linear, so inside a block it is a weighted running sum; a block needs only the end value of the
    block before it, because anything older carries a weight below 1e-200.
    """
    if not 0.0 < alpha <= 1.0:
        raise ValueError("alpha must be in (0, 1]")
    outs = list(values)
    known = F.lit(True)
    for source in values.values():
        known = known & F.col(source).isNotNull()
    # only complete rows advance the index; the others share that of the row before them, whose average they keep
    indexed = running_total(df, keys, order, F.when(known, 1).otherwise(0).cast("bigint"), "__i", chunk)
    size = 1 if alpha == 1.0 else ema_block(alpha)
    keep = 1.0 - alpha
    pos = F.col("__i") - 1
    d = indexed.withColumn("__b", F.floor(pos / size)).withColumn("__p", pos % size)
    weight = F.pow(F.lit(keep), -F.col("__p")) * F.when(pos == 0, 1.0).otherwise(alpha)
    decay = F.pow(F.lit(keep), F.col("__p"))
    local = Window.partitionBy(*keys, "__b").orderBy("__p").rangeBetween(Window.unboundedPreceding, 0)
    for out, source in values.items():
        d = d.withColumn(out, decay * F.sum(F.when(known, F.col(source).cast("double") * weight)).over(local))
    ends = d.groupBy(*keys, "__b").agg(F.max_by(F.struct(*outs), "__p").alias("__end"))
    carried = ends.select(*keys, (F.col("__b") + 1).alias("__b"), "__end")
    joined = d.join(carried, [*keys, "__b"], "left")
    share = F.pow(F.lit(keep), F.col("__p") + 1)
    return joined.select(
        *df.columns, *[(F.col(o) + F.coalesce(F.col("__end")[o] * share, F.lit(0.0))).alias(o) for o in outs])
