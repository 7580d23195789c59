"""Rounding, missing values and safe statistics as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

INF = float("inf")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and bind it, so nested lambdas do not recompute it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (c > -INF) & (c < INF), c)


def half_even(c: Column) -> Column:
    """Round half to even as a whole number (``round`` would round half away from zero)."""
    return F.rint(c).cast("int")


def score_class(c: Column) -> Column:
    """The 1..7 class of a continuous score."""
    return clamp(half_even(finite(c)), 1, 7)


def clamp(c: Column, low: float, high: float) -> Column:
    """Held between two bounds; NULL stays NULL (``least`` and ``greatest`` alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), c)))


def share(condition: Column) -> Column:
    """Aggregate: fraction of rows on which the condition holds."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: correlation, NULL for fewer than two rows or a constant column."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.try_divide(F.covar_pop(x, y), spread))


def concordance(x: Column, y: Column) -> Column:
    """Aggregate: Lin's concordance correlation coefficient."""
    gap = F.avg(x) - F.avg(y)
    return F.try_divide(2 * F.covar_pop(x, y), F.var_pop(x) + F.var_pop(y) + gap * gap)


def array_sum(values: Column, body: Callable[[Column], Column] = lambda v: v) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + body(v).cast("double"))


def drawn(key: Column, seed: int) -> Column:
    """A number from 0 to 2**60 - 1 drawn for a key: the first 15 hexadecimal digits of the MD5 of ``seed:key``, which other
    engines compute alike."""
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
