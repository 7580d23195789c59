"""Bootstrap by resampling units with replacement, spread over the cluster.

Every replicate draws exactly as many units as its group has. The units are ordered by a hash, and the draws are divided over
them by a binary tree of hash prefixes: at every node a binomial draw, made from the node's own seed, says how many of the
node's draws go to its left half. So any part of the tree can be drawn by itself: a task that holds the units below one
prefix repeats the few draws on the way down to it, in logarithmic time, and then works on its own subtree. Small cells at
the bottom, whose size depends on the group alone, are drawn unit by unit. Replicates therefore do not depend on how the
tree is cut into tasks. No pairs of replicate and unit are ever shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lessonlens.functions.numeric import drawn
from lessonlens.session import cut_lineage

CHUNK_UNITS = 100_000
CELL_UNITS = 256
BLOCK_REPLICATES = 2500
HASH_BITS = 60


def _levels(n: Column, units: int) -> Column:
    """How often n units are halved until a part has about ``units``."""
    return F.greatest(F.lit(0), F.ceil(F.log2(n / F.lit(float(units))))).cast("int")


class Tree:
    """Draws of one block of replicates for the units below a prefix, given in the order of their hashes."""

    def __init__(self, hashes, values, seed: int, block: int, bits: int):
        self.hashes, self.values, self.seed, self.block, self.bits = hashes, values, seed, block, bits

    def rng(self, depth: int, prefix: int):
        import numpy as np
        return np.random.default_rng([self.seed, self.block, depth, int(prefix)])

    def left(self, m, depth: int, prefix: int, size: int, left_size: int):
        """How many of the m draws of a node go to its left half."""
        return self.rng(depth, prefix).binomial(m, left_size / size)

    def totals(self, m, depth: int, prefix: int, low: int, high: int):
        """Sums of the values over the m draws of each replicate from the units low..high."""
        import numpy as np
        if low == high or not m.any():
            return np.zeros((len(m), self.values.shape[1]))
        if depth == self.bits or high - low == 1:
            if high - low == 1:
                return m[:, None] * self.values[low]
            picks = self.values[low + self.rng(HASH_BITS + depth, prefix).integers(0, high - low, int(m.sum()))]
            sums = np.zeros((len(picks) + 1, picks.shape[1]))
            np.cumsum(picks, axis=0, out=sums[1:])
            ends = np.cumsum(m)
            return sums[ends] - sums[ends - m]
        half = (2 * prefix + 1) << (HASH_BITS - depth - 1)
        middle = low + int(np.searchsorted(self.hashes[low:high], half))
        mine = self.left(m, depth, prefix, high - low, middle - low)
        return self.totals(mine, depth + 1, 2 * prefix, low, middle) + self.totals(m - mine, depth + 1, 2 * prefix + 1, middle, high)


def resample_totals(
    units: DataFrame, keys: Sequence[str], unit: Sequence[str], values: Sequence[str], iterations: int, seed: int,
    chunk_units: int = CHUNK_UNITS,
) -> DataFrame:
    """Per key and replicate: ``draws`` and the sums of ``values`` over the drawn units. Values must not be NULL."""
    keys, values = list(keys) or ["__all"], list(values)
    d = units if keys != ["__all"] else units.withColumn("__all", F.lit(0))
    name = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in unit])
    d = d.select(*keys, drawn(name, seed).alias("__h"), *[F.col(v).cast("double").alias(v) for v in values])
    # The units are totals of classes, schools or events; they are read by every step below.
    d = cut_lineage(d)
    counts = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    d = d.join(counts, keys).withColumn("__depth", _levels(F.col("__n"), chunk_units))
    d = d.withColumn("__c", F.expr(f"shiftright(__h, {HASH_BITS} - __depth)"))
    # sizes of all nodes above the chunks; a chunk gets those on its way from the root and of their left halves
    chunks = d.groupBy(*keys, "__n", "__depth", "__c").agg(F.count(F.lit(1)).alias("__size"))
    above = F.transform(F.sequence(F.lit(0), F.col("__depth")), lambda j: F.struct(j.alias("j"), F.call_function("shiftright", F.col("__c"), F.col("__depth") - j).alias("node")))
    nodes = cut_lineage(chunks.select(*keys, "__size", F.explode(above).alias("p")).groupBy(*keys, "p.j", "p.node").agg(F.sum("__size").alias("__size")))
    way = chunks.select(*keys, "__n", "__depth", "__c", F.explode(above).alias("p")).where("p.j < __depth").select(*keys, "__n", "__depth", "__c", "p.*")
    lefts = nodes.select(*keys, (F.col("j") - 1).alias("j"), F.expr("node DIV 2").alias("node"), F.col("__size").alias("__left")).where(nodes.node % 2 == 0)
    sized = way.join(nodes, [*keys, "j", "node"]).join(lefts, [*keys, "j", "node"], "left")
    step = F.struct("j", "node", "__size", F.coalesce("__left", F.lit(0)).alias("__left"))
    plan = sized.groupBy(*keys, "__c").agg(F.array_sort(F.collect_list(step)).alias("__way"))
    plan = chunks.select(*keys, "__c", "__n", "__depth").join(plan, [*keys, "__c"], "left")
    n_blocks = max(1, -(-iterations // BLOCK_REPLICATES))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    cell = [*keys, "__c", "__block"]
    # The plan reaches every cell once, as its own row, and not with each unit.
    flat = [F.coalesce(F.col(f"__way.{c}"), F.array().cast("array<bigint>")).cast("array<bigint>").alias(c) for c in ("node", "__size", "__left")]
    plans = plan.select(*keys, "__c", "__n", "__depth", *flat).withColumn("__block", blocks).withColumnsRenamed({c: f"__p_{c}" for c in cell})
    spread = d.drop("__n", "__depth").withColumn("__block", blocks)

    out = T.StructType([d.schema[k] for k in keys])
    out = out.add("replicate", T.IntegerType()).add("draws", T.LongType())
    for v in values:
        out = out.add(v, T.DoubleType())

    def draw(key, units_, plan_):
        import numpy as np
        import pandas as pd
        chunk, block = int(key[-2]), int(key[-1])
        units_ = units_.sort_values(["__h", *values], kind="mergesort")
        n, depth = int(plan_["__n"].iloc[0]), int(plan_["__depth"].iloc[0])
        bits = max(0, int(np.ceil(np.log2(n / CELL_UNITS))))
        data = units_[values].to_numpy(dtype=float)
        tree = Tree(units_["__h"].to_numpy(), data, seed, block, max(bits, depth))
        reps = np.arange(block, iterations, n_blocks, dtype=np.int32)
        m = np.full(len(reps), n, np.int64)
        for j, (node, size, left) in enumerate(zip(*[plan_[c].iloc[0] for c in ("node", "__size", "__left")])):
            mine = tree.left(m, j, node, size, left)
            m = mine if (chunk >> (depth - j - 1)) % 2 == 0 else m - mine
        frame = pd.DataFrame(tree.totals(m, depth, chunk, 0, len(data)), columns=values)
        frame.insert(0, "draws", m)
        frame.insert(0, "replicate", reps)
        for k, v in reversed(list(zip(keys, key))):
            frame.insert(0, k, v)
        return frame

    partial = spread.groupBy(*cell).cogroup(plans.groupBy(*[f"__p_{c}" for c in cell])).applyInPandas(draw, out)
    totals = partial.groupBy(*keys, "replicate").agg(
        F.sum("draws").alias("draws"), *[F.sum(v).alias(v) for v in values])
    return totals.drop("__all")


def interval(replicates: DataFrame, keys: Sequence[str], figure: Column) -> DataFrame:
    """95% percentile interval and mean of a figure over the replicates (as many rows as iterations asked for)."""
    r = replicates.withColumn("__f", figure).where(F.col("__f").isNotNull())
    return r.groupBy(*keys).agg(
        F.avg("__f").alias("resampled_mean"),
        F.percentile("__f", F.lit(0.025)).alias("ci95_low"), F.percentile("__f", F.lit(0.975)).alias("ci95_high"))


def mean_interval(
    df: DataFrame, keys: Sequence[str], unit: Sequence[str], value: str, iterations: int, seed: int,
) -> DataFrame:
    """Mean, count and bootstrap interval per key; the interval is NULL below two values or without iterations."""
    keys = list(keys)
    clean = cut_lineage(df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*{*keys, *unit, value}))
    base = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    if iterations <= 0:
        return base.withColumns({c: F.lit(None).cast("double") for c in ("ci95_low", "ci95_high")})
    totals = resample_totals(clean, keys, unit, [value], iterations, seed)
    ci = interval(totals, keys, F.col(value) / F.col("draws")).drop("resampled_mean")
    joined = base.join(ci, keys, "left") if keys else base.join(ci, how="left")
    return joined.withColumns({c: F.when(F.col("n") >= 2, F.col(c)) for c in ("ci95_low", "ci95_high")})


# The tree travels with the tasks, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
