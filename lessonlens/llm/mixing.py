"""Mixing sources to target weights by a low-discrepancy schedule.

A source's documents, in an order shuffled by a hash, form a line of tokens cut into blocks of equal length. Slot n of the
mix gets the point frac(n * golden ratio); the point falls into one source's part of the cumulative weights. The slots of
a source, ranked, take its blocks in turn, pass after pass, the last slot only as far as the target reaches. So every
stretch of the schedule holds the sources in their shares, and what a document gives is the sum over its blocks.

Weights repeat over the sources in code point order, null last. The targets share ``share`` times all sizes by weight; a
target stops at ``most`` times its source's size, and the excess is shared again by weight until none is above (weights
are water levels: target = min(most * size, level * weight)).

Defined cases: a null text has size 0, a null source is a source of its own; documents of size 0 and sources of size 0
take nothing; repeated rows are documents of their own and may take different amounts; an empty table gives an empty
result; input columns called like a result column give way to it. A source of any size is split: running sums go over
hash ranges, slots over ranges of slot numbers, blocks over the block number. Only the table of sources (one row for
each) is ordered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lessonlens.llm.batches import named, numbered, slices, with_text_columns
from lessonlens.llm.words import blocks
from lessonlens.session import cut_lineage

GOLDEN = 0.6180339887498949


@dataclass(frozen=True)
class Mix:
    """``block_tokens``: length of a block; ``chunk_rows``: documents of a source that are put on its line together;
    ``slot_chunk``: slots ranked together."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    block_tokens: int = 2048
    chunk_rows: int = 1024
    slot_chunk: int = 8192
    cells: int = 1024
    seed: str = "mix"


def word_counts(column: pa.Array) -> dict[str, object]:
    counts = [np.diff(b.cuts) for b in blocks(column)]
    return {"size": np.concatenate(counts) if counts else np.empty(0, np.int64)}


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size) -> with ``w``, ``target``; a window over the sources, which are one row each."""
    ordered = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weights = F.array(*[F.lit(float(x)) for x in mix.weights])
    ranked = sizes.withColumn("w", F.element_at(weights, ((F.row_number().over(ordered) - 1) % len(mix.weights) + 1).cast("int")))
    ranked = ranked.withColumn("limit_", F.col("source_size").cast("double") * mix.most)
    rising = W.orderBy(F.col("limit_") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    below = rising.rowsBetween(W.unboundedPreceding, -1)
    rest = rising.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(everything) * mix.share
    level = (total - F.coalesce(F.sum("limit_").over(below), F.lit(0.0))) / F.sum("w").over(rest)
    leveled = ranked.withColumn("level", level)
    # the first level that its own source's limit does not cut holds for that source and all after it
    first = F.min(F.when(F.col("level") * F.col("w") <= F.col("limit_"), F.struct(F.col("limit_") / F.col("w"), F.col("level")))).over(everything)
    return leveled.withColumn("at", first["level"]).select(
        "source", "source_size", "w",
        F.when(F.col("at").isNull() | (F.col("at") * F.col("w") > F.col("limit_")), F.col("limit_"))
        .otherwise(F.col("at") * F.col("w")).alias("target"))


def line_order(mix: Mix) -> Column:
    """The place of a document on its source's line: a hash of its id and its text, so that rows without an id spread as well."""
    text = F.concat(F.lit(mix.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def documents_on_line(docs: DataFrame, keys: list[str], mix: Mix) -> DataFrame:
    """(keys..., source, size, order_) with ``begin``, the tokens of its source before it in the order of ``order_``.

    The line is cut into hash ranges, as many as the number of rows asks for.
    """
    chunks = max(1, -(-docs.count() // mix.chunk_rows))
    placed = docs.withColumn("chunk", F.shiftright("order_", 60 - (chunks - 1).bit_length()))
    sums = placed.groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size"))
    before = W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "chunk", F.coalesce(F.sum("chunk_size").over(before), F.lit(0)).alias("chunk_begin"))
    inside = W.partitionBy("source", "chunk").orderBy("order_", *keys, "size").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    sums = sums.select(F.col("source").alias("s_"), F.col("chunk").alias("c_"), "chunk_begin")
    placed = placed.join(sums, placed.source.eqNullSafe(sums.s_) & (placed.chunk == sums.c_))
    return placed.withColumn("begin", F.col("inner") + F.col("chunk_begin")).drop("s_", "c_", "inner", "chunk_begin", "chunk")


def schedule(targets: DataFrame, mix: Mix) -> DataFrame:
    """The slots of the mix: (slot, source, rank, pass, block, tokens), ``tokens`` taken from the block's start."""
    spark, size = targets.sparkSession, F.lit(mix.block_tokens)
    goal = F.floor(F.col("target") + 0.5).cast("long")
    n_blocks = F.ceil(F.col("source_size") / size)
    passes = F.floor(F.col("goal") / F.col("source_size"))
    need = passes * n_blocks + F.ceil((F.col("goal") - passes * F.col("source_size")) / size)
    plan = targets.where("source_size > 0").withColumn("goal", goal).where("goal > 0").withColumn("need", need.cast("long"))
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    so_far = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(W.unboundedPreceding, W.currentRow)
    plan = plan.withColumn("total", F.sum("need").over(everything)).withColumn("upto", F.sum("need").over(so_far))
    plan = plan.withColumn("high", F.col("upto") / F.col("total")).withColumn("low", (F.col("upto") - F.col("need")) / F.col("total"))
    plan = cut_lineage(plan)
    total = plan.agg(F.max("total")).first()[0] or 0
    product = F.col("id") * F.lit(GOLDEN)
    points = spark.range(total).select(F.col("id").alias("slot"), (product - F.floor(product)).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * mix.cells))
    parts = plan.withColumn("part_cell", F.explode(F.sequence(
        F.floor(F.col("low") * mix.cells), F.least(F.floor(F.col("high") * mix.cells), F.lit(mix.cells - 1).cast("long")))))
    inside = (F.col("cell") == F.col("part_cell")) & (F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))
    drawn = points.join(parts, inside).select("slot", "source", "need", F.floor(F.col("slot") / mix.slot_chunk).alias("range"))
    counts = cut_lineage(drawn.groupBy("source", "range").agg(F.count("*").alias("n")))
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ahead = counts.select(F.col("source").alias("s_"), F.col("range").alias("r_"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inner = F.row_number().over(W.partitionBy("source", "range").orderBy("slot")) - 1
    drawn = drawn.withColumn("inner", inner).join(ahead, F.col("source").eqNullSafe(F.col("s_")) & (F.col("range") == F.col("r_")))
    drawn = drawn.withColumn("rank", F.col("inner") + F.col("ahead")).where("rank < need").select("slot", "source", "rank")
    # the sequence gives a part its share to within a few points; what is missing at the end is appended
    got = counts.groupBy(F.col("source").alias("s_")).agg(F.sum("n").alias("got"))
    short = plan.join(got, F.col("source").eqNullSafe(F.col("s_")), "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    short = short.withColumn("rank", F.explode(F.sequence(F.col("got"), F.col("need") - 1))).select(
        (F.col("total") + F.col("upto") - F.col("need") + F.col("rank")).alias("slot"), "source", "rank")
    facts = plan.select(F.col("source").alias("s_"), "source_size", "goal")
    ranked = drawn.unionByName(short).join(facts, F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    ranked = ranked.withColumn("pass", F.floor(F.col("rank") / n_blocks)).withColumn("block", F.col("rank") % n_blocks)
    left = F.col("goal") - F.col("pass") * F.col("source_size") - F.col("block") * size
    return ranked.select("slot", "source", "rank", "pass", "block",
                         F.least(size.cast("long"), F.col("source_size") - F.col("block") * size, left).alias("tokens"))


def mixed_pieces(docs: DataFrame, keys: list[str], mix: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """(keys..., source, size, order_) -> (pieces, targets): the mix slot by slot, and (source, source_size, target).

    A piece is what a slot takes of one document: (slot, source, pass, block, keys..., size, begin, place, first_word, words),
    ``place`` being where it stands in the slot. Ordered by slot and place, the pieces are the mixed corpus.
    """
    docs = cut_lineage(docs)
    sizes = docs.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    targets = cut_lineage(source_targets(sizes, mix))
    slots = schedule(targets, mix)
    placed = documents_on_line(docs.where("size > 0"), keys, mix)
    cut = F.lit(mix.block_tokens)
    pieces = placed.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("begin") / cut), F.floor((F.col("begin") + F.col("size") - 1) / cut))))
    pieces = pieces.withColumn("place", F.greatest(F.col("begin") - F.col("block") * cut, F.lit(0)))
    pieces = pieces.withColumn("to_", F.least(F.col("begin") + F.col("size") - F.col("block") * cut, cut.cast("long")))
    uses = slots.select("slot", F.col("source").alias("s_"), F.col("block").alias("b_"), "pass", "tokens")
    met = F.col("source").eqNullSafe(F.col("s_")) & (F.col("block") == F.col("b_")) & (F.col("tokens") > F.col("place"))
    return pieces.join(uses, met).select(
        "slot", "source", "pass", "block", *keys, "size", "begin", "place",
        (F.col("block") * cut + F.col("place") - F.col("begin")).alias("first_word"),
        (F.least(F.col("to_"), F.col("tokens")) - F.col("place")).alias("words")), targets


def mixed(docs: DataFrame, keys: list[str], mix: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """(keys..., source, size, order_) -> (takes, targets).

    Takes are (keys..., source, size, begin, pass, got, slot) for every document and pass that takes some of it: the pass takes the
    document's first ``got`` words, and ``slot`` is the first one that does. Targets are (source, source_size, target).
    """
    pieces, targets = mixed_pieces(docs, keys, mix)
    return pieces.groupBy(*keys, "source", "size", "begin", "pass").agg(F.sum("words").alias("got"), F.min("slot").alias("slot")), targets


def _sized(docs: DataFrame, keep: list[str], mix: Mix) -> DataFrame:
    return with_text_columns(docs.withColumn("order_", line_order(mix)), "text", "size long", word_counts, [*keep, "source", "order_"])


def mix_report(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The columns of the query: (doc_id, size, source_size, target, taken), one row per document, and ``first_slot``, the slot of
    the schedule at which the mix first comes to the document (null where it does not)."""
    marked = _sized(docs.select("doc_id", "text", "source"), ["doc_id"], mix).withColumn("row_", F.monotonically_increasing_id())
    marked = cut_lineage(marked)
    takes, targets = mixed(marked, ["doc_id", "row_"], mix)
    some = takes.groupBy(F.col("row_").alias("r_")).agg(F.sum("got").alias("got"), F.min("slot").alias("first_slot"))
    targets = targets.withColumnRenamed("source", "s_")
    rows = marked.join(some, F.col("row_") == F.col("r_"), "left")
    return rows.join(targets, F.col("source").eqNullSafe(F.col("s_"))).select(
        "doc_id", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"), "first_slot")


def mixed_corpus(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixed corpus in pieces: (slot, place, source, pass, block, doc_id, first_word, words, text), to be read by slot and place.
    The text of a piece is its words with single blanks between."""
    keyed = cut_lineage(docs.select("doc_id", "text", "source").withColumn("row_", F.monotonically_increasing_id()))
    pieces, _ = mixed_pieces(_sized(keyed, ["doc_id", "row_"], mix), ["doc_id", "row_"], mix)
    texts = keyed.select(F.col("row_").alias("r_"), F.col("text").cast("binary").alias("text"))
    joined = pieces.join(texts, F.col("row_") == F.col("r_")).select(
        "slot", "place", "source", "pass", "block", "doc_id", "first_word", "words", "text")

    def run(batches):
        for batch in slices(batches, 8):
            parts = [b" ".join((text or b"").split()[first:first + n]) for first, n, text in zip(*[c.to_pylist() for c in batch.columns[6:]])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:8], pa.array(parts, pa.binary())], names=batch.schema.names)

    return joined.mapInArrow(run, joined.schema).withColumn("text", F.col("text").cast("string"))


def first_words(column: pa.Array, counts: pa.Array) -> pa.Array:
    """Every text up to the end of its word number ``counts``."""
    wanted, out = counts.to_pylist(), []
    for b in blocks(column):
        for i in range(b.size):
            last = b.cuts[i] + wanted[b.first + i] - 1
            out.append(b.data[int(b.bounds[i]):int(b.ends[last])].tobytes())
    return pa.array(out, pa.binary())


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixed corpus: every document once per pass that takes it, a document cut by the last slot up to the cut.

    Rows equal in all columns take what the first of them takes.
    """
    given = docs.columns
    docs = numbered(docs, ("doc_id", "text", "source"))
    names = docs.columns
    row = F.xxhash64(*[named(c) for c in names])
    sized = _sized(docs.select("doc_id", "text", "source", row.alias("row_")), ["doc_id", "row_"], mix)
    takes, _ = mixed(sized, ["doc_id", "row_"], mix)
    takes = takes.groupBy(F.col("doc_id").alias("i_"), F.col("row_").alias("r_"), "size", "pass").agg(F.min("got").alias("got_"))
    whole = docs.withColumn("row_", row).join(takes, F.col("doc_id").eqNullSafe(F.col("i_")) & (F.col("row_") == F.col("r_")))
    whole = whole.select(*[named(c) for c in names], F.when(F.col("got_") < F.col("size"), F.col("got_")).alias("cut_"))
    return _cut(whole, names).toDF(*given)


def _cut(rows: DataFrame, names: list[str]) -> DataFrame:
    source = rows.select(*[named(c).cast("binary").alias(c) if c == "text" else named(c) for c in names], "cut_")
    at, cut = names.index("text"), len(names)

    def run(batches):
        import pyarrow.compute as pc

        for batch in slices(batches, at):
            columns = [batch.column(i) for i in range(cut)]
            short = batch.column(cut)
            if short.null_count < len(short):
                mask = short.is_valid()
                some = first_words(columns[at].filter(mask), short.filter(mask))
                columns[at] = pc.replace_with_mask(columns[at], mask, some)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = source.mapInArrow(run, source.select(*[named(c) for c in names]).schema)
    return out.select(*[named(c).cast("string").alias(c) if c == "text" else named(c) for c in names])
