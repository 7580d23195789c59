"""Similarity join on word n-grams by MinHash bands.

1. Texts with equal words are one class of copies. Every class gets a MinHash signature, cut into bands; rows per band and
   bands are chosen so that a pair at the threshold meets in some band with the target recall.
2. Classes that share a band are linked to the least class of that band. No pairs of a band are formed: the components
   of these links hold every pair that meets in any band.
3. Components are cut into blocks of bounded size, and every two blocks of a component are compared in one task on the full
   n-gram sets, as products of incidence matrices. What leaves a task is the number of links of each class and a
   spanning forest of its links, never the pairs.
4. The components of the verified links are the groups of near copies.

Within a component every pair is compared, so links that no band would have shown are found as well. The work for one
component grows with the square of its distinct texts, as the number of its links does; its memory does not.

Defined cases: n-grams are taken of words; a text with fewer words than an n-gram has one, all its words; a text without
words (null, empty, blank) is alone; a row without id is alone and has no group; rows that repeat an id and words are
copies of each other; texts are read whole; an empty table gives an empty result; further columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lessonlens.llm.batches import numbered, slices
from lessonlens.llm.components import components
from lessonlens.llm.words import blocks, rolling
from lessonlens.session import cut_lineage


@dataclass(frozen=True)
class Join:
    """``block_texts``, ``block_words``: how much of a component one side of a comparison holds."""

    n: int = 5
    threshold: float = 0.8
    recall: float = 0.9999
    rows: int = 5
    block_texts: int = 512
    block_words: int = 1 << 18
    seed: int = 11

    @property
    def bands(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.threshold**self.rows))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """The set of n-grams of a text's word hashes, sorted."""
    if not len(hashes):
        return hashes
    return np.unique(rolling(hashes, min(n, len(hashes))))


class Signer:
    """Band keys of n-gram sets."""

    def __init__(self, join: Join):
        rng = np.random.default_rng(join.seed)
        k = join.bands * join.rows
        self.shape = join.bands, join.rows
        self.a = rng.integers(0, 2**32, (k, 1), dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, (k, 1), dtype=np.uint32)
        self.mixers = rng.integers(0, 2**63, self.shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = rng.integers(0, 2**63, join.bands, dtype=np.uint64)

    def bands(self, grams: np.ndarray) -> np.ndarray:
        short = (grams >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 2**32 - 1, np.uint32)
        for at in range(0, len(short), 2048):
            np.minimum(least, (short[at:at + 2048] * self.a + self.b).min(axis=1), out=least)
        with np.errstate(over="ignore"):
            key = (least.reshape(self.shape).astype(np.uint64) * self.mixers).sum(axis=1, dtype=np.uint64) + self.salts
            key = (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return (key ^ (key >> np.uint64(29))).view(np.int64)


def signatures(docs: DataFrame, join: Join) -> DataFrame:
    """(doc_id, digest, n_words, bands): the class of copies of every document, and its band keys."""
    source = docs.select("doc_id", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(join)
        for batch in slices(batches, 1):
            digests, sizes, bands = [], [], []
            for b in blocks(batch.column(1)):
                for i in range(b.size):
                    own = b.hashes[b.cuts[i]:b.cuts[i + 1]]
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                    sizes.append(len(own))
                    bands.append(signer.bands(shingles(own, join.n)) if len(own) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                                              pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "digest", "n_words", "bands"])

    return source.mapInArrow(run, "doc_id long, digest binary, n_words long, bands array<long>")


def candidate_components(classes: DataFrame) -> DataFrame:
    """(node, label): classes that meet another in a band, by the components of such meetings."""
    keys = classes.select("digest", F.explode("bands").alias("key"))
    heads = cut_lineage(keys.groupBy("key").agg(F.min("digest").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n"))
    links = keys.join(heads, "key").where("digest != head").select(F.col("digest").alias("a"), F.col("head").alias("b")).distinct()
    return components(links)


def common(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``left`` with those at ``right``."""
    used = np.union1d(left, right)
    owner = np.repeat(np.arange(len(used)), [len(grams[u]) for u in used])
    _, column, times = np.unique(np.concatenate([grams[u] for u in used]), return_inverse=True, return_counts=True)
    shared = times > 1
    rank = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    rows, cols = np.searchsorted(used, left), np.searchsorted(used, right)
    total = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((len(used), min(4096, int(shared.sum()) - at)), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        total += part[rows] @ part[cols].T
    return total


def linked(grams: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    sizes = np.array([len(g) for g in grams], float)
    inter = common(grams, left, right)
    union = sizes[left][:, None] + sizes[right][None, :] - inter
    return inter >= threshold * union - 1e-6


def roots(pairs: np.ndarray, n: int) -> np.ndarray:
    """The least member of every node's component under the given pairs of nodes."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, pairs[:, 0], label[pairs[:, 1]])
        np.minimum.at(least, pairs[:, 1], label[pairs[:, 0]])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def compare(group: pa.Table, threshold: float) -> pa.Table:
    """Links and forest edges of one comparison of two blocks, or of many small components."""
    digests, copies = group["digest"].to_pylist(), np.asarray(group["copies"])
    grams = [np.frombuffer(g, np.uint64) for g in group["grams"].to_pylist()]
    labels, blocks_ = group["label"].to_pylist(), np.asarray(group["block"])
    sides = list(zip(labels, group["left"].to_pylist(), group["right"].to_pylist()))
    order = sorted(range(len(sides)), key=lambda i: (sides[i], digests[i]))
    out: list[tuple] = []
    at = 0
    while at < len(order):
        end = at
        while end < len(order) and sides[order[end]] == sides[order[at]]:
            end += 1
        own = np.array(order[at:end])
        _, left, right = sides[own[0]]
        a, b = (np.flatnonzero(blocks_[own] == s) for s in (left, right))
        near = linked([grams[i] for i in own], a, b, threshold)
        if left == right:
            np.fill_diagonal(near, False)
            pairs = np.argwhere(np.triu(near))
        else:
            pairs = np.argwhere(near)
        pairs = np.stack([a[pairs[:, 0]], b[pairs[:, 1]]], axis=1)
        links, texts = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for x, y in ((0, 1), (1, 0)):
            np.add.at(links, pairs[:, x], copies[own[pairs[:, y]]])
            np.add.at(texts, pairs[:, x], 1)
        root = roots(pairs, len(own))
        out.extend((digests[own[k]], int(links[k]), int(texts[k]), digests[own[root[k]]]) for k in np.flatnonzero(texts))
        at = end
    columns = list(zip(*out)) or [(), (), (), ()]
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("digest", "links", "texts", "root"), columns, kinds)})


def verified(docs: DataFrame, classes: DataFrame, candidates: DataFrame, join: Join) -> DataFrame:
    """(digest, links, texts, root, single): the verified links of every class, one row per comparison with links."""
    members = cut_lineage(classes.join(candidates.withColumnRenamed("node", "digest"), "digest")
                          .select("digest", "rep_id", "copies", "n_words", "label"))
    need = F.ceil(F.greatest(F.count("*") / join.block_texts, F.sum("n_words") / join.block_words))
    sizes = cut_lineage(members.groupBy(F.col("label").alias("l_")).agg(need.alias("parts"), F.sum("n_words").alias("words")))
    small = sizes.where("parts = 1").agg(F.sum("words")).first()[0] or 0
    bins = int(small // join.block_words) + 1
    members = members.join(sizes.drop("words"), F.col("label") == F.col("l_")).drop("l_")
    members = members.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(members, F.col("doc_id") == F.col("rep_id"))
    texts = texts.select("digest", "copies", "label", "parts", "block", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5):
            expected, grams, keep = batch.column(0).to_pylist(), [], []
            for b in blocks(batch.column(5)):
                for i in range(b.size):
                    own = b.hashes[b.cuts[i]:b.cuts[i + 1]]
                    at = b.first + i
                    if xxhash.xxh3_128_digest(own.tobytes()) == expected[at]:  # a repeated id may have other words
                        keep.append(at)
                        grams.append(shingles(own, join.n).tobytes())
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:5], pa.array(grams, pa.binary())],
                                             names=["digest", "copies", "label", "parts", "block", "grams"])

    sets = texts.mapInArrow(cut, "digest binary, copies long, label binary, parts long, block int, grams binary")
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
    sets = sets.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
    bin_ = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("label"), F.lit(bins))).otherwise(F.xxhash64("label", "left", "right"))
    sets = sets.withColumn("bin", bin_)
    threshold = join.threshold
    found = sets.groupBy("bin").applyInArrow(lambda group: compare(once(group), threshold), "digest binary, links long, texts long, root binary")
    found = cut_lineage(found)
    return found.join(members.select("digest", (F.col("parts") == 1).alias("single")), "digest")


def once(group: pa.Table) -> pa.Table:
    """A class once per comparison, though its id was repeated."""
    seen, keep = set(), []
    for i, key in enumerate(zip(group["digest"].to_pylist(), group["left"].to_pylist(), group["right"].to_pylist())):
        if key not in seen:
            seen.add(key)
            keep.append(i)
    return group if len(keep) == len(group) else group.take(pa.array(keep))


def near_copies(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """(doc_id, class_id, n_links) for every row: the least id of its group of near copies, and how many rows it is linked to."""
    signed = cut_lineage(signatures(docs, join))
    usable = signed.where("doc_id is not null and n_words > 0")
    classes = cut_lineage(usable.groupBy("digest").agg(F.min("doc_id").alias("rep_id"), F.count("*").alias("copies"),
                                                       F.first("n_words").alias("n_words"), F.first("bands").alias("bands")))
    found = cut_lineage(verified(docs, classes, candidate_components(classes), join))
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    simple = found.where("single").select("digest", "root")
    split = components(found.where("not single and digest != root").select(F.col("digest").alias("a"), F.col("root").alias("b")))
    rooted = simple.unionByName(split.select(F.col("node").alias("digest"), F.col("label").alias("root")))
    reps = classes.select("digest", "rep_id", "copies").join(links, "digest", "left").join(rooted, "digest", "left")
    reps = cut_lineage(reps.withColumn("root", F.coalesce("root", "digest")))
    groups = cut_lineage(reps.groupBy("root").agg(F.min("rep_id").alias("class_id")))
    known = cut_lineage(reps.join(groups, "root").select(F.col("digest").alias("d_"), "class_id",
                                                         (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    joined = signed.select("doc_id", F.when(F.col("doc_id").isNotNull() & (F.col("n_words") > 0), F.col("digest")).alias("digest"))
    joined = joined.join(known, F.col("digest") == F.col("d_"), "left")
    return joined.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """The rows of ``docs`` that stay when of each group only the document with the least id does.

    Rows without an id stay; rows that repeat the id that stays, stay with it.
    """
    rows = numbered(docs, ("doc_id", "text"))
    gone = cut_lineage(near_copies(rows, join).where("doc_id != class_id").select(F.col("doc_id").alias("gone_")).distinct())
    return rows.join(gone, F.col("doc_id") == F.col("gone_"), "left_anti").toDF(*docs.columns)
