"""Removal of repeated word sequences: suffixes in groups by prefixes of variable length, deep nodes found per group.

A window of ``window`` words that also starts in a document with a smaller id is a repeat; its words go. Windows are the
suffixes of the texts down to that depth, and a repeat is an inner node of their tree with leaves in several documents.

1. Every window has an anchor, its least ``gram``-gram by hash (the leftmost of equals); equal windows have equal anchors.
   Anchors are few, about one in twenty words. An anchor that occurs in one document only has no repeat.
2. Suffixes below anchors of several documents are dealt into groups by a prefix of variable length: the anchor's words,
   or, where an anchor has more than ``hot`` occurrences, the whole window. A batch sends each window once, for its least
   document, and settles its other documents by itself: to a frequent window's group goes an entry per batch. The settled
   starts, an entry per occurrence, are dealt by document and place, so that copies of one text spread over all groups.
   Rows that repeat an id and a text are worked on once per task.
3. A group's windows are put in order by a fingerprint of all their words. No tree of sorted suffixes is built: a run of equal
   fingerprints stands for an inner node of full depth, and all leaves but those of the least document are repeats.
4. The starts of repeats go back to their documents, which drop the covered words.

Defined cases: a null text has no words; a row without id neither loses words nor makes others lose them; rows with equal
ids never remove each other's words; texts are read whole; equal texts under a larger id lose all words that lie in a
window; texts shorter than a window lose nothing; an empty table gives an empty result; extra columns are kept by
``without_repeats`` and not read by the report.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lessonlens.llm.batches import named, numbered, slices
from lessonlens.llm.words import Block, blocks, covered, mix, rolling, window_mask
from lessonlens.session import cut_lineage


@dataclass(frozen=True)
class Repeats:
    window: int = 50
    gram: int = 10
    hot: int = 1000
    group_windows: int = 1 << 19


def anchor_places(b: Block, r: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the block's windows that stay in their text, the place of each one's anchor, and all gram hashes."""
    grams = rolling(b.hashes, r.gram)
    width = r.window - r.gram + 1
    n = max(0, len(b.hashes) - r.window + 1)
    best, at, size = grams, np.arange(len(grams)), 1
    while size < width:  # the least of `size` grams from each place, doubled until the width is reached
        step = min(size, width - size)
        right = best[step:]
        left, left_at, right_at = best[:len(right)], at[:len(right)], at[step:]
        take = right < left
        best, at, size = np.where(take, right, left), np.where(take, right_at, left_at), size + step
    starts = np.flatnonzero(window_mask(b.cuts, r.window, len(b.hashes)))
    return starts, at[starts] if n else np.zeros(0, np.int64), grams


def keyed(docs: DataFrame, others: list[str] = []) -> DataFrame:
    """(doc_id, row_, text, x0, x1..): ``row_`` tells rows apart that repeat an id with another text; x are the ``others``."""
    return docs.select("doc_id", F.xxhash64("text").alias("row_"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
                       *[named(c).alias(f"x{i}") for i, c in enumerate(others)])


def anchors(docs: DataFrame, r: Repeats) -> DataFrame:
    """(doc_id, row_, anchor, place): the distinct anchors of every document, ``place`` counted in words of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            keep, grams_out, places_out = [], [], []
            for b in blocks(batch.column(2)):
                _, places, grams = anchor_places(b, r)
                places = np.unique(places)
                owner = np.searchsorted(b.cuts, places, "right") - 1
                edges = np.searchsorted(owner, np.arange(b.size + 1))
                for i in np.flatnonzero(np.diff(edges)):
                    own = places[edges[i]:edges[i + 1]]
                    keep.append(b.first + i)
                    grams_out.append(grams[own].view(np.int64))
                    places_out.append((own - b.cuts[i]).astype(np.int32))
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(grams_out, pa.list_(pa.int64())),
                                              pa.array(places_out, pa.list_(pa.int32()))], names=["doc_id", "row_", "grams", "places"])

    found = cut_lineage(keyed(docs).where("doc_id is not null").mapInArrow(
        run, "doc_id long, row_ long, grams array<long>, places array<int>"))
    return found.select("doc_id", "row_", F.explode(F.arrays_zip("grams", "places")).alias("x")).select(
        "doc_id", "row_", F.col("x.grams").alias("anchor"), F.col("x.places").alias("place"))


def shared_anchors(places: DataFrame, r: Repeats) -> DataFrame:
    """(d_, r_, places, hots, again): of every document the anchors that other documents have too, and which are hot.

    Rows that repeat an id and a text give their places once; ``again`` marks them.
    """
    several = cut_lineage(places.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
                          .where("low < high").select(F.col("anchor").alias("a_"), (F.col("n") > r.hot).alias("hot")))
    met = places.join(several, F.col("anchor") == F.col("a_")).groupBy(F.col("doc_id").alias("d_"), F.col("row_").alias("r_"))
    met = met.agg(F.collect_set(F.col("place").cast("long") * 2 + F.col("hot").cast("long")).alias("x"), F.count("*").alias("n"))
    return cut_lineage(met.select("d_", "r_", F.transform("x", lambda x: F.shiftright(x, 1).cast("int")).alias("places"),
                                  F.transform("x", lambda x: x % 2 == 1).alias("hots"), (F.col("n") > F.size("x")).alias("again")))


def spread(ids: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of document and stretch of the text, unlike for copies of a text under other ids."""
    with np.errstate(over="ignore"):
        return mix(mix(ids.view(np.uint64) ^ mix(rows.view(np.uint64))) + (starts >> 16).astype(np.uint64))


def repeated_starts(docs: DataFrame, found: DataFrame, r: Repeats) -> DataFrame:
    """(d_, r_, starts): of every document, word places where repeats start, as packed 32-bit numbers."""
    total = found.agg(F.sum(F.size("places"))).first()[0] or 0
    groups = int(total * (r.window - r.gram + 1) // (2 * r.group_windows)) + 1
    # all columns go along, so that this is the same shuffle of the texts as that of the last step: Spark runs it once
    rows = docs.join(found, (F.col("doc_id") == F.col("d_")) & (F.col("row_") == F.col("r_"))).select(
        "doc_id", "row_", "text", "places", "hots", "again", *docs.columns[3:])

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of (group, window hashes, document ids, rows, starts), packed; a row without hashes is settled here."""
        seen = set()
        for batch in batches:
            once = np.ones(batch.num_rows, bool)
            for i in np.flatnonzero(batch.column(5).to_numpy(zero_copy_only=False)):
                key = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                once[i] = key not in seen
                seen.add(key)
            if not once.all():
                batch = batch.filter(pa.array(once))
            ids, marks = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            hashes, texts, starts, keys, held = [], [], [], [], 0
            for b in blocks(batch.column(2)):
                begin, place, grams = anchor_places(b, r)
                owner = np.searchsorted(b.cuts, begin, "right") - 1
                state = np.zeros(len(b.hashes) + 1, np.int8)
                for i in range(b.size):
                    at = np.asarray(batch.column(3)[b.first + i].values) + b.cuts[i]
                    state[at] = 1 + np.asarray(batch.column(4)[b.first + i].values.to_numpy(zero_copy_only=False)).astype(np.int8)
                use = np.flatnonzero(state[place])
                begin, owner, place = begin[use], owner[use], place[use]
                whole = rolling(b.hashes, r.window)[begin]
                hashes.append(whole)
                texts.append(owner + b.first)
                starts.append(begin - b.cuts[owner])
                keys.append(np.where(state[place] == 2, whole, grams[place]))
                held += len(use)
                if held > r.group_windows:
                    yield from settle(hashes, texts, starts, keys, ids, marks)
                    hashes, texts, starts, keys, held = [], [], [], [], 0
            if hashes:
                yield from settle(hashes, texts, starts, keys, ids, marks)

    def settle(hashes, texts, starts, keys, ids, marks) -> Iterator[pa.RecordBatch]:
        h, t, s, k = (np.concatenate(x) for x in (hashes, texts, starts, keys))
        order = np.lexsort((ids[t], h))
        h, t, s, k = h[order], t[order], s[order], k[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        least = ids[t][np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))] if len(h) else ids[t]
        yield from packed_rows(ids[t] > least, h, t, s, k, ids, marks)

    def packed_rows(settled, h, t, s, k, ids, marks) -> Iterator[pa.RecordBatch]:
        names = ["group", "windows", "ids", "rows", "starts"]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        for done in (False, True):
            use = np.flatnonzero(settled == done)
            group = ((k[use] >> np.uint64(20)) if not done else spread(ids[t[use]], marks[t[use]], s[use])) % np.uint64(groups)
            order = np.argsort(group, kind="stable")
            use, group = use[order], group[order]
            edges = np.flatnonzero(np.diff(group, prepend=group[:1] + np.uint64(1))) if len(group) else []
            parts = list(zip(edges, [*edges[1:], len(group)])) if len(edges) else []
            cells = [[int(group[a]) for a, _ in parts], [b"" if done else h[use[a:b]].tobytes() for a, b in parts],
                     *[[x[use[a:b]].tobytes() for a, b in parts] for x in (ids[t], marks[t], s.astype(np.int32))]]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cells, kinds)], names=names)

    def tree(group: pa.Table) -> pa.Table:
        """Leaves below inner nodes of full depth, those of the least document left out; settled starts pass through."""
        join = lambda c, kind, rows: np.frombuffer(b"".join(x for x in rows[c].to_pylist()), kind)
        sizes = np.array([len(x) for x in group["windows"].to_pylist()])
        open_, settled = group.take(pa.array(np.flatnonzero(sizes > 0))), group.take(pa.array(np.flatnonzero(sizes == 0)))
        h = join("windows", np.uint64, open_)
        ids, rows, starts = (join(c, kind, open_) for c, kind in (("ids", np.int64), ("rows", np.int64), ("starts", np.int32)))
        order = np.lexsort((ids, h))
        h, ids, rows, starts = h[order], ids[order], rows[order], starts[order]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        least = ids[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))] if len(h) else ids
        gone = ids > least
        ids, rows, starts = (np.concatenate([x[gone], join(c, x.dtype, settled)]) for x, c in ((ids, "ids"), (rows, "rows"), (starts, "starts")))
        order = np.lexsort((starts, rows, ids))
        ids, rows, starts = ids[order], rows[order], starts[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1])
        ids, rows, starts = ids[new], rows[new], starts[new]
        edges = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])])) if len(ids) else np.zeros(0, int)
        ends = [*edges[1:], len(ids)]
        return pa.table({"d_": pa.array(ids[edges], pa.int64()), "r_": pa.array(rows[edges], pa.int64()),
                         "starts": pa.array([starts[a:b].tobytes() for a, b in zip(edges, ends)], pa.binary())})

    packed = rows.mapInArrow(suffixes, "group long, windows binary, ids binary, rows binary, starts binary")
    return packed.groupBy("group").applyInArrow(tree, "d_ long, r_ long, starts binary")


def _starts(docs: DataFrame, r: Repeats, others: list[str] = []) -> tuple[DataFrame, DataFrame]:
    """The keyed documents, and (d_, r_, starts): the packed starts of repeats of every document that has some."""
    source = keyed(docs.where("doc_id is not null"), others)
    found = shared_anchors(anchors(docs, r), r)
    return source, repeated_starts(source, found, r).groupBy("d_", "r_").agg(F.collect_list("starts").alias("starts"))


def kept_words(b: Block, i: int, starts: list[bytes] | None, window: int) -> np.ndarray:
    """True for the words of text ``i`` of the block that stay."""
    n = int(b.cuts[i + 1] - b.cuts[i])
    if not starts:
        return np.ones(n, bool)
    return ~covered(np.unique(np.frombuffer(b"".join(starts), np.int32)), window, n)


def joined_words(b: Block, i: int, keep: np.ndarray) -> bytes:
    at = np.flatnonzero(keep) + b.cuts[i]
    raw = b.data[int(b.bounds[i]):int(b.bounds[i + 1])].tobytes()
    lo = int(b.bounds[i])
    return b" ".join([raw[s:e] for s, e in zip((b.starts[at] - lo).tolist(), (b.ends[at] - lo).tolist())])


def dedup_report(docs: DataFrame, r: Repeats = Repeats()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    source, starts = _starts(docs, r)
    judged = source.join(starts, (F.col("doc_id") == F.col("d_")) & (F.col("row_") == F.col("r_")), "left").select("doc_id", "text", "starts")
    judged = judged.unionByName(keyed(docs.where("doc_id is null")).select("doc_id", "text", F.lit(None).cast("array<binary>").alias("starts")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sizes, removed, digests = [], [], []
            for b in blocks(batch.column(1)):
                for i in range(b.size):
                    keep = kept_words(b, i, batch.column(2)[b.first + i].as_py(), r.window)
                    sizes.append(len(keep))
                    removed.append(int(len(keep) - keep.sum()))
                    digests.append(hashlib.sha256(joined_words(b, i, keep)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return judged.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, r: Repeats = Repeats()) -> DataFrame:
    """``docs`` without the words of repeats. A text that loses words keeps the others, joined by single blanks.

    Documents without a word left go.
    """
    given = docs.columns
    docs = numbered(docs, ("doc_id", "text"))
    names = docs.columns
    others = [c for c in names if c not in ("doc_id", "text")]
    source, starts = _starts(docs, r, others)
    judged = source.join(starts, (F.col("doc_id") == F.col("d_")) & (F.col("row_") == F.col("r_")), "left")
    alone = keyed(docs.where("doc_id is null"), others).withColumn("starts", F.lit(None).cast("array<binary>"))
    order = ["doc_id" if c == "doc_id" else "text" if c == "text" else f"x{others.index(c)}" for c in names]
    judged = judged.select(*order, "starts").unionByName(alone.select(*order, "starts")).toDF(*names, "__starts")
    at, last = names.index("text"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            texts, full = [], []
            for b in blocks(batch.column(at)):
                for i in range(b.size):
                    keep = kept_words(b, i, batch.column(last)[b.first + i].as_py(), r.window)
                    texts.append(joined_words(b, i, keep) if not keep.all() else b.data[int(b.bounds[i]):int(b.bounds[i + 1])].tobytes())
                    full.append(bool(keep.any()))
            columns = list(batch.columns[:last])
            columns[at] = pa.array(texts, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(full, pa.bool_()))

    out = judged.mapInArrow(run, judged.drop("__starts").schema)
    return out.select(*[named(c).cast("string").alias(c) if c == "text" else named(c) for c in names]).toDF(*given)
