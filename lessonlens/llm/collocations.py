"""Phrase collocations by marginalisation of the longest windows.

Every word begins one window of four words; the lead columns behind the end of a piece are empty. Only these windows are
counted. A phrase of k words occurs wherever it is the first k words of a window, so ``ROLLUP`` over the four columns sums
the counts of windows to the counts of all shorter phrases, and no n-grams of other lengths are ever made.

What moves is small. A first pass counts words. Words found less than ``min_count`` times in their language can be in no
candidate and in no part of one, so they end a window like the end of a piece does. Windows are counted in the task that
reads them and dealt by their first two words to buckets of bounded size; what shares its first two words meets in one
bucket, so there all counts of two words and more are known, and rare windows are summed to their longest prefix that is
frequent before the ROLLUP. Only pairs of the ``1 / hot`` most frequent words could be large; for these the next word decides
the bucket as well (and after a third such word the fourth), their counts stay whole, and the ROLLUP adds what the buckets
have. Any other pair has less than ``hot`` of all windows.

Words travel as numbers: the rank for at most ``listed`` most frequent words (the only table sent to all workers, with a bit
filter of fixed size that knows the other frequent words), a 64-bit fingerprint for the rest. All words of the corpus are
checked against each other: if a frequent word shares its number with another word, all fingerprints get another seed. So
counts are exact. Scores use decimals.

Defined cases: a null text is empty, a null language is ``und`` and joins texts called so; repeated rows count each; texts are
read whole; an empty table gives an empty result; further input columns do not matter. Ties are ordered by the phrase.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from lessonlens.llm.batches import slices
from lessonlens.llm.words import flat, mix
from lessonlens.session import cut_lineage

WORD, GAP, BREAK = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = GAP
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = BREAK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
KEY = ["c1", "c2", "c3", "c4"]
FILTER_BITS, FILTER_PARTS = 1 << 23, 16


@dataclass(frozen=True)
class Mining:
    min_count: int = 30
    contained_percent: int = 80
    scale: int = 2_000_000
    top: int = 2000
    listed: int = 65_535
    listed_bytes: int = 64
    bucket_windows: int = 1_000_000
    hot: float = 1 / 128


@dataclass
class Tokens:
    """The words of a batch: entries (language, word) without repetition, and for every word its entry and its piece."""

    langs: list[bytes]
    words: pa.Array
    entry_lang: np.ndarray
    entry_word: np.ndarray
    entry: np.ndarray
    piece: np.ndarray


def tokens(texts: pa.Array, langs: pa.Array) -> Tokens:
    data, bounds = flat(texts)
    own = bounds - bounds[0]
    part = LOWER[data[int(bounds[0]):int(bounds[-1])]]
    kind = KIND[part]
    inside = kind == WORD
    edge = np.zeros(len(part) + 1, bool)
    edge[own] = True
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(fresh)
    packed = part[inside]
    offsets = np.full(len(starts) + 1, len(packed), np.int64)
    if len(starts):
        offsets[:-1] = (np.cumsum(inside) - 1)[starts]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
    words = words.dictionary_encode()
    spoken = langs.fill_null(b"und").dictionary_encode()
    of_text = spoken.indices.to_numpy(zero_copy_only=False)
    text = np.searchsorted(own, starts, "right") - 1
    several = max(1, len(spoken.dictionary))
    both = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * several + of_text[text]
    known, entry = np.unique(both, return_inverse=True)
    return Tokens(spoken.dictionary.to_pylist(), words.dictionary, known % several, known // several, entry,
                  np.cumsum((kind == BREAK) | edge[:-1])[starts])


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("lang").cast("string").cast("binary").alias("lang"), F.col("text").cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words, the first two as bytes; counted in each task before they are shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            t = tokens(batch.column(1), batch.column(0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(t.langs, pa.binary()).take(pa.array(t.entry_lang)), t.words.take(pa.array(t.entry_word)).cast(pa.binary()),
                 pa.array(np.bincount(t.entry, minlength=len(t.entry_word)).astype(np.int64))], names=["lang", "word", "n"])

    return _read(docs).mapInArrow(run, "lang binary, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fingerprint(lang: bytes, word: bytes, seed: int) -> int:
    """A negative number."""
    return xxhash.xxh3_64_intdigest(len(lang).to_bytes(4, "little") + lang + word, seed) % 2**63 - 2**63


def probes(ids: np.ndarray) -> np.ndarray:
    """The four bits of the filter that belong to each fingerprint."""
    u = ids.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        a, b = mix(u), mix(u ^ np.uint64(0x5BD1E995)) | np.uint64(1)
        return ((a[:, None] + b[:, None] * np.arange(4, dtype=np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Numbers:
    """What workers need to number words; its size has a fixed bound."""

    seed: int
    words: dict[bytes, list[bytes]]
    ranks: dict[bytes, list[int]]
    filter: bytes
    hot: int
    kept: dict = field(default_factory=dict, compare=False, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "kept": {}}

    def of(self, t: Tokens) -> np.ndarray:
        """The number of every entry of a batch: a rank, a negative fingerprint, or 0 for rare words."""
        if not self.kept:
            bits = np.frombuffer(self.filter, np.uint8)
            self.kept["bits"] = np.unpackbits(bits, bitorder="little").astype(bool) if bits.any() else None
            for lang, words in self.words.items():
                self.kept[lang] = pa.array(words, pa.large_binary()), np.array([0, *self.ranks[lang]], np.int64)
        out = np.zeros(len(t.entry_word), np.int64)
        bits = self.kept["bits"]
        for k, lang in enumerate(t.langs):
            own = np.flatnonzero(t.entry_lang == k)
            words = t.words.take(pa.array(t.entry_word[own]))
            if lang in self.words:
                listed, ranks = self.kept[lang]
                out[own] = ranks[pc.index_in(words, listed).fill_null(-1).to_numpy(zero_copy_only=False) + 1]
            if bits is None:
                continue
            missing = np.flatnonzero(out[own] == 0)
            ids = np.array([fingerprint(lang, w, self.seed) for w in words.take(pa.array(missing)).to_pylist()], np.int64)
            ids[~bits[probes(ids)].all(1)] = 0
            out[own[missing]] = ids
        return out


def _numbered(counts: DataFrame, listed: DataFrame, seed: int, ranks: dict[tuple[bytes, bytes], int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            ids = [ranks.get(p) or fingerprint(*p, seed) for p in pairs]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.int64())], names=["lang", "word", "n", "id"])

    return counts.mapInArrow(run, "lang binary, word binary, n long, id long")


def _filter(rest: DataFrame) -> bytes:
    """The bit filter of the frequent words without rank: each task sets bits, and parts of the filter are joined."""
    width = FILTER_BITS // FILTER_PARTS // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            bits[probes(batch.column(0).to_numpy(zero_copy_only=False)).ravel()] = True
        packed = np.packbits(bits, bitorder="little").reshape(FILTER_PARTS, width)
        full = np.flatnonzero(packed.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([packed[k].tobytes() for k in full], pa.binary())], names=["part", "bits"])

    def joined(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(width, np.uint8)
        for batch in batches:
            for b in batch.column("bits"):
                bits |= np.frombuffer(b.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([bits.tobytes()], pa.binary())], names=["part", "bits"])

    out = bytearray(FILTER_BITS // 8)
    made = rest.select("id").mapInArrow(run, "part long, bits binary").groupBy("part").applyInArrow(joined, "part long, bits binary")
    for row in made.collect():  # FILTER_PARTS rows at most
        out[row.part * width:(row.part + 1) * width] = row.bits
    return bytes(out)


def numbers(counts: DataFrame, options: Mining) -> tuple[Numbers, DataFrame, int]:
    """The numbering of frequent words, the table (lang, word, n, id) of these, and the number of all words."""
    step = F.floor(16 * F.log2("n"))
    frequent = counts.where(F.col("n") >= options.min_count)
    sizes = frequent.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    room, least = options.listed, None
    for row in sorted(sizes.collect(), key=lambda r: -r.step):  # at most 1,024 steps
        room -= row.n
        if room < 0:
            break
        least = row.step
    total = counts.agg(F.sum("n")).first()[0] or 0
    top = []
    if least is not None:
        short = (F.octet_length("word") <= options.listed_bytes) & (F.octet_length("lang") <= options.listed_bytes)
        top = frequent.where((step >= least) & short).collect()  # at most options.listed rows of bounded length
    top.sort(key=lambda r: (-r.n, bytes(r.lang), bytes(r.word)))
    ranks = {(bytes(r.lang), bytes(r.word)): i + 1 for i, r in enumerate(top)}
    seed = 0
    while True:
        numbered = _numbered(counts, frequent, seed, ranks)
        clash = (numbered.groupBy("id").agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
                 .where((F.col("k") > 1) & (F.col("n") >= options.min_count)))
        if clash.isEmpty():
            break
        seed += 1
    entries = cut_lineage(_numbered(frequent, frequent, seed, ranks))
    by_lang: dict[bytes, tuple[list[bytes], list[int]]] = {}
    for (lang, word), rank in ranks.items():
        words, own = by_lang.setdefault(lang, ([], []))
        words.append(word)
        own.append(rank)
    bits = _filter(entries.where("id < 0"))
    hot = sum(1 for r in top if r.n >= options.hot * total)
    return Numbers(seed, {k: v[0] for k, v in by_lang.items()}, {k: v[1] for k, v in by_lang.items()}, bits, hot), entries, total


def lead_windows(t: Tokens, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of a batch as rows of four numbers (0 behind the end), and how often each occurs."""
    frequent = np.unique(ids[ids != 0])
    table = np.append(0, frequent)
    word, n = np.where(ids != 0, np.searchsorted(frequent, ids) + 1, 0)[t.entry], len(t.entry)
    lead = [word]
    for k in range(1, 4):
        own = np.zeros(n, np.int64)
        m = max(0, n - k)
        own[:m] = np.where((t.piece[k:] == t.piece[:m]) & (lead[-1][:m] != 0), word[k:], 0)
        lead.append(own)
    begin = np.flatnonzero(lead[0])
    base = len(table)
    left, right = ((lead[k] * base + lead[k + 1])[begin] for k in (0, 2))
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    heads = np.flatnonzero(fresh)
    left, right = left[heads], right[heads]
    return (table[np.stack([left // base, left % base, right // base, right % base], 1)],
            np.diff(np.append(heads, len(order))))


def bucket_of(rows: np.ndarray, hot: int, buckets: int) -> np.ndarray:
    u = rows.view(np.uint64)
    is_hot = (rows > 0) & (rows <= hot)
    third = is_hot[:, 0] & is_hot[:, 1]
    with np.errstate(over="ignore"):
        h = mix(mix(u[:, 0]) + u[:, 1])
        h = np.where(third, mix(h + u[:, 2]), h)
        h = np.where(third & is_hot[:, 2], mix(h + u[:, 3]), h)
    return (h % np.uint64(buckets)).astype(np.int64)


def packed(rows: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted windows and their counts by column and byte. Where all columns before are as in the row above, a column holds
    the difference to that row; so most upper bytes are zeros and take no room."""
    columns = np.ascontiguousarray(np.concatenate([rows.T, counts[None]]), "<i8")
    same = np.ones(len(rows) - 1, bool)
    for k in range(4):
        step = np.diff(rows[:, k])
        columns[k, 1:] = np.where(same, step, rows[1:, k])
        same &= step == 0
    return zstandard.ZstdCompressor(level=1).compress(columns.view(np.uint8).reshape(5, -1, 8).transpose(0, 2, 1).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(5, 8, -1)
    columns = np.array(planes.transpose(0, 2, 1), order="C").view("<i8").reshape(5, -1)
    head = np.zeros(columns.shape[1], bool)  # rows in which a column before has changed
    head[0] = True
    for k in range(4):
        sums = np.cumsum(columns[k])
        heads = np.flatnonzero(head)
        columns[k] = sums - np.repeat((sums - columns[k])[heads], np.diff(np.append(heads, len(sums))))
        head[1:] |= columns[k, 1:] != columns[k, :-1]
    return columns


def window_blobs(docs: DataFrame, numbers_: Numbers, buckets: int) -> DataFrame:
    """(bucket, windows): the counted windows of each batch by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            t = tokens(batch.column(1), batch.column(0))
            rows, counts = lead_windows(t, numbers_.of(t))
            bucket = bucket_of(rows, numbers_.hot, buckets)
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            rows, counts, bucket = rows[order], counts[order], bucket[order]
            heads = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(heads[1:], len(bucket))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[heads], pa.int64()), pa.array([packed(rows[a:b], counts[a:b]) for a, b in zip(heads, ends)], pa.binary())],
                names=["bucket", "windows"])

    return _read(docs).mapInArrow(run, "bucket long, windows binary")


def merged(columns: np.ndarray, hot: int, min_count: int) -> np.ndarray:
    """Rows (c1, c2, c3, c4, n) of one bucket's windows, the rare ones summed to their longest prefix that may be frequent."""
    columns = columns[:, np.lexsort(columns[3::-1])]
    keys, n = columns[:4], columns[4]
    fresh = np.ones((4, len(n)), bool)  # fresh[k]: the first k + 1 columns differ from the row before
    differ = keys[:, 1:] != keys[:, :-1]
    fresh[:, 1:] = np.logical_or.accumulate(differ, 0)
    heads = [np.flatnonzero(f) for f in fresh]
    sums = [np.add.reduceat(n, h) if len(h) else n for h in heads]
    is_hot = (keys > 0) & (keys <= hot)
    out, kept = [], np.ones(len(heads[0]), bool)
    for level in range(3):
        deeper = heads[level + 1]
        parent = np.searchsorted(heads[level], deeper, "right") - 1
        # the bucket has all of a prefix of two or three words unless these are all hot, and all of four words
        whole = ~is_hot[:level + 2, deeper].all(0) if level < 2 else np.ones(len(deeper), bool)
        stays = kept[parent] & (keys[level + 1, deeper] != 0) & (~whole | (sums[level + 1] >= min_count))
        rest = sums[level] - np.bincount(parent[stays], sums[level + 1][stays], len(heads[level])).astype(np.int64)
        some = np.flatnonzero(kept & (rest > 0))
        row = np.zeros((5, len(some)), np.int64)
        row[:level + 1] = keys[:level + 1, heads[level][some]]
        row[4] = rest[some]
        out.append(row)
        kept = stays
    some = np.flatnonzero(kept)
    out.append(np.concatenate([keys[:, heads[3][some]], sums[3][some][None]]))
    return np.concatenate(out, 1)


def phrase_counts(docs: DataFrame, numbers_: Numbers, total: int, options: Mining) -> DataFrame:
    """(c1, c2, c3, c4, f): all phrases of one to four frequent words found often enough; 0 stands behind the last word."""
    hot, least = numbers_.hot, options.min_count
    buckets = max(1, -(-total // options.bucket_windows))

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [unpacked(b.as_py()) for batch in batches for b in batch.column("windows")]
        rows = merged(np.concatenate(found, 1), hot, least)
        for at in range(0, rows.shape[1], 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[at:at + 65_536])) for c in rows], names=[*KEY, "n"])

    blobs = window_blobs(docs, numbers_, buckets).repartition(buckets, "bucket")  # tasks grow with the corpus
    windows = blobs.groupBy("bucket").applyInArrow(merge, ", ".join(f"{c} long" for c in KEY) + ", n long")
    level = F.grouping_id()
    last = F.expr("CASE g WHEN 0 THEN c4 WHEN 1 THEN c3 WHEN 3 THEN c2 WHEN 7 THEN c1 ELSE 0 END")
    sums = windows.rollup(*KEY).agg(F.sum("n").alias("f"), level.alias("g")).where((last != 0) & (F.col("f") >= least))
    return sums.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in KEY], "f")


def _key(*words: Column) -> list[Column]:
    return [w.alias(c) for w, c in zip([*words, *[F.lit(0).cast("long")] * 4], KEY)]


def _length() -> Column:
    return F.lit(1) + (F.col("c2") != 0).cast("int") + (F.col("c3") != 0).cast("int") + (F.col("c4") != 0).cast("int")


def scored(counts: DataFrame, options: Mining) -> DataFrame:
    """Candidates that are in no frequent longer one, with their lowest-scoring cut: c1..c4, a, score, k, l, r."""
    word = [F.col(c) for c in KEY]
    candidates = counts.where("c2 <> 0").withColumn("m", _length())
    whole = F.struct(*KEY).alias("whole")
    parts = F.filter(F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), *_key(*(word[:k] if side == "l" else word[k:])))
        for k in (1, 2, 3) for side in "lr"]), lambda p: p["k"] < F.col("m"))
    cuts = candidates.select(whole, F.col("f").alias("a"), F.explode(parts).alias("p")).select("whole", "a", "p.*")
    looked = cuts.join(counts, KEY).select("whole", "a", "k", "side", "f", F.lit(None).cast("long").alias("longer"))
    inner = F.filter(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(i + size).alias("end"), F.lit(size).alias("size"), *_key(*word[i:i + size]))
        for size in (2, 3) for i in range(0, 5 - size)]), lambda p: (p["end"] <= F.col("m")) & (p["size"] < F.col("m")))
    inside = candidates.select(F.col("f").alias("longer"), F.explode(inner).alias("p")).select(F.struct(*[F.col(f"p.{c}") for c in KEY]).alias("whole"), "longer")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("a", "long"), ("k", "int"), ("side", "string"), ("f", "long"))]
    both = looked.unionByName(inside.select("whole", *nothing, "longer"))
    per_cut = [F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}") for k in (1, 2, 3) for side in "lr"]
    made = both.groupBy("whole").agg(F.max("a").alias("a"), F.max("longer").alias("longer"), *per_cut)
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = lambda k: F.expr(f"cast({options.scale} AS DECIMAL(10,0)) * cast(a AS DECIMAL(20,0)) div (cast(l{k} AS DECIMAL(20,0)) + cast(r{k} AS DECIMAL(20,0)))")
    best = F.array_min(F.filter(F.array(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(
        score(k).cast("long").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in (1, 2, 3)]),
        lambda c: c.isNotNull()))
    hidden = F.lit(100).cast("decimal(10,0)") * wide("longer") >= F.lit(options.contained_percent).cast("decimal(10,0)") * wide("a")
    return made.where(F.col("longer").isNull() | ~hidden).select("whole.*", "a", best.alias("b")).select(*KEY, "a", "b.*")


def _texts(phrases: DataFrame, entries: DataFrame, options: Mining) -> DataFrame:
    """``phrases`` with language and text. Ranks are looked up in a table of bounded size, fingerprints in the others."""
    one = F.posexplode(F.filter(F.array(*KEY), lambda c: c != 0)).alias("at", "id")
    # the rows with ranks: at most options.listed, each of at most 2 * options.listed_bytes bytes
    listed = F.broadcast(entries.where("id > 0").select("id", F.col("lang").alias("lang1"), F.col("word").alias("word1")))
    others = entries.where("id < 0").select("id", F.col("lang").alias("lang2"), F.col("word").alias("word2"))
    split = phrases.select(F.struct(*KEY, "a", "score", "l", "r").alias("p"), one).join(listed, "id", "left")
    ranked = split.where("id > 0").select("p", "at", F.col("lang1").alias("lang"), F.col("word1").alias("word"))
    rest = split.where("id < 0").select("p", "at", "id").join(others, "id").select("p", "at", F.col("lang2").alias("lang"), F.col("word2").alias("word"))
    words = [F.max(F.when(F.col("at") == k, F.col("word").cast("string"))).alias(f"w{k}") for k in range(4)]
    return (ranked.unionByName(rest).groupBy("p").agg(F.max("lang").cast("string").alias("lang"), *words)
            .select("p.*", "lang", F.concat_ws(" ", "w0", "w1", "w2", "w3").alias("phrase")))


def collocations(docs: DataFrame, options: Mining = Mining()) -> DataFrame:
    """All candidates that stand: lang, phrase, a, l, r, score; and the words per language as ``n``."""
    counts = cut_lineage(word_counts(docs))
    numbers_, entries, total = numbers(counts, options)
    found = cut_lineage(phrase_counts(docs, numbers_, total, options))
    phrases = _texts(scored(found, options), entries, options)
    sizes = counts.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.sum("n").alias("n"))
    return phrases.join(sizes, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def collocation_report(docs: DataFrame, options: Mining = Mining()) -> DataFrame:
    """The columns of the query: each language's first phrases by score, count and text."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = collocations(docs, options).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= options.top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
