"""Periodic runs of words by internal pattern matching.

A run is a stretch of words with smallest period q, at least ``min_length`` words and ``min_exponent`` periods long, that no
neighbouring word extends with that period. The words of many texts form one sequence in which a mark of its own ends
every text. Its suffixes are sorted by prefix doubling down to the depth that the longest text can need; a wavelet tree
over the sorted positions answers, for the interval of suffixes that begin with a block, which occurrence of the block is
next after or before a position.

Level B looks for the periods above B/2 up to B (at B = 2 for 1 and 2). A run of four periods holds an aligned block of B
words whose shift by q, to the right or to the left, lies in the run as well. The block is at least one period long, so no
nearer occurrence inside the run is possible (it would make a common divisor a period). Hence the distance to the next or
the previous occurrence, the step of the progression that the occurrences form, is the period, if it is at most B.
Neighbouring blocks with one step are joined, the joined stretch is extended word by word, which takes less than a few
blocks, and what is long enough is a run. Everything runs on arrays over blocks of texts; words are compared as exact codes.

Defined cases: a null text has no words and no run; empty and blank texts likewise; equal rows get equal results, each row
its own; a text is worked on whole whatever its length (memory: some 100 bytes a word of the longest text); an empty table
gives an empty result; input columns called like a result column give way to it. The order of runs is by start, then period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lessonlens.llm.batches import with_columns_of
from lessonlens.llm.words import flat, word_borders

BLOCK = 1 << 18
DDL = ("n_runs long, start long, length long, period long, exponent_milli long, "
       "runs_sha256 string, collapsed_sha256 string")
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


@dataclass(frozen=True)
class Runs:
    min_length: int = 6
    min_exponent: int = 4


def suffix_order(seq: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions sorted by their next ``2**levels`` symbols, each position's place in that order (the first of equals), and
    for every place the level at which it differs from the place before (127: equal in all of them)."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    sorted_ = seq[order]
    fresh = np.ones(n, bool)
    fresh[1:] = sorted_[1:] != sorted_[:-1]
    differs = np.where(fresh, 0, 127).astype(np.int8)
    place = np.empty(n, np.int64)
    place[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    for level in range(1, levels + 1):
        alone = fresh & np.append(fresh[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        at = order[slots]
        after = at + (1 << (level - 1))
        key = place[at] * (n + 1) + np.where(after < n, place[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        cut = slots[1:][key[1:] != key[:-1]]
        differs[cut] = np.minimum(differs[cut], level)
        fresh[cut] = True
        place[at] = np.maximum.accumulate(np.where(fresh[slots], slots, 0))
    return order, place, differs


class WaveletTree:
    """Bits of the values from the highest on; every level keeps the count of zeros before each place."""

    def __init__(self, values: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            one = ((values >> bit) & 1).astype(bool)
            counts = np.zeros(len(values) + 1, np.int32 if len(values) < 2**31 else np.int64)
            np.cumsum(~one, out=counts[1:])
            self.zeros.append(counts)
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of each range are smaller than x."""
        count = np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.zeros):
            one = ((x >> (self.bits - 1 - level)) & 1).astype(bool)
            zlo, zhi, total = zeros[lo], zeros[hi], zeros[-1]
            count += np.where(one, zhi - zlo, 0)
            lo = np.where(one, total + lo - zlo, zlo)
            hi = np.where(one, total + hi - zhi, zhi)
        return count

    def nth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value with k smaller ones in its range."""
        value = np.zeros(len(lo), np.int64)
        for level, zeros in enumerate(self.zeros):
            zlo, zhi, total = zeros[lo], zeros[hi], zeros[-1]
            inside = zhi - zlo
            one = k >= inside
            k = np.where(one, k - inside, k)
            value |= one.astype(np.int64) << (self.bits - 1 - level)
            lo = np.where(one, total + lo - zlo, zlo)
            hi = np.where(one, total + hi - zhi, zhi)
        return value

    def neighbours(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, far: int) -> tuple[np.ndarray, np.ndarray]:
        """For x among the values of its range: the next larger and the next smaller one; ``far`` past it where there is none."""
        k = self.below(lo, hi, x)
        larger, smaller = x + far, x - far
        for out, has, step in ((larger, k + 1 < hi - lo, 1), (smaller, k > 0, -1)):
            at = np.flatnonzero(has)
            out[at] = self.nth(lo[at], hi[at], k[at] + step)
        return larger, smaller


def _extended(seq: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The stretches [a, b) of period d made as long as they keep it."""
    n, steps = len(seq), np.arange(width)
    for edge, sign in ((b, 1), (a, -1)):
        live = np.arange(len(edge))
        while len(live):
            at = edge[live][:, None] + (steps if sign > 0 else -1 - steps)
            other = at - sign * d[live][:, None]
            same = (at >= 0) & (at < n)
            same &= seq[np.clip(at, 0, n - 1)] == seq[np.clip(other, 0, n - 1)]
            whole = same.all(1)
            edge[live] += sign * np.where(whole, width, same.argmin(1))
            live = live[whole]
    return a, b


def runs_of(seq: np.ndarray, longest: int, options: Runs = Runs()) -> np.ndarray:
    """Rows (start, end, period) of all runs of a sequence whose stretches without a unique symbol have at most ``longest``."""
    none = np.empty((0, 3), np.int64)
    levels = 1
    while (2 << (levels + 1)) - 1 <= longest:
        levels += 1
    if longest < options.min_length or options.min_exponent < 4:
        if options.min_exponent < 4:
            raise ValueError("the blocks find runs of four periods and more")
        return none
    n = len(seq)
    order, place, differs = suffix_order(seq, levels)
    tree, found = None, [none]
    for level in range(1, levels + 1):
        width = 1 << level
        at = np.arange(0, n - width + 1, width)
        first = differs <= level
        group = np.cumsum(first) - 1
        borders = np.append(np.flatnonzero(first), n)
        own = group[place[at]]
        lo, hi = borders[own], borders[own + 1]
        several = hi - lo > 1
        if not several.any():
            break  # no block of this length occurs twice, so no longer one does
        at, lo, hi = at[several], lo[several], hi[several]
        tree = tree or WaveletTree(order, n - 1)
        larger, smaller = tree.neighbours(lo, hi, at, 2 * width)
        least = width // 2 if level > 1 else 0
        after, before = larger - at, at - smaller
        right = (after > least) & (after <= width)
        left = (before > least) & (before <= width)
        a = np.concatenate([at[right], smaller[left]])
        d = np.concatenate([after[right], before[left]])
        if not len(a):
            continue
        by = np.lexsort((a, d))
        a, d = a[by], d[by]
        b = a + width + d
        apart = np.ones(len(a), bool)
        apart[1:] = (d[1:] != d[:-1]) | (a[1:] + d[1:] > b[:-1])
        heads = np.flatnonzero(apart)
        a, d, b = a[heads], d[heads], b[np.append(heads[1:], len(b)) - 1]
        a, b = _extended(seq, a, b, d, width)
        long = b - a >= np.maximum(options.min_length, options.min_exponent * d)
        found.append(np.stack([a, b, d], 1)[long])
    return np.unique(np.concatenate(found), axis=0)


@dataclass
class Part:
    """Some consecutive texts: their bytes, the word each place shows, borders of places by text, and the runs by text."""

    texts: list[bytes]
    shown: np.ndarray
    cuts: np.ndarray
    runs: list[np.ndarray]


def parts(column: pa.Array, shows, options: Runs) -> Iterator[Part]:
    """The texts of a column in runs of at most BLOCK bytes, or one longer text alone. ``shows(i, n)`` gives the number of the
    word that each of the n places of text i shows, or None for its own."""
    data, bounds = flat(column)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK, "right")) - 1))
        own = bounds[i:j + 1]
        starts, ends, cuts = word_borders(data, own)
        lo, hi = int(own[0]), int(own[-1])
        inside = np.zeros(hi - lo + 1, np.int8)
        inside[starts - lo] += 1
        inside[ends - lo] -= 1
        packed = data[lo:hi][np.cumsum(inside[:-1], dtype=np.int8) > 0]
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
        codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        shown = np.arange(len(codes))
        for t in range(j - i):
            c0, c1 = int(cuts[t]), int(cuts[t + 1])
            if (other := shows(i + t, c1 - c0)) is not None:
                shown[c0:c1] = c0 + other
        sizes = np.diff(cuts)
        text = np.repeat(np.arange(j - i), sizes)
        seq = np.empty(len(codes) + j - i, np.int64)
        seq[np.arange(len(codes)) + text] = codes[shown]
        seq[cuts[1:] + np.arange(j - i)] = len(codes) + np.arange(j - i)
        found = runs_of(seq, int(sizes.max(initial=0)), options)
        holder = np.searchsorted(cuts[1:] + np.arange(j - i), found[:, 0], "right")
        found[:, :2] -= (cuts[holder] + holder)[:, None]
        found = found[np.lexsort((found[:, 2], found[:, 0], holder))]
        split = np.searchsorted(np.sort(holder), np.arange(j - i + 1))
        yield Part([data[int(own[t]):int(own[t + 1])].tobytes() for t in range(j - i)], shown, cuts,
                   [found[split[t]:split[t + 1]] for t in range(j - i)])
        i = j


def collapsed(text: bytes, shown: np.ndarray | None, runs: np.ndarray) -> bytes:
    """The words of a text, one blank between, without those that a run repeats after its first period."""
    words = text.split()
    if shown is not None:
        words = [words[k] for k in shown.tolist()]
    if len(runs):
        steps = np.zeros(len(words) + 1, np.int64)
        np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
        np.add.at(steps, runs[:, 1], -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
    return b" ".join(words)


def _mapped(docs: DataFrame, text: str, ddl: str, keep: list[str], shows, make, options: Runs) -> DataFrame:
    def columns(batch: pa.RecordBatch) -> list[tuple]:
        rows, first = [], 0
        pick = shows(batch) if shows else lambda i, n: None
        for part in parts(batch.column(batch.num_columns - 1), pick, options):
            for t, body in enumerate(part.texts):
                c0, c1 = int(part.cuts[t]), int(part.cuts[t + 1])
                own = None if pick(first + t, c1 - c0) is None else part.shown[c0:c1] - c0
                rows.append(make(body, own, part.runs[t]))
            first += len(part.texts)
        return list(zip(*rows))

    return with_columns_of(docs, text, ddl, columns, keep)


def periodic_runs(docs: DataFrame, text: str = "text", options: Runs = Runs(), keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``runs``, the list of all runs of each text, and ``collapsed_text``."""
    def make(body: bytes, shown: np.ndarray | None, runs: np.ndarray) -> tuple:
        return [{"start": int(a), "length": int(b - a), "period": int(q)} for a, b, q in runs], collapsed(body, shown, runs)

    made = _mapped(docs, text, f"runs {RUNS}, collapsed_text binary", docs.columns if keep is None else keep, None, make, options)
    return made.withColumn("collapsed_text", made.collapsed_text.cast("string"))


def planted(batch: pa.RecordBatch):
    """The repetition that the query's texts get: for ids whose checksum is divisible by ten, from word a on with period p."""
    ids = batch.column(0).to_pylist()

    def shows(i: int, n: int) -> np.ndarray | None:
        if ids[i] is None or n == 0:
            return None
        h = zlib.crc32(str(ids[i]).encode())
        if h % 10:
            return None
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        k = np.arange(n)
        return np.where(k >= a, a + (k - a) % p, k)

    return shows


def run_report(docs: DataFrame, options: Runs = Runs()) -> DataFrame:
    """The columns of the query: one row per document. A null id has no checksum, so its text stays as it is."""
    def make(body: bytes, shown: np.ndarray | None, runs: np.ndarray) -> tuple:
        lengths = runs[:, 1] - runs[:, 0]
        best = (None,) * 4
        if len(runs):
            k = np.lexsort((runs[:, 2], runs[:, 0], -lengths))[0]
            best = (int(runs[k, 0]), int(lengths[k]), int(runs[k, 2]), 1000 * int(lengths[k]) // int(runs[k, 2]))
        lines = "".join(f"{a},{size},{q}\n" for (a, _, q), size in zip(runs.tolist(), lengths.tolist()))
        return (len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(body, shown, runs)).hexdigest())

    return _mapped(docs.select("doc_id", "text"), "text", DDL, ["doc_id"], planted, make, options)
