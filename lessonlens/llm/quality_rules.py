"""Quality rules by compression bands.

Repetitive text compresses far below, and random text far above, what prose of its length does. A text is rejected when
the zstandard ratio of the whole text leaves the band of its length, or when more than ``max_bad_chunks`` of its bytes
lie in chunks that leave their band: the chunk band for chunks of full size, the band of its length for what is left at
the end. Two plain rules come before: too few words, and too many repeated word windows.

Defined cases: a null text counts as empty; an empty text has zero words and fails the base rule; equal rows get equal
verdicts, each row its own; the text is read whole whatever its length (memory: a few times the longest text of a batch);
an empty table gives an empty result; input columns called like a result column give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from lessonlens.llm.batches import named, with_text_columns, without
from lessonlens.llm.words import Block, blocks, by_text, covered, fingerprints, rolling, window_mask

DDL = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
       "ratio double, bad_chunks long, n_chunks long, kept boolean")
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Bands:
    """``limits``: (texts below so many bytes, lowest ratio, highest ratio), the last without end.

    A zstandard frame has a fixed cost, so short texts have high ratios; and long texts share more with themselves, so
    their ratios are lower. The ceilings lie between the highest ratio of the good documents of a length in the generated
    table (0.89 at 100 bytes, 0.62 at 800, 0.52 at 2,048, 0.44 at 12,800) and the lowest of random base-64 words with
    blanks (1.00, 0.76, 0.73, 0.72). Below 100 bytes noise does not stand out, and the ceiling does not bind.
    """

    limits: tuple[tuple[float, float, float], ...] = (
        (100, 0.30, 3.0), (130, 0.42, 0.94), (160, 0.42, 0.91), (200, 0.42, 0.915), (250, 0.42, 0.86), (300, 0.42, 0.82), (400, 0.42, 0.80),
        (500, 0.36, 0.77), (650, 0.36, 0.75), (800, 0.36, 0.725), (1000, 0.36, 0.70), (1300, 0.36, 0.68), (1600, 0.36, 0.66),
        (2048, 0.30, 0.645), (3200, 0.30, 0.63), (6400, 0.30, 0.62), (12800, 0.24, 0.60), (float("inf"), 0.24, 0.58))
    chunk_bytes: int = 2048
    chunk_limits: tuple[float, float] = (0.28, 0.63)
    max_bad_chunks: float = 0.2
    level: int = 3
    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8


def repeat_words(block: Block, width: int) -> np.ndarray:
    """Words of each text that lie in a window of ``width`` words found twice or more in that text."""
    n = len(block.hashes)
    whole = window_mask(block.cuts, width, n)
    at = np.flatnonzero(whole)
    windows = rolling(block.hashes, width)[at]
    text = np.searchsorted(block.cuts, at, "right") - 1
    order = np.lexsort((windows, text))
    w, t = windows[order], text[order]
    same = np.zeros(len(w) + 1, bool)
    same[1:-1] = (w[1:] == w[:-1]) & (t[1:] == t[:-1])
    twice = at[order[same[:-1] | same[1:]]]
    return by_text(covered(twice, width, n), block.cuts)


def duplicate_lines(block: Block) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lo, hi = int(block.bounds[0]), int(block.bounds[-1])
    border = np.zeros(hi - lo + 1, bool)
    breaks = np.flatnonzero(block.data[lo:hi] == 10)
    border[breaks + 1] = True
    border[np.unique(block.bounds - lo)] = True
    edges = np.flatnonzero(border) + lo
    starts, ends = edges[:-1], edges[1:]
    if not len(starts):
        return np.zeros(block.size, np.int64)
    ends = ends - (block.data[ends - 1] == 10)
    first_word = np.searchsorted(block.starts, starts)
    full = first_word < np.searchsorted(block.starts, ends)
    starts, ends = starts[full], ends[full]
    text = np.searchsorted(block.bounds, starts, "right") - 1
    marks = fingerprints(block.data, starts, ends)
    order = np.lexsort((marks, text))
    m, t = marks[order], text[order]
    again = (m[1:] == m[:-1]) & (t[1:] == t[:-1])
    return np.bincount(t[1:][again], minlength=block.size).astype(np.int64)


def quality_columns(column: pa.Array, bands: Bands) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {f.split()[0]: [] for f in DDL.split(", ")}
    zip_one = zstandard.ZstdCompressor(level=bands.level).compress
    edges = np.array([b for b, _, _ in bands.limits])
    low, high = (np.array([x[i] for x in bands.limits]) for i in (1, 2))
    for b in blocks(column):
        lo, hi = int(b.bounds[0]), int(b.bounds[-1])
        n_words = np.diff(b.cuts)
        inside = np.zeros(hi - lo + 1, np.int8)
        inside[b.starts - lo] += 1
        inside[b.ends - lo] -= 1
        piece = b.data[lo:hi]
        chars = (np.cumsum(inside[:-1], dtype=np.int8) > 0) & ((piece & 0xC0) != 0x80)
        repeats = repeat_words(b, bands.window)
        sizes = np.diff(b.bounds)
        ratio, bad, chunks, bad_bytes = np.ones(b.size), *np.zeros((3, b.size), np.int64)
        band = np.searchsorted(edges, sizes, "right")
        floor, ceiling = bands.chunk_limits
        for i in np.flatnonzero(sizes):
            text = b.data[int(b.bounds[i]):int(b.bounds[i + 1])].tobytes()
            ratio[i] = len(zip_one(text)) / len(text)
            for at in range(0, len(text), bands.chunk_bytes):
                part = text[at:at + bands.chunk_bytes]
                r = len(zip_one(part)) / len(part) if len(part) < len(text) else ratio[i]
                k = int(np.searchsorted(edges, len(part), "right"))
                fine = floor <= r <= ceiling if len(part) == bands.chunk_bytes else low[k] <= r <= high[k]
                chunks[i] += 1
                bad[i] += not fine
                bad_bytes[i] += 0 if fine else len(part)
        failed = (n_words < bands.min_words) | (100 * repeats > bands.max_repeat_percent * n_words)
        fits = (low[band] <= ratio) & (ratio <= high[band]) & (bad_bytes <= bands.max_bad_chunks * sizes)
        made = (n_words, by_text(chars, b.bounds - lo), by_text(SYMBOL[piece], b.bounds - lo), duplicate_lines(b), repeats,
                failed, ratio, bad, chunks, ~failed & fits)
        for values, out in zip(made, parts.values()):
            out.append(values)
    kinds = {"base_failed": bool, "kept": bool, "ratio": float}
    return {k: np.concatenate(v) if v else np.empty(0, kinds.get(k, np.int64)) for k, v in parts.items()}


def quality_verdicts(docs: DataFrame, text: str = "text", bands: Bands = Bands(), keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the statistics, the compression figures and the verdict ``kept``."""
    return with_text_columns(docs, text, DDL, lambda column: quality_columns(column, bands), keep)


def keep_good(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``; one pass, no shuffle."""
    mark = "kept"
    while mark in (c.lower() for c in docs.columns):
        mark += "_"
    judged = with_text_columns(docs, text, f"`{mark}` boolean", lambda c: {mark: quality_columns(c, bands)["kept"]})
    return judged.where(named(mark)).select(*[named(c) for c in without(docs, [mark])])


def quality_report(docs: DataFrame) -> DataFrame:
    """The columns of the query: one row per document."""
    made = quality_verdicts(docs.select("doc_id", "text"), keep=["doc_id"])
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                       F.round("ratio", 6).alias("ratio"), "bad_chunks", "n_chunks")
