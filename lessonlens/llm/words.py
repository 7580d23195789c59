"""Words, lines and their 64-bit fingerprints, computed for a whole Arrow batch of texts at once.

Words are maximal runs of bytes other than space and 0x09-0x0D, which in UTF-8 are exactly the runs of code points other
than those. A fingerprint is the polynomial of the bytes modulo 2**64 with a final mix; equal fingerprints are taken as
equal texts. It depends on nothing but the bytes, so all executors and all reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE_VALUES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base % 2**64)
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of BASE and of its inverse up to BLOCK, made when first needed in a worker."""

    up: np.ndarray | None = None
    down: np.ndarray | None = None

    @classmethod
    def get(cls) -> tuple[np.ndarray, np.ndarray]:
        if cls.up is None:
            cls.up = powers(int(BASE), BLOCK + 1)
            cls.down = powers(pow(int(BASE), -1, 2**64), BLOCK + 1)
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def _long_fingerprint(part: np.ndarray) -> np.uint64:
    up, _ = _Powers.get()
    total, factor = np.uint64(0), 1
    for lo in range(0, len(part), BLOCK):
        piece = part[lo:lo + BLOCK]
        total = total + (BYTE_VALUES[piece] * up[:len(piece)]).sum(dtype=np.uint64) * np.uint64(factor)
        factor = factor * pow(int(BASE), len(piece), 2**64) % 2**64
    return total


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprint of every segment ``data[start:end]``; segments are in order and do not overlap."""
    up, down = _Powers.get()
    out = np.empty(len(starts), np.uint64)
    k = 0
    with np.errstate(over="ignore"):
        while k < len(starts):
            lo = int(starts[k])
            m = int(np.searchsorted(ends, lo + BLOCK, "right"))
            if m <= k:
                out[k] = _long_fingerprint(data[lo:int(ends[k])])
                k += 1
                continue
            hi = int(ends[m - 1])
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(BYTE_VALUES[data[lo:hi]] * up[:hi - lo], out=sums[1:])
            s, e = starts[k:m] - lo, ends[k:m] - lo
            out[k:m] = (sums[e] - sums[s]) * down[s]
            k = m
        return mix(out + (ends - starts).astype(np.uint64) * MIX)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of every window of ``width`` consecutive hashes (length ``n - width + 1``, empty if n is smaller)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        doubled, size, out, have = hashes, 1, None, 0
        while True:
            if width & size:
                if out is None:
                    out = doubled
                else:
                    m = min(len(doubled), len(out) - size)
                    out = doubled[:m] * np.uint64(pow(int(BASE), have, 2**64)) + out[size:size + m]
                have += size
            if size * 2 > width:
                return mix(out[:n])
            factor = np.uint64(pow(int(BASE), size, 2**64))
            doubled, size = doubled[:-size] * factor + doubled[size:], size * 2


@dataclass
class Block:
    """Some consecutive texts of a batch. ``cuts[i]:cuts[i+1]`` are the words of text ``first + i``."""

    first: int
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    cuts: np.ndarray

    @property
    def size(self) -> int:
        return len(self.bounds) - 1


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text borders of a binary column; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, borders, data = column.buffers()
    bounds = np.frombuffer(borders, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64) if borders else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), bounds


def word_borders(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends of all words in ``data[bounds[0]:bounds[-1]]`` and the index of each text's first word."""
    lo, hi = int(bounds[0]), int(bounds[-1])
    gap = SPACE[data[lo:hi]]
    first = np.empty(hi - lo + 1, bool)
    first[0] = True
    first[1:] = gap
    first[np.unique(bounds - lo)] = True
    starts = np.flatnonzero(first[:-1] & ~gap)
    last = np.empty(hi - lo + 1, bool)
    last[:-1] = gap
    last[-1] = True
    last[np.unique(bounds - lo)] = True
    ends = np.flatnonzero(last[1:] & ~gap) + 1
    return starts + lo, ends + lo, np.searchsorted(starts, bounds - lo)


def blocks(column: pa.Array) -> Iterator[Block]:
    """The texts of a column in runs of at most BLOCK bytes, or one longer text alone."""
    data, bounds = flat(column)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + BLOCK, "right")) - 1)
        j = min(j, n)
        own = bounds[i:j + 1]
        starts, ends, cuts = word_borders(data, own)
        yield Block(i, data, own, starts, ends, fingerprints(data, starts, ends), cuts)
        i = j


def window_mask(cuts: np.ndarray, width: int, n: int) -> np.ndarray:
    """True where a window of ``width`` words that starts at a word stays in its text; length ``max(0, n - width + 1)``."""
    m = max(0, n - width + 1)
    if not m:
        return np.zeros(0, bool)
    ends = np.repeat(cuts[1:], np.diff(cuts))
    return np.arange(m) + width <= ends[:m]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """True for every word inside a window of ``width`` words beginning at one of ``starts``."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, np.minimum(starts + width, n), -1)
    return np.cumsum(steps[:-1]) > 0


def by_text(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sum of the values of each text, ``cuts`` being the borders."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[cuts[1:]] - sums[cuts[:-1]]
