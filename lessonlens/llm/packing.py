"""Best-fit packing of token sequences.

Every document becomes its ids and an end id; only documents longer than a sequence are cut. The pieces are dealt evenly
over shards of about ``shard_pieces``; in a shard they are placed longest first, each into the fullest open sequence that
still has room (best-fit decreasing). A segment tree over the remaining capacities, which counts the open sequences below
each node, finds the tightest one in logarithmic time. A shard leaves at most a few sequences half full, so the result is
within a fraction of a per cent of packing all pieces together.

Defined cases: a null text is empty and gives one piece with the end id alone; null ids and repeated rows are packed like
any others, each row its own; a text of any length is read whole; an empty table gives an empty result; further columns
are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lessonlens.llm.batches import schema_of
from lessonlens.llm.tokenizing import WordIds, vocabulary
from lessonlens.session import cut_lineage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SLICE = 256


@dataclass(frozen=True)
class Packing:
    capacity: int = 2048
    end_id: int = 0
    vocabulary: str = "word_bpe_49k.json"
    shard_pieces: int = 16384


class OpenSequences:
    """Open sequences by remaining capacity, with a segment tree that counts them."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.base)
        self.stacks: list[list[int]] = [[] for _ in range(self.base)]

    def put(self, room: int, sequence: int) -> None:
        self.stacks[room].append(sequence)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The least room that holds ``length`` and a sequence with it, which is removed."""
        tree, node = self.tree, self.base + length
        while not tree[node]:
            while node & 1:
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.base:
            node *= 2
            if not tree[node]:
                node += 1
        room = node - self.base
        self._add(room, -1)
        return room, self.stacks[room].pop()

    def _add(self, room: int, by: int) -> None:
        node = self.base + room
        while node:
            self.tree[node] += by
            node >>= 1


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence number and offset of every length; lengths must fall."""
    opened, used = OpenSequences(capacity), 0
    sequences, offsets = [], []
    for length in lengths:
        found = opened.take(length)
        if found is None:
            room, sequence = capacity, used
            used += 1
        else:
            room, sequence = found
        sequences.append(sequence)
        offsets.append(capacity - room)
        if room > length:
            opened.put(room - length, sequence)
    return sequences, offsets


def token_pieces(docs: DataFrame, packing: Packing) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    names = [f.split()[0] for f in PIECES.split(", ")]
    end = np.array([packing.end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds.of(vocabulary(packing.vocabulary))
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out: list[list] = [[] for _ in names]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = words.ids(text or "") + end
                    for piece, start in enumerate(range(0, len(ids) // 4, packing.capacity)):
                        own = ids[4 * start:4 * (start + packing.capacity)]
                        for column, value in zip(out, (doc_id, piece, start, len(own) // 4, zlib.crc32(own))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.int32() if n == "piece" else pa.int64()) for n, v in zip(names, out)], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, packing: Packing = Packing()) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``."""
    pieces = cut_lineage(token_pieces(docs, packing))
    shards = -(-pieces.count() // packing.shard_pieces) or 1
    dealt = pieces.withColumn("shard", F.expr(f"pmod(monotonically_increasing_id() + (monotonically_increasing_id() >> 33), {shards})"))

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sequences, offsets = best_fit(group["length"].to_pylist(), packing.capacity)
        shard = group["shard"][0].as_py() << 32
        return (group.drop_columns("shard").append_column("sequence_id", pa.array([shard + q for q in sequences], pa.int64()))
                .append_column("offset", pa.array(offsets, pa.int64())))

    return dealt.groupBy("shard").applyInArrow(place, schema_of(PIECES + ", sequence_id long, offset long"))
