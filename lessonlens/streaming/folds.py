"""Per-key state on a stream: a small step function folded over a key's rows in time order.

A stream carries two times: ``t``, the seconds since its lesson began, which the steps work with, and ``at``, the instant
on a clock that all lessons share, which the watermark and the timers follow. Lessons may begin at any time; a row is late
only when its instant is, and late rows are counted (``live.LateRows``).

Rows come in any order within the watermark's delay. A key's rows wait in its state until the watermark has passed their
instant, when no earlier row can come any more; then they are folded in time order. So the result does not depend on how
rows fall into micro-batches, and a key holds as many waiting rows as the delay spans.

State is typed: each step names the type of its own state, and waiting rows have the columns the step reads. What is kept of
a key is small, and a call to the state store costs far more than a fold over a few rows, so keys are dealt to a fixed number
of cells by their hash, and a cell's keys are read and written together, once per batch. Waiting rows lie in the store in
pieces: what comes is sorted in runs of about ``RUN`` values and cut into pieces of about ``PIECE``, and once rows are due the
pieces are merged, each opened when its first row is reached. So a task holds a run or a few pieces, however many rows wait,
and results leave it as they are found. A key is forgotten once it has been silent for longer than its time to live.
"""

from __future__ import annotations

import heapq
import pickle
import sys
from collections.abc import Callable, Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

LATE_DELAY = "10 seconds"
# Silence after which a key that has no shorter time to live is forgotten: no lesson pauses for a day.
LESSON_TTL = 86_400.0
DUE, AT, CELL = "__due", "__at", "__cell"
# Cells of keys over all tasks; part of a stream's state, so it stays as it is for the life of a checkpoint.
CELLS = 1024
CLOCK = ("1678-01-01 00:00:00", "2262-01-01 00:00:00")
# Values (the rows, and the elements of their arrays) that are sorted at once, that lie together in the store and that leave together.
RUN, PIECE, PAGE = 32_768, 2_048, 8_192


def _same(value):
    return value


def _plain(value):
    """Values as read, structs as tuples and arrays as lists: the state client writes no rows."""
    if isinstance(value, dict):
        return tuple([_plain(v) for v in value.values()])
    if isinstance(value, tuple):
        return tuple([_plain(v) for v in value])
    if hasattr(value, "tolist"):
        value = value.tolist()
    return [_plain(v) for v in value] if isinstance(value, list) else value


class StepFold(StatefulProcessor):
    """``step(state, row) -> (state, output dict or None)``; ``state`` is None on a new or expired key.

    ``step.state`` is the type of the state in DDL, ``step.reads`` names the columns that the step reads besides ``t``. A step
    with large states or rows has ``step.inside``: functions that open a state, work on an open one and close it; the columns
    ``step.arrays`` reach it as NumPy arrays, where a gap is no number. Kept per cell: when the next waiting row is due, when a timer will look for
    silent keys, the latest instant and the step's state of every key, and where the waiting rows lie: per piece its number, the
    first time at which a row of it is due and the place of its first row in the order.
    """

    def __init__(self, step: Callable, columns: Sequence[str], keys: Sequence[str], order: Sequence[str], ttl: float,
                 fields: Sequence[T.StructField]):
        self.opened, self.step, self.closed = getattr(step, "inside", (_same, step, _same))
        self.columns, self.ttl = list(columns), int(ttl * 1000)
        self.fields, self.keys = [f.name for f in fields], list(keys)
        place = self.fields.index
        self.due, self.at, self.order, self.key = place(DUE), place(AT), [place(c) for c in order], [place(c) for c in keys]
        self.nested = [i for i, f in enumerate(fields) if isinstance(f.dataType, T.ArrayType)]
        self.lists = [i for i in self.nested if fields[i].name not in getattr(step, "arrays", ())]
        inner = T.StructType.fromDDL(f"inner {step.state}")["inner"]
        known = T.StructType([T.StructField("key", T.StructType([fields[i] for i in self.key])), T.StructField("seen", T.LongType()), inner])
        self.schema = T.StructType([
            T.StructField("due", T.LongType()), T.StructField("expires", T.LongType()),
            T.StructField("known", T.ArrayType(known)), T.StructField("next", T.LongType()), T.StructField("pieces", T.BinaryType())])

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)
        self.pieces = handle.getMapState("pieces", "piece bigint", "rows binary")

    def _place(self, row: tuple) -> list:
        return [row[i] for i in self.order]

    def _weight(self, row: tuple) -> int:
        return 1 + sum([len(row[i]) for i in self.nested if row[i] is not None])

    def _read(self, frames) -> Iterator[tuple]:
        """The rows of pandas frames, whose gaps are marked by a number: pandas has none of its own for whole numbers."""
        for frame in frames:
            columns = [frame[f"c{i}"].tolist() for i in range(len(self.fields))]
            for i in self.lists:
                columns[i] = [_plain(v) for v in columns[i]]
            for row, gaps in zip(zip(*columns), frame["gaps"].tolist()):
                if gaps:
                    row = tuple([self._gap(v) if gaps >> i & 1 else v for i, v in enumerate(row)])
                yield row

    @staticmethod
    def _gap(value):
        """NULL, or a list with its gaps as NULL."""
        return [None if v != v else v for v in value] if isinstance(value, list) else None

    def _keep(self, piece: int, rows: list[tuple]) -> tuple:
        self.pieces.updateValue((piece,), (pickle.dumps(rows, pickle.HIGHEST_PROTOCOL),))
        return piece, min(r[self.due] for r in rows), self._place(rows[0])

    def _deal(self, run: list[tuple], piece: int) -> list[tuple]:
        """Keep a run in pieces, numbered from ``piece`` on."""
        run.sort(key=self._place)
        dealt, rows, weight = [], [], 0
        for row in run:
            rows.append(row)
            weight += self._weight(row)
            if weight >= PIECE:
                dealt.append(self._keep(piece + len(dealt), rows))
                rows, weight = [], 0
        return [*dealt, self._keep(piece + len(dealt), rows)] if rows else dealt

    def handleInputRows(self, key, rows, timerValues):
        due, expires, known, piece, dealt = _plain(self.held.get()) or (None, None, [], 0, None)
        dealt = pickle.loads(dealt) if dealt else []
        run, weight, before = [], 0, len(dealt)
        for row in self._read(rows):
            run.append(row)
            weight += self._weight(row)
            if weight >= RUN:
                new = self._deal(run, piece)
                dealt, piece, run, weight = dealt + new, piece + len(new), [], 0
        new = self._deal(run, piece)
        dealt, piece = dealt + new, piece + len(new)
        first = min((p[1] for p in dealt[before:]), default=None)
        if first is not None and (due is None or first < due):
            due = first
            self.handle.registerTimer(due)
        self.held.update((due, expires, known, piece, pickle.dumps(dealt)))
        return iter([])

    def _ready(self, dealt: list[tuple], now: int, rest: list[tuple]) -> Iterator[tuple]:
        """The rows that are due, in order; the places of all others are added to ``rest``."""
        rest.extend(p for p in dealt if p[1] > now)
        heap = [(first, piece, None, None) for piece, due, first in dealt if due <= now]
        heapq.heapify(heap)
        while heap:
            _, piece, row, more = heap[0]
            if more is None:
                rows = pickle.loads(self.pieces.getValue((piece,))[0])
                later = [r for r in rows if r[self.due] > now]
                if later:
                    rest.append(self._keep(piece, later))
                else:
                    self.pieces.removeKey((piece,))
                more = iter([r for r in rows if r[self.due] <= now])
            else:
                yield row
            row = next(more, None)
            if row is None:
                heapq.heappop(heap)
            else:
                heapq.heapreplace(heap, (self._place(row), piece, row, more))

    def _page(self, found: list[dict]):
        import numpy as np
        import pandas as pd
        page = {c: pd.Series([f[c] for f in found], dtype=object) for c in self.columns if c != "at"}
        if "at" in self.columns:
            page["at"] = pd.Series(np.array([f["at"] for f in found], "datetime64[us]")).dt.tz_localize("UTC")
        return pd.DataFrame(page)[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        stored = self.held.get()
        if stored is None:
            return
        now = timerValues.getCurrentWatermarkInMs()
        due, expires, known, piece, dealt = _plain(stored)
        if due is not None and due > now and (expires is None or expires > now):
            return  # the timer of rows that have been folded since
        held, open_ = {k: (seen, inner) for k, seen, inner in known}, {}
        out, weight, rest = [], 0, []
        for values in self._ready(pickle.loads(dealt) if dealt else [], now, rest):
            own = tuple([values[i] for i in self.key])
            seen, inner = held.get(own, (None, None))
            if seen is not None and values[self.due] - seen > self.ttl:
                inner = None  # silent for longer than its time to live: the key starts anew
                open_.pop(own, None)
            open_[own], result = self.step(open_[own] if own in open_ else self.opened(inner), dict(zip(self.fields, values)))
            held[own] = values[self.due], None
            if result is not None:
                out.append({**dict(zip(self.keys, own)), "at": values[self.at], **result})
                weight += 1 + sum([len(v) for v in result.values() if isinstance(v, list) or getattr(v, "ndim", 0)])
                if weight >= PAGE:
                    yield self._page(out)
                    out, weight = [], 0
        if out:
            yield self._page(out)
        if expires is not None and expires <= now:
            expires = None
        known = [(k, seen, self.closed(open_[k]) if k in open_ else inner) for k, (seen, inner) in held.items() if seen + self.ttl >= now]
        due = min((p[1] for p in rest), default=None)
        if due is None and not known:
            self.held.clear()
            return
        if due is not None:
            self.handle.registerTimer(due)
        if expires is None and known:
            expires = max(now, min(seen for _, seen, _ in known)) + self.ttl + 1
            self.handle.registerTimer(expires)
        self.held.update((due, expires, known, piece, pickle.dumps(sorted(rest, key=lambda p: p[0]))))

    def close(self) -> None:
        pass


def _without_gaps(field: T.StructField):
    """The column with a value in place of NULL, where pandas would turn NULL into another type."""
    empty = {"bigint": 0, "int": 0, "double": 0.0, "boolean": False}.get(field.dataType.simpleString())
    return F.col(field.name) if empty is None else F.coalesce(F.col(field.name), F.lit(empty).cast(field.dataType))


def _gap_mark(field: T.StructField):
    """Whether the value is NULL or, in an array of numbers, one of its elements is."""
    numbers = isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.NumericType)
    gap = F.col(field.name).isNull()
    return gap | F.coalesce(F.exists(field.name, lambda v: v.isNull()), F.lit(False)) if numbers else gap


def fold_stream(
    stream: DataFrame, keys: Sequence[str], step: Callable, schema: str, order: Sequence[str] = ("t",),
    ttl: float = LESSON_TTL, delay: str | None = LATE_DELAY,
) -> DataFrame:
    """Fold ``step`` over each key of a stream with the times ``t`` and ``at``; start it in ``keyed_state``.

    ``delay`` is None where ``at`` already has a watermark. With ``at`` in ``schema`` the result has one as well, for a
    stateful step behind it. Rows without an instant are left out, and so are those outside of ``CLOCK``: closing marks have
    moved the watermark by then, and pandas has no such times.
    """
    out = T.StructType.fromDDL(schema)
    names = [f.name for f in out.fields]
    d = stream if delay is None else stream.withWatermark("at", delay)
    # the first millisecond at which the watermark has passed the row
    d = d.where(F.col("at").between(*[F.lit(t).cast("timestamp") for t in CLOCK])).withColumn(DUE, F.ceil(F.unix_micros("at") / 1000).cast("bigint"))
    d = d.withColumn(AT, F.unix_micros("at"))
    waiting = {*keys, *order, "t", DUE, AT, *step.reads}
    plain = [T.StructField(f.name, f.dataType) for f in d.schema.fields if f.name in waiting]
    arrays = getattr(step, "arrays", ())
    processor = StepFold(step, names, keys, order, ttl, plain)
    gaps = F.lit(0).cast("bigint")
    for i, f in enumerate(plain):
        gaps = gaps + F.when(F.col(f.name).isNull() if f.name in arrays else _gap_mark(f), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    sent = d.select("at", *[_without_gaps(f).alias(f"c{i}") for i, f in enumerate(plain)], gaps.alias("gaps"),
                    F.pmod(F.xxhash64(*keys), F.lit(CELLS)).alias(CELL))
    return sent.groupBy(CELL).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime",
        eventTimeColumnName="at" if "at" in names else "")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
