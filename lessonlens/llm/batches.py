"""Helpers that run a function over Arrow batches of a text column and keep the other columns as they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

SLICE_BYTES = 1 << 22


def named(name: str) -> Column:
    """A column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of ``df`` except those called like one of ``names`` in any letter case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def numbered(df: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """``df`` with numbers for the names of all columns but ``known``, so that no name can clash with one inside an operator.
    ``out.toDF(*df.columns)`` gives the names back."""
    return df.toDF(*[c if c in known else f"x{i}" for i, c in enumerate(df.columns)])


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most SLICE_BYTES of column ``at``, or of one longer value: what a worker holds of its results
    does not depend on the size of batches."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False)
        ends, begin = np.cumsum(sizes, dtype=np.int64), 0
        while begin < batch.num_rows:
            done = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def with_text_columns(df: DataFrame, text: str, ddl: str, compute: Callable[[pa.Array], dict[str, object]],
                      keep: list[str] | None = None) -> DataFrame:
    """``df`` with the columns of ``ddl`` that ``compute`` makes from the text column's UTF-8 bytes, batch by batch.

    ``keep`` names the columns to carry along (all by default). A carried column called like a new one gives way to it.
    """
    added = schema_of(ddl)
    carried = [c for c in without(df, added.names) if keep is None or c in keep]
    source = df.select(*[named(c).cast("binary").alias(c) if c == text else named(c) for c in carried],
                       *([] if text in carried else [named(text).cast("binary").alias(text)]))
    out = StructType([source.schema[c] for c in carried] + added.fields)
    at = source.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            made = compute(batch.column(at))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(carried))] + [pa.array(made[f.name]) for f in added.fields],
                names=carried + added.names)

    result = source.mapInArrow(run, out)
    return result.select(*[named(c).cast("string").alias(c) if c == text else named(c) for c in carried],
                         *[named(c) for c in added.names])


def with_columns_of(df: DataFrame, text: str, ddl: str, make: Callable[[pa.RecordBatch], list[object]], keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with the columns of ``ddl``; ``make`` gets batches whose last column is the text in UTF-8.

    Inside, columns have numbers for names, so no name of the input can clash or need quoting. A carried column called like a
    new one gives way to it.
    """
    added = schema_of(ddl)
    carried = [c for c in without(df, added.names) if keep is None or c in keep]
    at = len(carried)
    source = df.select(*[named(c).alias(f"c{i}") for i, c in enumerate(carried)], named(text).cast("binary").alias("text"))
    out = StructType([StructField(f"c{i}", source.schema[i].dataType) for i in range(at)]
                     + [StructField(f"m{j}", f.dataType) for j, f in enumerate(added.fields)])
    kinds = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            made = make(batch)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], *[v if isinstance(v, pa.Array) else pa.array(v, kind) for v, kind in zip(made, kinds)]], names=out.names)

    return source.mapInArrow(run, out).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)],
                                              *[F.col(f"m{j}").alias(f.name) for j, f in enumerate(added.fields)])
