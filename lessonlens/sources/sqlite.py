"""Lesson stores kept as SQLite files, read as a Spark data source: ``spark.read.format("lesson_sqlite")``.

Options: ``paths`` (comma-separated files), ``table``, and ``rows`` per input partition. A file is cut into ranges of row
ids, so that one large store is read by many tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lessonlens.schemas import DDL
from lessonlens.sources.files import check_distinct_stores

ROWS_PER_PARTITION = 1_000_000


class RowRange(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


def _open(path: str):
    import pathlib
    import sqlite3
    return sqlite3.connect(pathlib.Path(path).resolve().as_uri() + "?mode=ro", uri=True)


def _dataset(path: str) -> str:
    """The lesson folder above ``db/dataset.sqlite``, or the file's own name."""
    parts = path.rstrip("/").split("/")
    return parts[-3] if len(parts) > 2 and parts[-2] == "db" else parts[-1].rsplit(".", 1)[0]


class StoreReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema = schema
        self.paths = [p.strip() for p in options["paths"].split(",") if p.strip()]
        self.table = options["table"]
        self.rows = int(options.get("rows", ROWS_PER_PARTITION))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            with _open(path) as con:
                low, high = con.execute(f'SELECT MIN(rowid), MAX(rowid) FROM "{self.table}"').fetchone()
            if low is not None:
                out += [RowRange(path, a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)]
        return out or [RowRange(self.paths[0], 1, 0)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        import datetime
        kinds = {f.name: f.dataType.typeName() for f in self.schema.fields}

        def value(name, v):
            if v is None:
                return None
            if kinds[name] == "timestamp":
                return datetime.datetime.fromisoformat(v)
            if kinds[name] == "boolean":
                return bool(v)
            return float(v) if kinds[name] == "double" else str(v) if kinds[name] == "string" else int(v)

        with _open(partition.path) as con:
            have = {r[1] for r in con.execute(f'PRAGMA table_info("{self.table}")')}
            names = [f.name for f in self.schema.fields]
            picked = ", ".join(f'"{n}"' if n in have else "NULL" for n in names)
            cursor = con.execute(f'SELECT {picked} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high))
            dataset = _dataset(partition.path)
            for row in cursor:
                yield tuple(dataset if n == "dataset_id" else value(n, v) for n, v in zip(names, row))


class LessonStores(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lesson_sqlite"

    def schema(self) -> str:
        return DDL[self.options["table"]]

    def reader(self, schema: StructType) -> StoreReader:
        return StoreReader(schema, dict(self.options))


def read_stores(spark: SparkSession, paths: list[str], table: str, rows: int = ROWS_PER_PARTITION) -> DataFrame:
    """One table of many stores; absent columns are NULL, and a store listed twice is an error."""
    spark.dataSource.register(LessonStores)
    paths = check_distinct_stores(paths)
    return spark.read.format("lesson_sqlite").option("paths", ",".join(paths)).option("table", table).option("rows", rows).load()


cloudpickle.register_pickle_by_value(sys.modules[__name__])
