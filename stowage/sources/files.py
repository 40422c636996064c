"""Python data sources for what Spark has no reader for: file trees with inodes, and SQLite tables."""

from __future__ import annotations

import os
import sqlite3
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH = 5_000
TREE = "root string, relpath binary, size bigint, ino bigint, dev bigint, blocks bigint, mtime_ns bigint, ctime_ns bigint, warning string"
_TREE = pa.schema([("root", pa.string()), ("relpath", pa.binary()), ("size", pa.int64()), ("ino", pa.int64()), ("dev", pa.int64()), ("blocks", pa.int64()), ("mtime_ns", pa.int64()), ("ctime_ns", pa.int64()), ("warning", pa.string())])


class _Folder(InputPartition):
    def __init__(self, root: str, folder: bytes, deep: bool):
        self.root, self.folder, self.deep = root, folder, deep


class TreeSource(DataSource):
    """format("stowage_tree"): the regular files under `path`, one partition per folder at the top.

    Links are never followed. Folders named in `prune` (separated by `:`) are passed over. What can't be read is a row with a
    warning instead of values. Folders must be reachable from all executors.
    """

    @classmethod
    def name(cls) -> str:
        return "stowage_tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> DataSourceReader:
        return _TreeReader(self.options)


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.roots = [p for p in options["path"].split(os.pathsep) if p]
        self.prune = {p.encode() for p in options.get("prune", "").split(":") if p}

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for root in self.roots:
            top = os.fsencode(root)
            parts.append(_Folder(root, top, False))
            try:
                with os.scandir(top) as entries:
                    parts += [_Folder(root, e.path, True) for e in sorted(entries, key=lambda e: e.name) if e.is_dir(follow_symlinks=False) and e.name not in self.prune]
            except OSError:
                pass  # the partition of the root itself reports it
        return parts

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        top, todo = os.fsencode(partition.root), [partition.folder]
        while todo:
            folder = todo.pop()
            try:
                with os.scandir(folder) as entries:
                    for e in sorted(entries, key=lambda e: e.name):
                        try:
                            info = e.stat(follow_symlinks=False)
                        except OSError as error:
                            rows.append((partition.root, os.path.relpath(e.path, top), *[None] * 6, str(error)))
                            continue
                        if stat.S_ISDIR(info.st_mode):
                            if partition.deep and e.name not in self.prune:
                                todo.append(e.path)
                        elif stat.S_ISREG(info.st_mode):
                            rows.append((partition.root, os.path.relpath(e.path, top), info.st_size, info.st_ino, info.st_dev, info.st_blocks, info.st_mtime_ns, info.st_ctime_ns, None))
            except OSError as error:
                rows.append((partition.root, os.path.relpath(folder, top), *[None] * 6, str(error)))
            if len(rows) >= BATCH:
                yield _batch(rows, _TREE)
                rows = []
        if rows:
            yield _batch(rows, _TREE)


class SqliteSource(DataSource):
    """format("stowage_sqlite"): the rows of a read-only query over a SQLite file; options path, query and columns (a schema)."""

    @classmethod
    def name(cls) -> str:
        return "stowage_sqlite"

    def schema(self) -> str:
        return self.options["columns"]

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(self.options)


class _SqliteReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.query = options["path"], options["query"]

    def read(self, partition) -> Iterator[tuple]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as con:
            yield from con.execute(self.query)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def file_tree(spark: SparkSession, *roots: str, prune: str = "") -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("stowage_tree").option("path", os.pathsep.join(roots)).option("prune", prune).load()


def sqlite_rows(spark: SparkSession, path: str, query: str, columns: str) -> DataFrame:
    spark.dataSource.register(SqliteSource)
    return spark.read.format("stowage_sqlite").option("path", path).option("query", query).option("columns", columns).load()
