"""A Spark data source that lists the files under a root of mounted shared storage.

``spark.read.format("lectern_files")`` gives one row for each file of the wanted suffixes, and one
row with an error for each folder or file that could not be looked at, so a scan that met errors
says so itself.  The root's folders are dealt to partitions, which walk their subtrees.  Links are
followed to files and folders inside the root, each folder only once, and a file that is reached by
several paths counts under its shallowest, first one.

A root that is missing or cannot be listed is an error, since an empty listing would retire
everything that was known.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lectern.functions import text as tx

SCHEMA = "source_path string, real_path string, modified double, length bigint, error string"
# Folders that are opened on the driver to find enough parts of the tree.
PARTS = 64
READ_AT_ONCE = 32


class FolderPart(InputPartition):
    """Folders to walk whole, and files and errors met on the way to them."""

    def __init__(self, folders: list[str], found: list[tuple]):
        self.folders, self.found = folders, found


class FilesReader(DataSourceReader):
    def __init__(self, root: str, suffixes: tuple[str, ...]):
        self.root, self.suffixes = root, suffixes
        self.real_root = os.path.realpath(root)

    def _outside(self, real: str) -> bool:
        return os.path.commonpath([real, self.real_root]) != self.real_root

    def _look(self, folder: str) -> tuple[list[str], list[tuple]]:
        """Folders and rows of one folder."""
        folders, rows = [], []
        try:
            with os.scandir(folder) as entries:
                listed = sorted(entries, key=lambda e: e.name)
        except OSError as error:
            return [], [(os.path.relpath(folder, self.root), None, None, None, f"{type(error).__name__}: {error.strerror}")]
        for entry in listed:
            path = os.path.join(folder, entry.name)
            shown = os.path.relpath(path, self.root)
            try:
                real = os.path.realpath(path, strict=True)
                if entry.is_symlink() and self._outside(real):
                    continue
                if os.path.isdir(real):
                    # A link to a folder on its own way down would lead round in a circle.
                    if not entry.is_symlink() or os.path.commonpath([real, os.path.realpath(folder)]) != real:
                        folders.append(path)
                elif entry.name.lower().endswith(self.suffixes):
                    state = os.stat(real)
                    rows.append((shown, real, state.st_mtime, state.st_size, None))
            except OSError as error:
                rows.append((shown, None, None, None, f"{type(error).__name__}: {error.strerror}"))
        return folders, rows

    def partitions(self):
        if not os.path.isdir(self.root):
            raise RuntimeError(f"source root is missing or unreadable: {self.root}")
        try:
            os.listdir(self.root)
        except OSError as error:
            raise RuntimeError(f"source root is missing or unreadable: {self.root}") from error
        waiting, found = [self.root], []
        for _ in range(PARTS):
            if not waiting or len(waiting) >= PARTS:
                break
            folders, rows = self._look(waiting.pop(0))
            waiting.extend(folders)
            found.extend(rows)
        return [FolderPart([], found), *[FolderPart([f], []) for f in waiting]]

    def read(self, partition: FolderPart):
        yield from partition.found
        waiting, seen = list(partition.folders), set()
        while waiting:
            folder = waiting.pop()
            real = os.path.realpath(folder)
            if real in seen:
                continue
            seen.add(real)
            folders, rows = self._look(folder)
            waiting.extend(folders)
            yield from rows


class FilesSource(DataSource):
    """Options: ``path``, and ``suffixes`` parted by commas."""

    @classmethod
    def name(cls) -> str:
        return "lectern_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FilesReader:
        suffixes = tuple(s.strip().lower() for s in self.options.get("suffixes", ".md").split(","))
        return FilesReader(self.options["path"], suffixes)


def list_files(spark: SparkSession, root: str, suffixes=(".md",)) -> DataFrame:
    """``source_path, real_path, modified, length, error``: each real file once, and the errors of the scan."""
    spark.dataSource.register(FilesSource)
    rows = spark.read.format("lectern_files").option("suffixes", ",".join(suffixes)).load(root)
    order = F.struct(tx.depth(F.col("source_path")).alias("depth"), F.col("source_path").alias("path"))
    files = rows.where("error IS NULL").groupBy("real_path").agg(F.min_by(F.struct("source_path", "modified", "length"), order).alias("file"))
    found = files.select("file.source_path", "real_path", "file.modified", "file.length", F.lit(None).cast("string").alias("error"))
    # An error is met once for each way to it.
    return found.unionByName(rows.where("error IS NOT NULL").distinct())


def read_files(files: DataFrame, content: bool = True) -> DataFrame:
    """``source_path, content, content_hash, error`` of ``files (source_path, real_path)``; a file that cannot be read is a row with its error."""
    schema = "source_path string, content binary, content_hash string, error string"

    def run(batches):
        import pandas as pd

        for batch in batches:
            for low in range(0, len(batch), READ_AT_ONCE):
                rows = []
                for path, real in zip(batch["source_path"][low : low + READ_AT_ONCE], batch["real_path"][low : low + READ_AT_ONCE]):
                    try:
                        with open(real, "rb") as file:
                            held = file.read()
                        rows.append((path, held if content else None, hashlib.sha256(held).hexdigest(), None))
                    except OSError as error:
                        rows.append((path, None, None, f"{type(error).__name__}: {error.strerror}"))
                yield pd.DataFrame(rows, columns=["source_path", "content", "content_hash", "error"])

    return files.select("source_path", "real_path").mapInPandas(run, schema)
