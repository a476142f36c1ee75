"""File inventory as a data source: each task lists its own folders.

The driver looks at the upper levels only, until there are enough folders to deal out; what lies below is listed by the
tasks, and no process holds all names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Executors get this module's classes with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "path STRING, length BIGINT"
# Folders are split into their sub-folders until there are so many, at most LEVELS deep.
ENOUGH_FOLDERS = 64
LEVELS = 4
NAMES_PER_BATCH = 10_000


def _store(root: str):
    """File system and path of a root: local, s3, gs, hdfs or another store that Arrow reaches."""
    from pyarrow import fs

    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), root
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(root)


def reachable(root: str) -> bool:
    """Whether Arrow has a file system for the root's scheme."""
    scheme = root.split("://", 1)[0] if "://" in root else "file"
    return scheme in ("file", "s3", "s3a", "gs", "gcs", "hdfs", "abfs", "abfss")


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class FolderReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root.replace("s3a://", "s3://").rstrip("/")

    def partitions(self) -> list[Folder]:
        from pyarrow import fs

        store, top = _store(self.root)
        flat, deep = [], [top]
        for _ in range(LEVELS):
            if not deep or len(deep) >= ENOUGH_FOLDERS:
                break
            below = []
            for path in deep:
                found = store.get_file_info(fs.FileSelector(path))
                below += [f.path for f in found if f.type == fs.FileType.Directory]
                if any(f.type == fs.FileType.File for f in found):
                    flat.append(path)
            deep = below
        return [*(Folder(p, False) for p in flat), *(Folder(p, True) for p in deep)] or [Folder(top, False)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = _store(self.root)
        names, lengths, waiting = [], [], [partition.path]
        while waiting:
            for found in store.get_file_info(fs.FileSelector(waiting.pop())):
                if found.type == fs.FileType.Directory and partition.deep:
                    waiting.append(found.path)
                # Hidden files are no data for Spark's own readers either.
                elif found.type == fs.FileType.File and not found.base_name.startswith(("_", ".")):
                    names.append(found.path[len(top.rstrip("/")) + 1 :])
                    lengths.append(found.size)
                    if len(names) == NAMES_PER_BATCH:
                        yield pa.RecordBatch.from_pydict({"path": names, "length": pa.array(lengths, pa.int64())})
                        names, lengths = [], []
        if names:
            yield pa.RecordBatch.from_pydict({"path": names, "length": pa.array(lengths, pa.int64())})


class FolderListing(DataSource):
    """Files below a folder: path relative to it, length. Option `path`: the folder."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"])
