"""Listing of an object store as a Spark data source: prefixes are planned, tasks list them.

``spark.read.format("store_listing").load(root)`` gives one row per file. The
driver sees the first level of the tree only; each prefix there is listed by a
task, folder by folder. As a stream the source hands out the files whose time
lies between two offsets, so the checkpoint is the cursor.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "store_listing"
SCHEMA = "uri string, path string, size_bytes bigint, updated timestamp"
#: A stream leaves files younger than this for a later batch, since their store may show them late.
GRACE_SECONDS = 60


class Prefix(InputPartition):
    """What one task lists: a folder with all below it, or the files right in it."""

    def __init__(self, path: str, deep: bool, since: float | None = None, upto: float | None = None):
        self.path, self.deep, self.since, self.upto = path, deep, since, upto


def _store(root: str):
    """The file system of a root, its path there, and what a uri has before such a path."""
    from pyarrow import fs

    if "://" not in root:
        return fs.LocalFileSystem(), root.rstrip("/"), ""
    store, path = fs.FileSystem.from_uri(root.replace("s3a://", "s3://", 1))
    return store, path.rstrip("/"), root[: root.index("://") + 3]


def planned(root: str, since: float | None = None, upto: float | None = None) -> list[Prefix]:
    """One task for each folder right below ``root``, and one for the files in it."""
    from pyarrow import fs

    store, path, _ = _store(root)
    top = store.get_file_info(fs.FileSelector(path, recursive=False, allow_not_found=True))
    return [Prefix(path, False, since, upto), *(Prefix(t.path, True, since, upto) for t in top if t.type == fs.FileType.Directory)]


def listed(root: str, prefix: Prefix) -> Iterator[tuple]:
    """The files of a prefix, a folder at a time; directory markers are none."""
    from pyarrow import fs

    store, base, scheme = _store(root)
    todo = [prefix.path]
    while todo:
        for f in store.get_file_info(fs.FileSelector(todo.pop(), recursive=False, allow_not_found=True)):
            if f.type == fs.FileType.Directory:
                if prefix.deep:
                    todo.append(f.path)
            elif f.type == fs.FileType.File and f.base_name and not f.base_name.startswith((".", "_")):
                at = f.mtime.timestamp() if f.mtime else 0.0
                if (prefix.since is None or at > prefix.since) and (prefix.upto is None or at <= prefix.upto):
                    yield scheme + f.path, f.path[len(base):].lstrip("/"), f.size, f.mtime


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        return planned(self.root)

    def read(self, partition):
        yield from listed(self.root, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, root: str, grace: float):
        self.root, self.grace = root, grace

    def initialOffset(self):
        return {"upto": -1.0}

    def latestOffset(self):
        return {"upto": (datetime.now(timezone.utc) - timedelta(seconds=self.grace)).timestamp()}

    def partitions(self, start, end):
        return planned(self.root, start["upto"], end["upto"])

    def read(self, partition):
        yield from listed(self.root, partition)

    def commit(self, end):
        pass


class StoreListing(DataSource):
    """Options: ``path`` and, for streams, ``graceSeconds``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def streamReader(self, schema):
        return _StreamReader(self.options["path"], float(self.options.get("graceSeconds", GRACE_SECONDS)))


def list_store(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root``: uri, path, size_bytes, updated."""
    spark.dataSource.register(StoreListing)
    return spark.read.format(NAME).load(root)


def stream_store(spark: SparkSession, root: str, grace_seconds: float = GRACE_SECONDS) -> DataFrame:
    """New files below ``root`` as a stream of the same columns; a changed file comes again."""
    spark.dataSource.register(StoreListing)
    return spark.readStream.format(NAME).option("graceSeconds", str(grace_seconds)).load(root)
