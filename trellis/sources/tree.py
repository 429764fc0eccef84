"""A directory tree as a data source: ``spark.read.format("trellis_tree").load(root)``, one row for each entry below ``root``.

Rows are (path, dir, name, folder, mtime, size): paths relative to ``root``, ``dir`` '' at the top, times in milliseconds,
size null for directories. Tasks list, the driver does not: the entries of the first LEVELS levels are dealt to partitions by a
checksum of their paths; each partition lists these levels, names only, and walks what falls to it. Memory is one
directory's listing and the directories still to walk. Names that start with '.' or '_' and empty directories have rows; a
link to a directory of this machine is a row that is not walked; a root that does not exist has no rows, one that is a file neither.

Option ``at``, a JSON list of relative paths, keeps the entries at these paths and below them; directories that neither lie
on the way to one nor below one are not listed. Filters themselves are left to Spark: its pushing of filters into Python sources
keeps those of one query for the next one over the same table (4.1.2: wrong rows). ``contents`` adds the bytes of files,
read by tasks over whatever rows it is given, so a large directory can be shared out.
"""

from __future__ import annotations

import json
import os
from urllib.parse import quote
from zlib import crc32

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COLUMNS = "path string, dir string, name string, folder boolean, mtime double, size long"
_ARROW = pa.schema([("path", pa.string()), ("dir", pa.string()), ("name", pa.string()), ("folder", pa.bool_()), ("mtime", pa.float64()), ("size", pa.int64())])
LEVELS, PARTITIONS, _ROWS = 2, 16, 4096


def uri(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def opened(where: str):
    """(file system, path in it) of a URI as Hadoop writes it, with blanks and other letters as they are, or of an absolute path."""
    return fs.FileSystem.from_uri(where if where.startswith("/") else quote(where, safe=":/@"))


class Share(InputPartition):
    """The entries whose checksum falls to one task."""


class TreeReader(DataSourceReader):
    def __init__(self, root: str, tasks: int, at: list[str] | None = None):
        self.root, self.tasks = root, tasks
        self.at = None if at is None else frozenset(p.strip("/") for p in at)
        # Every directory above a wanted path.
        self.above = {p[:i] for p in self.at or () for i, c in enumerate(p) if c == "/"}

    def _kept(self, path: str) -> bool:
        if self.at is None or "" in self.at or path in self.at:
            return True
        return any(path[:i] in self.at for i, c in enumerate(path) if c == "/")

    def partitions(self):
        return [Share(k) for k in range(self.tasks)]

    def read(self, partition):
        where, top = opened(self.root)
        local = where.type_name == "local"
        if where.get_file_info(top).type != fs.FileType.Directory:
            return
        rows, walk = [], [("", 0)]
        while walk:
            folder, level = walk.pop()
            for f in where.get_file_info(fs.FileSelector(f"{top}/{folder}" if folder else top, allow_not_found=True)):
                path = f"{folder}/{f.base_name}" if folder else f.base_name
                is_folder = f.type == fs.FileType.Directory
                if not is_folder and f.type != fs.FileType.File:
                    continue
                mine = level >= LEVELS or crc32(path.encode()) % self.tasks == partition.value
                kept = self._kept(path)
                if mine and kept:
                    rows.append((path, folder, f.base_name, is_folder, float((f.mtime_ns or 0) // 1_000_000), None if is_folder else f.size))
                    if len(rows) == _ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
                        rows = []
                walked = is_folder and (mine or level + 1 < LEVELS) and not (local and os.path.islink(f.path))
                if walked and (kept or path in self.above):
                    walk.append((path, level + 1))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


class TreeSource(DataSource):
    """Options: ``path``, the root as a URI or a path of this machine; ``tasks``, the number of partitions; ``at``."""

    @classmethod
    def name(cls):
        return "trellis_tree"

    def schema(self):
        return COLUMNS

    def reader(self, schema):
        root = self.options["path"].rstrip("/")
        at = self.options.get("at")
        return TreeReader(root if "://" in root or root.startswith("file:") else os.path.abspath(root), int(self.options.get("tasks", PARTITIONS)), None if at is None else json.loads(at))


def tree(spark: SparkSession, root: str, at: list[str] | None = None) -> DataFrame:
    """The entries below ``root``, or of those at or below the paths ``at``; listed whenever they are evaluated."""
    spark.dataSource.register(TreeSource)
    read = spark.read.format("trellis_tree")
    return (read if at is None else read.option("at", json.dumps(at))).load(uri(spark, root))


def contents(spark: SparkSession, root: str, some: DataFrame) -> DataFrame:
    """``some`` (path and other columns) with the content of each path; files that cannot be read have no row."""
    top, names = uri(spark, root), some.columns

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                where, at = opened(f"{top}/{b['path'][i].as_py()}")
                try:
                    with where.open_input_stream(at, compression=None) as f:
                        data = f.read()
                except OSError:
                    continue
                yield pa.RecordBatch.from_arrays([*(b.column(n).slice(i, 1) for n in names), pa.array([data], pa.binary())], [*names, "content"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema)
    return some.mapInArrow(run, f"{kinds}, content binary")
