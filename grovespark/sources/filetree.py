"""A Python data source that lists file trees: ``spark.read.format("filetree").option("root", ...)``."""

from __future__ import annotations

import itertools
import json
import os
import stat
import time
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition, LessThanOrEqual
from pyspark.sql.types import StructType

from grovespark.shared import new_path
from grovespark.ship import by_value

SCHEMA = (
    "record_type string, rel_path string, parent_path string, size long, mtime long, mode int, uid int, gid int, "
    "scan_started_unix_ns long, failed boolean, error string, ordinal long"
)
RETRIES = 3
#: Errors that trying again does not mend.
FINAL = (FileNotFoundError, NotADirectoryError, PermissionError)


class Folders(InputPartition):
    """Folders that one task lists; with everything below if ``deep``."""

    def __init__(self, paths: list[str], deep: bool):
        self.paths, self.deep = paths, deep


class FileTree(DataSource):
    """Options: root (must be a folder that all executors see), recursive (true), partitions (64), mounts.

    ``root`` is a path, a ``file:`` URI, or an ``nfs:`` URL of an export that
    ``mounts`` (JSON: server:/export to a path) says where to find.

    Regular files and folders; a link is what it points to, but what lies below a
    linked folder is not listed, so links cannot make a scan endless. A folder that
    cannot be listed to its end, and an entry that cannot be looked at, are rows
    with ``failed`` and ``error``, and the scan goes on. Times are in nanoseconds,
    modes without type bits; ``ordinal`` is an entry's place in its folder. The
    root itself is not a row, unless it fails.
    """

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        options = dict(self.options)
        return PushingReader(options) if options.get("pushdown") == "true" else TreeReader(options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return TreeStream(dict(self.options))


def local_root(root: str, mounts: dict[str, str]) -> str:
    """Where a root is mounted. Of several exports that fit a URL, the longest counts."""
    kind, _, rest = root.partition("://")
    if not rest:
        return os.path.normpath(root.removeprefix("file:"))
    if kind == "file":
        return os.path.normpath("/" + rest.partition("/")[2])
    if kind == "nfs":
        server, _, path = rest.partition("?")[0].partition("/")
        path = os.path.normpath("/" + path)
        fits = [x for x in mounts if x.partition(":")[0] == server and (path + "/").startswith(x.partition(":")[2].rstrip("/") + "/")]
        if not fits:
            raise ValueError(f"no mount is given for {root}")
        export = max(fits, key=len)
        return os.path.normpath(mounts[export] + "/" + path[len(export.partition(":")[2].rstrip("/")) :])
    raise ValueError(f"no way to list {root}")


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = local_root(options["root"], json.loads(options.get("mounts", "{}")))
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.parts = int(options.get("partitions", "64"))
        self.parent: str | None = None
        self.kind: str | None = None
        self.largest: int | None = None

    def partitions(self) -> Sequence[InputPartition]:
        """The root's folders, level by level until there are enough, are dealt out to the tasks."""
        if not os.path.isdir(self.root):
            raise NotADirectoryError(f"{self.root} is not a folder")
        if self.parent is not None:
            return [Folders([self.parent], False)]
        if not self.recursive:
            return [Folders([""], False)]
        flat, deep = [], [""]
        while deep and len(deep) < self.parts:
            below = []
            for folder in deep:
                flat.append(folder)
                try:
                    with os.scandir(os.path.join(self.root, folder)) as entries:
                        below += [os.path.join(folder, e.name) for e in entries if e.is_dir() and not e.is_symlink()]
                except OSError:
                    pass  # the task that lists this folder reports it
            if not below or len(flat) > 8 * self.parts:
                deep = below
                break
            deep = sorted(below)
        dealt = [Folders(flat[i :: self.parts], False) for i in range(min(self.parts, len(flat)))]
        return dealt + [Folders(deep[i :: self.parts], True) for i in range(min(self.parts, len(deep)))]

    def read(self, partition: Folders) -> Iterator[tuple]:
        todo = list(reversed(partition.paths))
        while todo:
            folder = todo.pop()
            for row, below in self.listed(folder):
                if below is not None and partition.deep:
                    todo.append(below)
                if row is not None:
                    yield row

    def listed(self, folder: str) -> Iterator[tuple[tuple | None, str | None]]:
        """(row or none, folder below or none) for each entry; errors that may pass are tried again."""
        started = time.time_ns()
        error = None
        for place, name in enumerate(self.names(folder)):
            if isinstance(name, OSError):
                error = str(name)
                break
            path = os.path.join(folder, name)
            s, linked, wrong = self.looked_at(path)
            if wrong is not None:
                yield ("file", path, folder, None, None, None, None, None, started, True, wrong, place), None
            elif stat.S_ISDIR(s.st_mode):
                keep = self.kind in (None, "folder") and self.largest is None
                row = ("folder", path, folder, None, s.st_mtime_ns, s.st_mode & 0o777, s.st_uid, s.st_gid, started, False, None, place)
                yield row if keep else None, None if linked else path
            elif stat.S_ISREG(s.st_mode):
                keep = self.kind in (None, "file") and (self.largest is None or s.st_size <= self.largest)
                row = ("file", path, folder, s.st_size, s.st_mtime_ns, s.st_mode & 0o777, s.st_uid, s.st_gid, started, False, None, place)
                yield row if keep else None, None
        if error is not None:
            yield ("folder", folder, os.path.dirname(folder), None, None, None, None, None, started, True, error, None), None

    def names(self, folder: str) -> Iterator[str | OSError]:
        """The names in a folder as they come; the error that kept it from being opened, or listed to its end, is the last."""
        for attempt in range(1, RETRIES + 1):
            try:
                found = os.scandir(os.path.join(self.root, folder))
                break
            except OSError as e:
                if isinstance(e, FINAL) or attempt == RETRIES:
                    yield e
                    return
        with found:
            try:
                for entry in found:
                    yield entry.name
            except OSError as e:
                yield e

    def looked_at(self, rel_path: str) -> tuple[os.stat_result | None, bool, str | None]:
        """(what it is, whether it is a link, error)."""
        path = os.path.join(self.root, rel_path)
        for _ in range(RETRIES):
            try:
                return os.stat(path), os.path.islink(path), None
            except OSError as e:
                error = str(e)
                if isinstance(e, FINAL):
                    break
        return None, False, error


class PushingReader(TreeReader):
    """With ``spark.sql.python.filterPushdown.enabled``, without which Spark refuses a reader that takes filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """One folder, one kind of record and a largest size are kept to here, and checked again by Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("parent_path",):
                self.parent = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("record_type",):
                self.kind = f.value
            elif isinstance(f, LessThanOrEqual) and f.attribute == ("size",):
                self.largest = f.value
            yield f


def place(folder: str) -> tuple[str, ...]:
    """Sorts folders as a walk meets them: a folder before those below it, and these before the next one beside it."""
    return tuple(folder.split("/")) if folder else ()


class TreeStream(DataSourceStreamReader):
    """A scan as a stream: so many folders a batch (option ``folders_per_batch``, 1000), in the order of a walk.

    The offset is the last folder that was read, so a scan that stopped goes on
    behind it, whatever folders came or went meanwhile; those that came before it
    are left to the next scan. For a batch the driver asks for the names of that
    batch's folders alone; tasks list what is in them.
    """

    def __init__(self, options: dict[str, str]):
        self.tree = TreeReader(options)
        self.step = int(options.get("folders_per_batch", "1000"))
        self.at: str | None = None

    def below(self, folder: str, after: str = "") -> list[str]:
        """The folders directly inside whose names come after another, in order."""
        try:
            with os.scandir(os.path.join(self.tree.root, folder)) as found:
                names = sorted(e.name for e in found if e.name > after and e.is_dir(follow_symlinks=False))
        except OSError:
            return []  # the task that lists this folder reports it
        return [os.path.join(folder, n) for n in names]

    def walk(self, after: str | None) -> Iterator[str]:
        """All folders behind one, or, without one, all."""
        todo = [""] if after is None else self.below(after)[::-1]
        while True:
            while todo:
                folder = todo.pop()
                yield folder
                todo += self.below(folder)[::-1]
            if not after:
                return
            after, name = os.path.split(after)
            todo = self.below(after, name)[::-1]

    def initialOffset(self) -> dict:
        return {"folder": None}

    def latestOffset(self) -> dict:
        for self.at in itertools.islice(self.walk(self.at), self.step):
            pass
        return {"folder": self.at}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if end["folder"] is None:
            return []
        last = place(end["folder"])
        if self.at is None or place(self.at) < last:
            self.at = end["folder"]
        some = list(itertools.takewhile(lambda f: place(f) <= last, self.walk(start["folder"])))
        return [Folders(some[i :: self.tree.parts], False) for i in range(min(self.tree.parts, len(some)))]

    def read(self, partition: Folders) -> Iterator[tuple]:
        return self.tree.read(partition)

    def commit(self, end: dict) -> None:
        pass


def file_tree_stream(spark: SparkSession, root: str, folders_per_batch: int = 1000) -> DataFrame:
    by_value(__name__)
    spark.dataSource.register(FileTree)
    return spark.readStream.format("filetree").options(root=root, folders_per_batch=str(folders_per_batch)).load()


def file_tree(spark: SparkSession, root: str, recursive: bool = True, partitions: int = 64, mounts: dict[str, str] | None = None) -> DataFrame:
    by_value(__name__)
    spark.dataSource.register(FileTree)
    options = {"root": root, "recursive": str(recursive).lower(), "partitions": str(partitions), "mounts": json.dumps(mounts or {})}
    options["pushdown"] = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("filetree").options(**options).load()


def file_tree_by_level(spark: SparkSession, root: str, mounts: dict[str, str] | None = None) -> DataFrame:
    """The same rows as ``file_tree``, a level of folders a job: a deep or lopsided tree is dealt out anew at each level.

    Levels are kept in the shared folder. The driver sees whether a level has folders, and no names.
    """
    by_value(__name__)
    reader = TreeReader({"root": root, "mounts": json.dumps(mounts or {})})
    if not os.path.isdir(reader.root):
        raise NotADirectoryError(f"{root} is not a folder")
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    kinds = [kinds[f.split()[1]] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((*(row or (None,) * len(names)), below) for folder in batch.column(0).to_pylist() for row, below in reader.listed(folder))
            while some := list(itertools.islice(rows, 10_000)):
                cols = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [*kinds, pa.string()], strict=True)], names=[*names, "below"])

    top, level = new_path(spark, "levels"), 0
    folders = spark.createDataFrame([("",)], "below string")
    while True:
        folders.repartition("below").mapInArrow(run, f"{SCHEMA}, below string").write.parquet(f"{top}/level={level}")
        folders = spark.read.parquet(f"{top}/level={level}").where("below is not null").select("below")
        if folders.isEmpty():
            break
        level += 1
    return spark.read.schema(f"{SCHEMA}, below string").parquet(*[f"{top}/level={i}" for i in range(level + 1)]).drop("below")


def file_contents(spark: SparkSession, root: str) -> DataFrame:
    """(rel_path, content, length) of all files, by Spark's own reader; only asked-for columns are read."""
    from pyspark.sql import functions as F

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    top = os.path.normpath(root.removeprefix("file://"))
    path = F.regexp_replace("path", "^file:/*", "/")
    return rows.select(F.substring(path, len(top) + 2, 4096).alias("rel_path"), "content", "length")


def open_probe(files: DataFrame, root: str) -> DataFrame:
    """(rel_path, opened, latency_ns, error): each file is opened and closed, and nothing read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                began, error = time.perf_counter_ns(), None
                try:
                    os.close(os.open(os.path.join(root, name), os.O_RDONLY))
                except OSError as e:
                    error = str(e)
                out.append((name, error is None, time.perf_counter_ns() - began, error))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            kinds = [pa.string(), pa.bool_(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["rel_path", "opened", "latency_ns", "error"]
            )

    return files.select("rel_path").mapInArrow(run, "rel_path string, opened boolean, latency_ns long, error string")
