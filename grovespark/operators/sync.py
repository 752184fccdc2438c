"""Incremental sync: plan, write, verify, and try again what failed."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.functions.controls import require_root_for_owner_change
from grovespark.operators.chunks import chunks, completion, reassembled
from grovespark.operators.diff import diff
from grovespark.schemas import LARGE_CHUNK_BYTES, SMALL_FILE_THRESHOLD
from grovespark.shared import cut_lineage

BLOCK = 4 * 1024 * 1024


@dataclass(frozen=True)
class SyncConfig:
    """Checked when it is made."""

    small_file_threshold: int = SMALL_FILE_THRESHOLD
    large_chunk_bytes: int = LARGE_CHUNK_BYTES
    max_retries: int = 3
    skip_verify: bool = False
    compare_mode: str = "time"
    preserve_owner: bool = False

    def __post_init__(self) -> None:
        if self.small_file_threshold <= 0 or self.large_chunk_bytes <= 0:
            raise ValueError("threshold and chunk size must be positive")
        if self.max_retries < 0:
            raise ValueError("retries must not be negative")


def plan(source: DataFrame, target: DataFrame, mode: str = "time") -> DataFrame:
    """What a sync would send: the new and changed rows of a diff."""
    return diff(source, target, mode).where(F.col("kind").isin("new", "changed"))


def _digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as file:
        while block := file.read(BLOCK):
            h.update(block)
    return h.hexdigest()


def restore(path: str, attributes: dict, config: SyncConfig) -> None:
    """Owner (where asked for and different, and only as root), mode and time of a file or folder."""
    s = os.stat(path)
    if config.preserve_owner and (s.st_uid, s.st_gid) != (attributes["uid"], attributes["gid"]):
        require_root_for_owner_change(path, s.st_uid, s.st_gid, attributes["uid"], attributes["gid"])
        os.chown(path, attributes["uid"], attributes["gid"])
    os.chmod(path, attributes["mode"])
    os.utime(path, ns=(attributes["mtime"], attributes["mtime"]))


def copy_file(source: str, target: str, attributes: dict, config: SyncConfig) -> tuple[int, int, str | None]:
    """(chunks, bytes, error): written beside the target and moved there when whole, so a second try does no harm."""
    chunks = size = 0
    # Names are up to 255 bytes long; this one is beside the target, whatever its name.
    temporary = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}.part")
    try:
        os.makedirs(os.path.dirname(target), exist_ok=True)
        step = config.small_file_threshold if attributes["size"] <= config.small_file_threshold else config.large_chunk_bytes
        with open(source, "rb") as read, open(temporary, "wb") as write:
            while True:
                block = read.read(step)
                if block or not chunks:
                    write.write(block)
                    chunks += 1
                    size += len(block)
                if len(block) < step:
                    break
        if size != attributes["size"]:
            raise OSError(f"read {size} of {attributes['size']} bytes")
        restore(temporary, attributes, config)
        if not config.skip_verify and _digest(source) != _digest(temporary):
            raise OSError("target differs from source")
        os.replace(temporary, target)
    except OSError as e:
        if os.path.exists(temporary):
            os.remove(temporary)
        return chunks, size, str(e)
    return chunks, size, None


def write_file(target: str, content: bytes, attributes: dict, config: SyncConfig = SyncConfig()) -> str | None:
    """The error, if any, of writing bytes to a file, which takes its name when it is whole."""
    temporary = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}.part")
    try:
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(temporary, "wb") as file:
            file.write(content)
        restore(temporary, attributes, config)
        os.replace(temporary, target)
    except OSError as e:
        if os.path.exists(temporary):
            os.remove(temporary)
        return str(e)
    return None


def write_files(files: DataFrame, root: str, config: SyncConfig = SyncConfig()) -> DataFrame:
    """Write (rel_path, content, mtime, mode, uid, gid) below a folder that all executors share: (rel_path, bytes, ok, error).

    The rows are written when the result is used, and again if it is used again.
    """
    columns = ["rel_path", "content", "mtime", "mode", "uid", "gid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, errors = [], [], []
            others = batch.drop_columns(["content"]).to_pylist()
            for row, content in zip(others, batch.column("content"), strict=True):
                raw = content.as_py() or b""
                names.append(row["rel_path"])
                sizes.append(len(raw))
                errors.append(write_file(os.path.join(root, row["rel_path"]), raw, row, config))
            cols = [pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array([e is None for e in errors]), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["rel_path", "bytes", "ok", "error"])

    return files.select(columns).mapInArrow(run, "rel_path string, bytes long, ok boolean, error string")


def make_folders(folders: DataFrame, root: str, config: SyncConfig = SyncConfig(), attributes: bool = False) -> DataFrame:
    """Make folders (rel_path) below ``root``, or, with ``attributes``, give them mtime, mode, uid and gid: (rel_path, ok, error).

    A folder's time changes with what is put into it, so attributes come after the files.
    """
    columns = ["rel_path", "mtime", "mode", "uid", "gid"] if attributes else ["rel_path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, errors = [], []
            for row in batch.to_pylist():
                path, error = os.path.join(root, row["rel_path"]), None
                try:
                    os.makedirs(path, exist_ok=True)
                    if attributes:
                        restore(path, row, config)
                except OSError as e:
                    error = str(e)
                names.append(row["rel_path"])
                errors.append(error)
            cols = [pa.array(names, pa.string()), pa.array([e is None for e in errors]), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["rel_path", "ok", "error"])

    return folders.select(columns).mapInArrow(run, "rel_path string, ok boolean, error string")


def send_chunks(files: DataFrame, path: str, threshold: int = SMALL_FILE_THRESHOLD, chunk: int = LARGE_CHUNK_BYTES) -> None:
    """Files (file_id, rel_path, content, mtime, mode, uid, gid) as a table of chunks and one of names below ``path``."""
    files.select("file_id", "rel_path", "mtime", "mode", "uid", "gid").write.parquet(f"{path}/files")
    chunks(files, threshold=threshold, chunk=chunk).write.parquet(f"{path}/chunks")


def receive_chunks(spark: SparkSession, path: str, root: str, config: SyncConfig = SyncConfig()) -> DataFrame:
    """Write the files whose chunks have all come below ``root``, and answer for each: (file_id, rel_path, bytes, ok, error)."""
    names, rows = spark.read.parquet(f"{path}/files"), spark.read.parquet(f"{path}/chunks")
    whole = completion(rows).where("complete").select("file_id")
    contents = reassembled(rows.join(whole, "file_id", "left_semi"))
    written = write_files(names.join(contents, "file_id"), root, config)
    return names.select("file_id", "rel_path").join(written, "rel_path")


OUTCOME = "rel_path string, outcome string, chunks long, bytes long, attempts int, error string"


def transfer(files: DataFrame, source_root: str, target_root: str, config: SyncConfig = SyncConfig(), copy=copy_file) -> DataFrame:
    """Copy ``files`` (rel_path, size, mtime, mode, uid, gid) between folders that all executors share.

    One row a file: done, or failed after the first try and ``max_retries`` more.
    A file's failure is a row and does not stop the others; a task that is run
    again writes the same files again. Files are dealt out by path.
    """
    columns = ["rel_path", "size", "mtime", "mode", "uid", "gid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for attempt in range(1, config.max_retries + 2):
                    name = row["rel_path"]
                    n, size, error = copy(os.path.join(source_root, name), os.path.join(target_root, name), row, config)
                    if error is None:
                        break
                out.append((name, "failed" if error else "done", n, size, attempt, error))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
            names = [f.split()[0] for f in OUTCOME.split(", ")]
            cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return files.select(columns).repartition("rel_path").mapInArrow(run, OUTCOME)


def report(rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row of totals: of a diff's rows and of what became of those that were sent. Paths that could not be looked at failed too."""
    d = rows.agg(
        F.count_if(F.col("kind") != "target_only").alias("files_total"),
        F.count_if(F.col("kind") == "skip").alias("files_skipped"),
        F.count_if(F.col("kind") == "changed").alias("files_changed"),
        F.count_if(F.col("kind") == "new").alias("files_new"),
        F.count_if(F.col("kind") == "target_only").alias("files_target_only"),
        F.count_if(F.col("kind") == "failed").alias("__unread"),
        F.coalesce(F.sum("bytes_planned"), F.lit(0)).cast("long").alias("bytes_planned"),
    )
    o = outcomes.agg(
        F.count_if(F.col("outcome") == "done").alias("files_transferred"),
        F.count_if(F.col("outcome") == "failed").alias("__unsent"),
        F.coalesce(F.sum(F.col("attempts") - 1), F.lit(0)).cast("long").alias("retries"),
        F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("chunks"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "done", F.col("bytes"))), F.lit(0)).cast("long").alias("bytes_transferred"),
    )
    # One row beside one row.
    both = d.join(F.broadcast(o), F.lit(True))
    return both.withColumn("files_failed", F.col("__unread") + F.col("__unsent")).drop("__unread", "__unsent")


def sync(spark: SparkSession, source_root: str, target_root: str, config: SyncConfig = SyncConfig(), dry_run: bool = False) -> dict:
    """Bring ``target_root`` to the files and folders of ``source_root``; nothing is deleted there.

    The diff and the outcomes are kept in the shared folder: a lost executor must
    not bring them about again, when the target has changed. Tasks make the
    folders, copy the files, and last give the folders their attributes.
    """
    from grovespark.sources.filetree import file_tree

    source = file_tree(spark, source_root)
    empty = source.where(F.lit(False))
    target = file_tree(spark, target_root) if os.path.isdir(target_root) else empty
    scan = cut_lineage(source)
    files, there = (x.where(F.col("record_type") == "file") for x in (scan, target))
    folders = scan.where((F.col("record_type") == "folder") & ~F.col("failed"))
    unread = scan.where((F.col("record_type") == "folder") & F.col("failed")).count()
    rows = cut_lineage(diff(files, there, config.compare_mode, source_complete=not unread))
    outcomes, wrong = spark.createDataFrame([], OUTCOME), 0
    if not dry_run:
        wanted = rows.where(F.col("kind").isin("new", "changed")).select("rel_path")
        made = cut_lineage(make_folders(folders, target_root, config))
        outcomes = cut_lineage(transfer(files.join(wanted, "rel_path", "left_semi"), source_root, target_root, config))
        given = cut_lineage(make_folders(folders, target_root, config, attributes=True))
        wrong = made.union(given).where(~F.col("ok")).select("rel_path").distinct().count()
    return report(rows, outcomes).first().asDict() | {"folders_failed": unread + wrong}
