"""Inventories: records, folder totals, scan statistics, run columns, filters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from grovespark.functions.hashing import with_identity
from grovespark.functions.paths import base_name, join_path, normalize_path, parent_path, under
from grovespark.schemas import INVENTORY, SMALL_FILE_THRESHOLD


@dataclass
class ScanRun:
    """Who scanned what and when; repeated on every row."""

    run_id: str
    started_at_utc: str
    started_unix_ns: int
    source_root: str
    settings_json: str = "{}"


def logical_size(declared: Column, content: Column) -> Column:
    """The declared size unless it is 0, then the content's bytes. No content: 0."""
    return F.when(F.coalesce(declared, F.lit(0)) != 0, declared).otherwise(F.coalesce(F.octet_length(content), F.lit(0))).cast("long")


def records(files: DataFrame) -> DataFrame:
    """Working records of files (rel_path, content, declared_size, mtime, mode, uid, gid, need_check)."""
    path = normalize_path(F.col("rel_path"))
    out = files.where(F.col("rel_path").isNotNull()).withColumn("rel_path", path)
    out = with_identity(out).withColumn("size", logical_size(F.col("declared_size"), F.col("content")))
    return out.select(
        base_name(F.col("rel_path")).alias("name"), "rel_path", F.col("folder_hash").alias("parent_hash"), "folder_hash",
        F.col("file_hash").alias("own_hash"), "size", "mtime", "mode", "uid", "gid", "need_check", F.lit(True).alias("need_data"),
    )


def snapshots(recs: DataFrame, data_hash: Column, side: str = "S") -> DataFrame:
    """Compact scan rows of records; a record's time stands in for the time of hashing."""
    if len(side) != 1:
        raise ValueError(f"a side is one letter, not {side!r}")
    return recs.select(
        "folder_hash", F.col("own_hash").alias("file_hash"), "rel_path", "size", "mtime", "mode", "uid", "gid",
        data_hash.alias("data_hash"), F.col("mtime").alias("hash_ts"), F.lit(side).alias("scan_side"),
    )


def last_wins(rows: DataFrame, ordinal: str, path: str = "rel_path") -> DataFrame:
    """Of rows with one path the one that came last. One aggregate, which is partly made before the shuffle."""
    others = [c for c in rows.columns if c != path]
    latest = rows.groupBy(path).agg(F.max_by(F.struct(*others), F.col(ordinal)).alias("__row"))
    return latest.select(*[F.col(path) if c == path else F.col(f"__row.{c}").alias(c) for c in rows.columns])


def folder_totals(files: DataFrame, folders: DataFrame) -> DataFrame:
    """``folders`` (rel_path, ...) with the number and bytes of the files directly inside; 0 for empty ones."""
    sums = (
        files.groupBy(parent_path(F.col("rel_path")).alias("__folder"))
        .agg(F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__bytes"))
    )
    joined = folders.join(sums, F.col("rel_path") == F.col("__folder"), "left")
    return joined.select(
        *folders.columns,
        F.coalesce("__n", F.lit(0)).cast("long").alias("flat_file_count"),
        F.coalesce("__bytes", F.lit(0)).cast("long").alias("flat_logical_size_bytes"),
    )


def folders_of(files: DataFrame) -> DataFrame:
    """All folders that the files' paths pass through, without the root."""
    parts = F.split(parent_path(F.col("rel_path")), "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return files.where(F.instr("rel_path", "/") > 0).select(F.explode(every).alias("rel_path")).distinct()


def inventory(files: DataFrame, folders: DataFrame | None = None, run: ScanRun | None = None) -> DataFrame:
    """The published relation. Missing hash columns of files are empty or 0; of folders they are null."""
    hashes = {
        "hash_algorithm": F.lit(""), "content_hash": F.lit(""), "hash_block_size": F.lit(0), "hash_block_count": F.lit(0),
        "block_hash_algorithm": F.lit(""), "block_hashes": F.lit(""),
    }
    added = {c: v for c, v in hashes.items() if c not in files.columns}
    nulls = {"flat_file_count": F.lit(None), "flat_logical_size_bytes": F.lit(None)}
    out = files.withColumns({"record_type": F.lit("file")} | added | nulls)
    out = _published(out, run)
    if folders is not None:
        gone = {c: F.lit(None) for c in ("size", *hashes)}
        out = out.unionByName(_published(folders.withColumns({"record_type": F.lit("folder")} | gone), run))
    return out


def _published(rows: DataFrame, run: ScanRun | None) -> DataFrame:
    values = (run.run_id, run.started_at_utc, run.started_unix_ns, run.source_root, run.settings_json) if run else (None,) * 5
    names = ("scan_run_id", "run_started_at_utc", "run_started_unix_ns", "source_root", "run_settings")
    rows = rows.withColumns(dict(zip(names, map(F.lit, values), strict=True)))
    rows = rows.withColumn("rel_path", normalize_path(F.col("rel_path")))
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in INVENTORY.fields])


def selected(rows: DataFrame, files: bool = True, folders: bool = True) -> DataFrame:
    """Files, folders or both; to ask for neither is an error."""
    if not files and not folders:
        raise ValueError("at least one of files and folders must be written")
    kinds = [k for k, wanted in (("file", files), ("folder", folders)) if wanted]
    return rows if len(kinds) == 2 else rows.where(F.col("record_type") == kinds[0])


def subtree(rows: DataFrame, folder: str, recursive: bool = True) -> DataFrame:
    """What is at a path and below it, or directly inside it."""
    path = F.col("rel_path")
    return rows.where(under(path, folder) if recursive else parent_path(path) == folder)


def folder_pages(rows: DataFrame, folders: DataFrame, page: int = 4096) -> DataFrame:
    """(folder, sequence, final, files): each folder's entries in pages; its last page says so, and an empty folder has one.

    ``rows`` (parent_path, ordinal and what a page holds of an entry) as the scan
    gives them, so a page is a group of its own and a huge folder is no hot key.
    """
    kept = [c for c in rows.columns if c not in ("parent_path", "ordinal")]
    pages = rows.groupBy(F.col("parent_path").alias("folder"), F.floor(F.col("ordinal") / page).cast("long").alias("sequence")).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", *kept))).alias("files")
    )
    last = rows.groupBy("parent_path").agg(F.floor(F.max("ordinal") / page).cast("long").alias("__last"))
    last = folders.select(F.col("rel_path").alias("__folder")).join(last, F.col("__folder") == F.col("parent_path"), "left")
    every = last.select("__folder", F.coalesce("__last", F.lit(0)).alias("__last"))
    every = every.select("__folder", "__last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__last"))).alias("__page"))
    out = every.join(pages, (F.col("__folder") == F.col("folder")) & (F.col("__page") == F.col("sequence")), "left")
    none = F.array().cast(pages.schema["files"].dataType)
    return out.select(
        F.col("__folder").alias("folder"), F.col("__page").alias("sequence"), (F.col("__page") == F.col("__last")).alias("final"),
        F.coalesce("files", none).alias("files"),
    )


def size_capped(rows: DataFrame, cap: int) -> DataFrame:
    """Files up to a size; 0 is no cap."""
    return rows.where(F.col("size") <= cap) if cap else rows


def size_class(size: Column, threshold: int = SMALL_FILE_THRESHOLD) -> Column:
    return F.when(size <= threshold, "small").otherwise("large")


def size_class_totals(files: DataFrame, threshold: int = SMALL_FILE_THRESHOLD) -> DataFrame:
    return files.groupBy(size_class(F.col("size"), threshold).alias("bucket")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("logical_size_bytes")
    )


def scan_statistics(rows: DataFrame, unique_folders: bool = False, elapsed_seconds: float | None = None) -> DataFrame:
    """One row: accepted, files_found, folders_found, logical_size_bytes, and rates if the time is given.

    Without ``unique_folders`` each file found alone counts a folder as well: so
    the running totals are defined. With it, distinct folders are counted.
    """
    is_file = F.col("record_type") == "file"
    folder = F.when(is_file, parent_path(F.col("rel_path"))).otherwise(F.col("rel_path"))
    folders = F.count_distinct(folder) if unique_folders else F.count(F.lit(1))
    out = rows.agg(
        F.count(F.lit(1)).alias("accepted"),
        F.count_if(is_file).alias("files_found"),
        folders.alias("folders_found"),
        F.coalesce(F.sum(F.when(is_file, F.col("size"))), F.lit(0)).cast("long").alias("logical_size_bytes"),
    )
    if elapsed_seconds is not None:
        out = out.withColumns(
            {
                "elapsed_seconds": F.lit(float(elapsed_seconds)),
                "records_per_second": F.when(F.lit(elapsed_seconds > 0), F.col("accepted") / F.lit(float(elapsed_seconds))).otherwise(0.0),
            }
        )
    return out


def children(rows: DataFrame) -> DataFrame:
    """Each row as its folder's path and its own name."""
    path = F.col("rel_path")
    return rows.withColumns({"folder_path": parent_path(path), "base_name": base_name(path)}).drop("rel_path")


def rebuilt(rows: DataFrame) -> DataFrame:
    """The reverse of ``children``."""
    return rows.withColumn("rel_path", join_path(F.col("folder_path"), F.col("base_name"))).drop("folder_path", "base_name")


#: Upper bounds of the latency buckets in nanoseconds; the last bucket has none.
LATENCY_BOUNDS = (100_000, 500_000, 1_000_000, 5_000_000, 10_000_000, 50_000_000, 100_000_000)


def latency_summary(rows: DataFrame, latency_ns: Column, requested: Column, completed: Column) -> DataFrame:
    """One row: counts, bytes, sum, greatest, mean, and files in each bucket. ``completed`` below 0: failed."""
    bounds = (0, *LATENCY_BOUNDS, None)
    buckets = [
        F.count_if((latency_ns >= lo) & (F.lit(True) if hi is None else latency_ns < hi)).alias(f"bucket_{i}")
        for i, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False))
    ]
    return rows.agg(
        F.count(F.lit(1)).alias("completed"),
        F.count_if(completed < 0).alias("failed"),
        F.count_if(completed == 0).alias("zero_reads"),
        F.count_if((completed > 0) & (completed < requested)).alias("short_reads"),
        F.sum(requested).cast("long").alias("bytes_requested"),
        F.sum(F.greatest(completed, F.lit(0))).cast("long").alias("bytes_completed"),
        F.sum(latency_ns).cast("long").alias("latency_ns"),
        F.max(latency_ns).cast("long").alias("max_latency_ns"),
        *buckets,
    )


def rolling_rate(rows: DataFrame, key: str, second: str, seconds: int = 60) -> DataFrame:
    """(key, second, n, rate): events of the last ``seconds`` a second. Seconds are summed first, so windows stay short.

    The sums go to the windows' partitions as they are; a key is one task's, but a row a second at most.
    """
    each = rows.groupBy(key, second).agg(F.count(F.lit(1)).alias("n"))
    window = Window.partitionBy(key).orderBy(second).rangeBetween(-(seconds - 1), 0)
    return each.withColumn("rate", F.sum("n").over(window) / F.lit(float(seconds)))


def read_totals(files: DataFrame, contents: DataFrame, threshold: int = SMALL_FILE_THRESHOLD) -> DataFrame:
    """One row: what was found and what was read, in all and by class of size. A file that is missing or has fewer bytes than declared failed.

    ``files``: (rel_path, size); ``contents``: (rel_path, length).
    """
    got = contents.select(F.col("rel_path").alias("__path"), F.col("length").cast("long").alias("__length"))
    rows = files.join(got, F.col("rel_path") == F.col("__path"), "left")
    small, good = F.col("size") <= threshold, F.coalesce(F.col("__length") >= F.col("size"), F.lit(False))

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    return rows.agg(
        F.count(F.lit(1)).alias("files_found"),
        F.count_if(good).alias("files_read"),
        F.count_if(~good).alias("files_failed"),
        total(F.col("size")).alias("logical_size_bytes"),
        total(F.when(good, F.col("__length"))).alias("bytes_read"),
        F.count_if(small).alias("small_files_found"),
        F.count_if(~small).alias("large_files_found"),
        F.count_if(small & good).alias("small_files_read"),
        F.count_if(~small & good).alias("large_files_read"),
        total(F.when(small & good, F.col("__length"))).alias("small_bytes_read"),
        total(F.when(~small & good, F.col("__length"))).alias("large_bytes_read"),
    )


def watched(rows: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """``rows`` and running totals of what passes when they are used: no pass of their own."""
    seen = Observation(name)
    is_file = F.col("record_type") == "file"
    totals = rows.observe(
        seen, F.count(F.lit(1)).alias("accepted"), F.count_if(is_file).alias("files"),
        F.coalesce(F.sum(F.when(is_file, F.col("size"))), F.lit(0)).cast("long").alias("logical_size_bytes"),
    )
    return totals, seen
