"""Comparison of two inventories: one full outer join on the path, whatever the sources are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovespark.functions.paths import parent_path
from grovespark.schemas import COMPARE_MODES, FOLDER_DIFF

OUTCOMES = {"skip": "same", "changed": "changed", "new": "new", "target_only": "target_only"}


def equal(mode: str, source: str = "s", target: str = "t", microseconds: bool = False) -> Column:
    """Whether two versions of a file count as the same.

    size: sizes. time: sizes and times. content: sizes and recorded hashes where both
    are there (not 0, not empty), else as time. metadata: time, mode and owner.
    With ``microseconds`` times are compared to the microsecond, as stores do that keep no more.
    """
    if mode not in COMPARE_MODES:
        raise ValueError(f"compare mode must be one of {', '.join(COMPARE_MODES)}")

    def same(name: str) -> Column:
        return F.col(f"{source}.{name}").eqNullSafe(F.col(f"{target}.{name}"))

    size = same("size")
    if mode == "size":
        return size
    time = same("mtime")
    if microseconds:
        s, t = F.col(f"{source}.mtime"), F.col(f"{target}.mtime")
        time = (s - F.pmod(s, F.lit(1000))).eqNullSafe(t - F.pmod(t, F.lit(1000)))
    if mode == "time":
        return size & time
    if mode == "metadata":
        return reduce(lambda a, b: a & b, (same(n) for n in ("mode", "uid", "gid")), size & time)

    def there(side: str) -> Column:
        value = F.col(f"{side}.data_hash").cast("string")
        return value.isNotNull() & ~value.isin("", "0")

    return size & F.when(there(source) & there(target), same("data_hash")).otherwise(time)


def diff(
    source: DataFrame, target: DataFrame, mode: str = "time", source_complete: bool = True, microseconds: bool = False
) -> DataFrame:
    """(rel_path, kind, source_size, target_size, source_mtime, target_mtime, bytes_planned, compare_mode).

    Both sides have one row a path (see ``last_wins``), normalized. The join is on
    the path and not on the folder, so a folder of many files is spread over all
    tasks. A source that was cut short says nothing of what is only at the target.
    A path whose row on either side has ``failed`` could not be looked at: its kind
    is failed, and nothing of it is planned.
    """
    there = source.where(F.col("rel_path").isNotNull()).withColumn("__in", F.lit(True)).alias("s")
    here = target.where(F.col("rel_path").isNotNull()).withColumn("__in", F.lit(True)).alias("t")
    both = there.join(here, F.col("s.rel_path") == F.col("t.rel_path"), "full_outer" if source_complete else "left")
    wrong = reduce(lambda a, b: a | b, [F.col(f"{n}.failed") for n, x in (("s", source), ("t", target)) if "failed" in x.columns], F.lit(False))
    kind = (
        F.when(F.coalesce(wrong, F.lit(False)), "failed")
        .when(F.col("t.__in").isNull(), "new")
        .when(F.col("s.__in").isNull(), "target_only")
        .when(equal(mode, microseconds=microseconds), "skip")
        .otherwise("changed")
    )
    out = both.select(
        F.coalesce("s.rel_path", "t.rel_path").alias("rel_path"), kind.alias("kind"),
        F.col("s.size").alias("source_size"), F.col("t.size").alias("target_size"),
        F.col("s.mtime").alias("source_mtime"), F.col("t.mtime").alias("target_mtime"),
    )
    planned = F.when(F.col("kind").isin("new", "changed"), F.coalesce("source_size", F.lit(0))).otherwise(0)
    return out.withColumns({"bytes_planned": planned.cast("long"), "compare_mode": F.lit(mode)})


def diff_csv(rows: DataFrame) -> DataFrame:
    """As files print it: zeros where the source has nothing, in order of paths."""
    return rows.select(
        F.col("rel_path").alias("path"), "kind",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("source_size", "source_mtime", "target_size", "target_mtime")],
        "bytes_planned",
    ).orderBy("path")


def diff_summary(rows: DataFrame) -> DataFrame:
    """One row: files of each outcome, and the bytes that are to be sent."""
    return rows.agg(
        F.count(F.lit(1)).alias("files_total"),
        *[F.count_if(F.col("kind") == k).alias(f"files_{n}") for k, n in (*OUTCOMES.items(), ("failed", "failed"))],
        F.coalesce(F.sum("bytes_planned"), F.lit(0)).cast("long").alias("bytes_planned"),
    )


def folder_diff(rows: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """One row for each folder that has a file on either side, in the report's columns.

    ``scans`` (rel_path and any of error, the six times and the folder counts)
    gives what the files don't tell. Sums are partly made before the shuffle.
    Status: 0 no difference, 1 some, 2 an error or failed files.
    """
    kind, s, t = F.col("kind"), F.coalesce("source_size", F.lit(0)), F.coalesce("target_size", F.lit(0))

    def total(value: Column, *kinds: str) -> Column:
        return F.coalesce(F.sum(F.when(kind.isin(*kinds), value)), F.lit(0)).cast("long")

    sums = rows.groupBy(parent_path(F.col("rel_path")).alias("rel_path")).agg(
        F.count_if(kind != "target_only").alias("source_file_count"),
        F.count_if(kind != "new").alias("target_file_count"),
        *[F.count_if(kind == k).alias(f"files_{n}") for k, n in (*OUTCOMES.items(), ("failed", "failed"))],
        F.sum(s).cast("long").alias("source_logical_size_bytes"),
        F.sum(t).cast("long").alias("target_logical_size_bytes"),
        total(s, "skip").alias("same_logical_size_bytes"),
        total(s, "changed").alias("changed_logical_size_bytes"),
        total(s, "new").alias("new_logical_size_bytes"),
        total(t, "target_only").alias("target_only_logical_size_bytes"),
        F.sum("bytes_planned").cast("long").alias("bytes_planned"),
    )
    if scans is not None:
        sums = sums.join(scans, "rel_path", "left")
    have = set(sums.columns)
    blank = {f.name: F.lit("" if f.name == "error" else 0) for f in FOLDER_DIFF.fields if f.name not in have}
    sums = sums.withColumns(blank)
    known = [c for c in FOLDER_DIFF.names if c in have and c not in ("rel_path", "status")]
    sums = sums.withColumns({c: F.coalesce(c, F.lit("" if c == "error" else 0)) for c in known})
    differs = F.col("files_changed") + F.col("files_new") + F.col("files_target_only") > 0
    status = F.when((F.col("error") != "") | (F.col("files_failed") > 0), 2).when(differs, 1).otherwise(0)
    sums = sums.withColumn("status", status)
    return sums.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FOLDER_DIFF.fields])


def checker(recs: DataFrame, target: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """``recs`` with ``skip``: whether a record need not be sent.

    A record that needs no check is never skipped. Else it is if the source's
    earlier scan row of its path equals the target's in identity, size, time and
    data hash, **or** if the target's size and time are the record's: then even
    different data hashes don't matter.
    """
    t = target.select("rel_path", *[F.col(c).alias(f"__t_{c}") for c in ("file_hash", "size", "mtime", "data_hash")])
    out = recs.join(t, "rel_path", "left")
    match = (F.col("__t_size") == F.col("size")) & (F.col("__t_mtime") == F.col("mtime"))
    if source is not None:
        s = source.select("rel_path", *[F.col(c).alias(f"__s_{c}") for c in ("file_hash", "size", "mtime", "data_hash")])
        out = out.join(s, "rel_path", "left")
        whole = [F.col(f"__s_{c}") == F.col(f"__t_{c}") for c in ("file_hash", "size", "mtime", "data_hash")]
        match = F.coalesce(reduce(lambda a, b: a & b, whole), F.lit(False)) | F.coalesce(match, F.lit(False))
    skip = F.coalesce(F.col("need_check") & F.coalesce(match, F.lit(False)), F.lit(False))
    return out.withColumn("skip", skip).select(*recs.columns, "skip")


def compact(files: DataFrame) -> DataFrame:
    """What one end of a diff over two sites sends to the other: a row a file, without names of the site's own."""
    names = ("rel_path", "size", "mtime", "mode", "uid", "gid", "data_hash", "failed")
    return files.where(F.col("rel_path").isNotNull()).select(*[c for c in names if c in files.columns])


def folder_answer(received: DataFrame, files: DataFrame, mode: str = "size", source_complete: bool = True) -> DataFrame:
    """What the other end sends back: a row a folder, and no row of a file. Sums are partly made before the shuffle."""
    return folder_diff(diff(received, files, mode, source_complete))


def answer_summary(folders: DataFrame) -> DataFrame:
    """One row of totals of folder rows: the report of a diff over two sites."""
    names = ("files_same", "files_changed", "files_new", "files_target_only", "files_failed", "bytes_planned")
    return folders.agg(
        F.count(F.lit(1)).alias("folders_total"), F.count_if(F.col("status") != 0).alias("folders_differing"),
        *[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names],
    )


def to_transfer(recs: DataFrame, target: DataFrame, mode: str = "time") -> DataFrame:
    """Records without an equal row at the target."""
    s, t = recs.alias("s"), target.alias("t")
    return s.join(t, (F.col("s.rel_path") == F.col("t.rel_path")) & equal(mode), "left_anti")


def unchanged_folders(source_hashes: DataFrame, target_hashes: DataFrame, folder: str, value: str) -> DataFrame:
    """Folders whose hash is the same on both sides: (folder)."""
    t = target_hashes.select(F.col(folder).alias("__f"), F.col(value).alias("__v"))
    return source_hashes.join(t, (F.col(folder) == F.col("__f")) & (F.col(value) == F.col("__v")), "left_semi").select(folder)


def diff_with_skip(source: DataFrame, target: DataFrame, same: DataFrame, folder: str, mode: str = "time") -> DataFrame:
    """The diff of what lies in other folders than ``same``; files in those are not looked at."""
    return diff(source.join(same, folder, "left_anti"), target.join(same, folder, "left_anti"), mode)
