"""Scan files: strict readers for both kinds of header, and writers for text, CSV and Parquet."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from grovespark.functions.controls import csv_quoted, text_quoted
from grovespark.functions.paths import normalize_path
from grovespark.functions.u64 import from_unsigned, unsigned
from grovespark.operators.inventory import last_wins, selected
from grovespark.schemas import INVENTORY, SNAPSHOT

FORMATS = {"text": "text", "txt": "text", "csv": "csv", "parquet": "parquet"}


def parse_format(name: str) -> str:
    if name not in FORMATS:
        raise ValueError(f"no such record format: {name}; known are {', '.join(FORMATS)}")
    return FORMATS[name]


def infer_format(path: str) -> str:
    """By the path's ending, else text."""
    return {".csv": "csv", ".parquet": "parquet"}.get(os.path.splitext(path)[1].lower(), "text")


def read_scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """Scan rows (SNAPSHOT) of a CSV file or folder of them with either header; one row a path, the last one.

    Of the long kind only files are taken; their identities are computed anew and
    recorded content hashes are not used (data hash 0). Another header, another
    number of fields, numbers that are none and sides that are not one letter are errors.
    """
    lines = spark.read.text(path).where(F.regexp_replace("value", "\r$", "") != "")
    first = lines.first()
    if first is None:
        raise ValueError(f"{path} has no header line")
    header = first[0].removesuffix("\r")
    kinds = {",".join(s.names): s for s in (SNAPSHOT, INVENTORY)}
    if header not in kinds:
        raise ValueError(f"{path} has neither of the two known headers")
    schema = kinds[header]
    text = StructType([StructField(n, StringType()) for n in schema.names])
    rows = (
        spark.read.schema(text)
        .options(header=True, enforceSchema=False, mode="FAILFAST", escape='"', emptyValue="", nullValue="\0", ignoreLeadingWhiteSpace=False)
        .csv(path)
        .withColumn("__order", F.monotonically_increasing_id())
    )

    def number(name: str, unsigned_long: bool = True) -> Column:
        value = F.col(name)
        wide = F.when(value.rlike(r"^\d{1,20}$"), value.cast("decimal(20,0)"))
        most = str((1 << 64) - 1) if unsigned_long else str((1 << 32) - 1)
        bad = F.raise_error(F.concat(F.lit(f"{name} is not a number in range: "), F.coalesce(value, F.lit("")))).cast("decimal(20,0)")
        return from_unsigned(F.when(wide <= F.lit(most).cast("decimal(20,0)"), wide).otherwise(bad))

    owner = {n: number(n, False) for n in ("mode", "uid", "gid")}
    path_col = normalize_path(F.col("rel_path"))
    if schema is INVENTORY:
        from grovespark.functions.hashing import with_identity

        rows = rows.where(F.col("record_type") == "file")
        ts = F.when(F.coalesce("run_started_unix_ns", F.lit("")) == "", F.lit(0).cast("long")).otherwise(number("run_started_unix_ns"))
        rows = rows.select(
            path_col.alias("rel_path"), number("size").alias("size"), number("mtime").alias("mtime"), *[v.alias(k) for k, v in owner.items()],
            F.lit(0).cast("long").alias("data_hash"), ts.alias("hash_ts"), F.lit("S").alias("scan_side"), "__order",
        )
        return last_wins(with_identity(rows), "__order").select(*SNAPSHOT.names)
    side = F.when(F.char_length("scan_side") == 1, F.col("scan_side")).otherwise(F.raise_error(F.lit("a side is one letter")).cast("string"))
    rows = rows.select(
        *[number(n).alias(n) for n in ("folder_hash", "file_hash", "size", "mtime", "data_hash", "hash_ts")],
        *[v.alias(k) for k, v in owner.items()], path_col.alias("rel_path"), side.alias("scan_side"), "__order",
    )
    return last_wins(rows, "__order").select(*SNAPSHOT.names)


def scan_csv(rows: DataFrame) -> DataFrame:
    """SNAPSHOT rows as they are printed: hashes unsigned, in order of paths."""
    shown = {c: unsigned(F.col(c)) for c in ("folder_hash", "file_hash", "data_hash", "size", "mtime", "hash_ts")}
    return rows.select(*[shown.get(c, F.col(c)).alias(c) for c in SNAPSHOT.names]).orderBy("rel_path")


def write_scan_csv(rows: DataFrame, path: str) -> None:
    """One sorted file in the folder ``path``; sorting is spread over tasks, only the writing is not."""
    scan_csv(rows).coalesce(1).write.mode("overwrite").options(header=True, escape='"', quote='"').csv(path)


def text_lines(rows: DataFrame) -> DataFrame:
    """INVENTORY rows as lines of name=value; hashes and run only where there are any."""

    def pair(name: str, value: Column | None = None) -> Column:
        return F.concat(F.lit(f"{name}="), F.col(name).cast("string") if value is None else value)

    def quoted(name: str) -> Column:
        return pair(name, text_quoted(F.col(name)))

    is_file = F.col("record_type") == "file"
    stats = [pair(n) for n in ("mtime", "mode", "uid", "gid")]
    hashed = (F.coalesce("hash_algorithm", F.lit("")) != "") | (F.coalesce("content_hash", F.lit("")) != "")
    blocks = (F.coalesce("block_hash_algorithm", F.lit("")) != "") | (F.coalesce("block_hashes", F.lit("")) != "")
    line = F.concat_ws(
        " ",
        F.col("record_type"), quoted("rel_path"), F.when(is_file, pair("size")), *stats,
        F.when(~is_file, pair("flat_file_count")), F.when(~is_file, pair("flat_logical_size_bytes")),
        *[F.when(hashed, quoted(n)) for n in ("hash_algorithm", "content_hash")],
        *[F.when(blocks, pair(n)) for n in ("hash_block_size", "hash_block_count")],
        *[F.when(blocks, quoted(n)) for n in ("block_hash_algorithm", "block_hashes")],
        *[F.when(F.col("scan_run_id").isNotNull(), quoted(n)) for n in ("scan_run_id", "run_started_at_utc")],
        F.when(F.col("scan_run_id").isNotNull(), pair("run_started_unix_ns")),
        *[F.when(F.col("scan_run_id").isNotNull(), quoted(n)) for n in ("source_root", "run_settings")],
    )
    return rows.select(line.alias("value"))


def csv_lines(rows: DataFrame) -> DataFrame:
    """INVENTORY rows as lines of CSV without a header: empty text in quotes, null as nothing."""
    texts = {f.name for f in INVENTORY.fields if f.dataType == StringType()}
    fields = [csv_quoted(F.col(n), quote_empty=True) if n in texts else F.col(n).cast("string") for n in INVENTORY.names]
    return rows.select(F.concat_ws(",", *[F.coalesce(f, F.lit("")) for f in fields]).alias("value"))


def write_inventory(
    rows: DataFrame, path: str, kind: str | None = None, files: bool = True, folders: bool = True, partitions: int | None = None,
    compression: str = "zstd", append: bool = False,
) -> None:
    """Write INVENTORY rows to the folder ``path``, in parts, by Spark's commit protocol.

    Parquet can be appended to, so that one table holds several runs, each in a
    partition of its own. Text and CSV are written anew each time.
    """
    kind = parse_format(kind) if kind else infer_format(path)
    rows = selected(rows, files, folders)
    if partitions:
        rows = rows.repartition(partitions)
    if kind == "parquet":
        out = rows.write.mode("append" if append else "overwrite").option("compression", compression)
        (out.partitionBy("scan_run_id") if append else out).parquet(path)
    elif append:
        raise ValueError("only parquet output can be appended to")
    elif kind == "csv":
        rows.write.mode("overwrite").options(header=True, emptyValue='""', nullValue="", escape='"', quoteAll=False).csv(path)
    else:
        text_lines(rows).write.mode("overwrite").text(path)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """INVENTORY rows of a Parquet table, of one run or many."""
    rows = spark.read.parquet(path)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in INVENTORY.fields])


def summary_line(row, command: str) -> str:
    """key=value pairs of a summary row."""
    return " ".join([command, *(f"{k}={v}" for k, v in row.asDict().items())])
