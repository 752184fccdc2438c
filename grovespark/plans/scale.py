"""Generated inputs at sizes where throughput shows: for the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.functions import hashing
from grovespark.operators import diff as D
from grovespark.operators import inventory as I
from grovespark.sources import generate as G

FILES = 10_000_000
FOLDERS = FILES // 100
MEGABYTES = 4096


def _sides(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Two inventories of which every tenth file differs in size."""
    source = G.generated_files(spark, FILES, FOLDERS)
    return source, source.withColumn("size", F.col("size") + F.when(F.col("mtime") % 10 == 0, 1).otherwise(0))


def scale_diff(spark: SparkSession) -> DataFrame:
    return D.diff_summary(D.diff(*_sides(spark)))


def scale_diff_folders(spark: SparkSession) -> DataFrame:
    return D.folder_diff(D.diff(*_sides(spark)))


def scale_inventory(spark: SparkSession) -> DataFrame:
    return I.inventory(G.generated_files(spark, FILES, FOLDERS), G.generated_folders(spark, FILES, FOLDERS))


def _buffers(spark: SparkSession) -> DataFrame:
    """Buffers of a megabyte, made without Python."""
    return spark.range(MEGABYTES).select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("0123456789abcdef"), 65536)).cast("binary").alias("content"))


def scale_sha256(spark: SparkSession) -> DataFrame:
    return _buffers(spark).select(hashing.content_hash(F.col("content"), "sha256"))


def scale_md5(spark: SparkSession) -> DataFrame:
    return _buffers(spark).select(hashing.content_hash(F.col("content"), "md5"))


#: name: (query, what it handles, unit, whether it is written as Parquet instead of thrown away)
SCALE = {
    "scale_diff": (scale_diff, FILES, "records/s", False),
    "scale_diff_folders": (scale_diff_folders, FILES, "records/s", False),
    "scale_inventory_parquet": (scale_inventory, FILES + FOLDERS, "records/s", True),
    "scale_sha256": (scale_sha256, MEGABYTES / 1024, "GB/s", False),
    "scale_md5": (scale_md5, MEGABYTES / 1024, "GB/s", False),
}
