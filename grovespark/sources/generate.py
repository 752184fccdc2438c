"""Inventories and bytes made by rule: the same for one seed, on any number of tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.functions.u64 import lit64, splitmix64, umod, with_splitmix64

FIRST_MTIME = 1_700_000_000_000_000_000
#: Fixed value: the alphabet of quick text.
ALPHABET = b"-_0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def generated_size(index: Column, seed: int, average: int) -> Column:
    """1 to twice the average, by a hash of seed and index; 0 if the average is 0."""
    return _size(splitmix64(index.bitwiseXOR(lit64(seed))), average)


def _size(hashed: Column, average: int) -> Column:
    return F.greatest(F.lit(1).cast("long"), umod(hashed, 2 * average)) if average else F.lit(0).cast("long")


def padded(number: Column, digits: int) -> Column:
    """A number that is not negative, with leading zeros."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(digits), F.length(text)), "0")


def _common(index: Column, mode: int) -> dict[str, Column]:
    return {
        "mtime": (F.lit(FIRST_MTIME) + index).cast("long"),
        "mode": F.lit(mode),
        "uid": (1000 + index % 97).cast("int"),
        "gid": (1000 + index % 89).cast("int"),
    }


def generated_files(spark: SparkSession, files: int, folders: int, average: int = 1024, seed: int = 123, root: str = "synthetic") -> DataFrame:
    """(rel_path, size, mtime, mode, uid, gid): file i lies in folder i modulo their number."""
    i = F.col("id")
    path = F.concat(F.lit(f"{root}/dir_"), padded(i % max(1, folders), 8), F.lit("/file_"), padded(i, 12), F.lit(".dat"))
    columns = {"rel_path": path, "size": _size(F.col("hashed"), average)} | _common(i, 0o644)
    rows = spark.range(files).withColumn("hashed", i.bitwiseXOR(lit64(seed)))
    return with_splitmix64(rows, "hashed", "hashed").select(*[v.alias(k) for k, v in columns.items()])


def generated_folders(spark: SparkSession, files: int, folders: int, average: int = 1024, root: str = "synthetic") -> DataFrame:
    """Folders with their counts; their bytes are count times average, not the sum of the files' sizes."""
    i = F.col("id")
    n = F.lit(files // folders if folders else 0) + F.when(i < (files % folders if folders else 0), 1).otherwise(0)
    columns = {"rel_path": F.concat(F.lit(f"{root}/dir_"), padded(i, 8))} | _common(i, 0o755)
    columns |= {"flat_file_count": n.cast("long"), "flat_logical_size_bytes": (n * average).cast("long")}
    return spark.range(folders).select(*[v.alias(k) for k, v in columns.items()])


def splitmix(value: np.ndarray) -> np.ndarray:
    z = value + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def generated_buffers(spark: SparkSession, count: int, size: int, kind: str = "zero", seed: int = 1, ratio: float = 1.0) -> DataFrame:
    """(id, data): buffers of zeros, quick text or pseudo-random bytes, of which 1/``ratio`` is filled and the rest zero.

    Bytes are those of splitmix64 of a number of the buffer's own and the word's place, the lowest first; text takes
    six bits of each.
    """
    kinds = {"zero": "zero", "fast_text": "text", "random_text": "text", "xoshiro256": "random", "pseudo_random": "random"}
    if kind not in kinds:
        raise ValueError(f"buffer kind must be one of {', '.join(kinds)}")
    if ratio < 1:
        raise ValueError("compression ratio must be 1 or more")
    what, filled = kinds[kind], int(round(size / ratio))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.frombuffer(ALPHABET, dtype=np.uint8)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                data = b""
                if what != "zero":
                    own = splitmix(np.array([i ^ seed], dtype=np.uint64))
                    raw = splitmix(own + np.arange(-(-filled // 8), dtype=np.uint64)).astype("<u8").view(np.uint8)[:filled]
                    data = (letters[raw & 63] if what == "text" else raw).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([data.ljust(size, b"\0")], pa.binary())], names=["id", "data"])

    return spark.range(count).mapInArrow(fill, "id long, data binary")
