"""Content hashes, block hashes, and the hashes that name paths and folders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovespark.functions.paths import base_name, normalize_path
from grovespark.functions.u64 import lit64, mix64, mul64, signed, sum64, unsigned_key

#: The fold of a folder's data starts here, its metadata's there, and sums are weighted by this prime.
DATA_SEED = 2870177450012600261
METADATA_SEED = 0x4859464C41544648
METADATA_PRIME = 11400714785074694791

#: Names by which a hash may be called.
ALGORITHMS = {
    "md5": ("md5", "md5sum", "MD5"),
    "sha256": ("sha256", "sha-256", "sha256sum", "SHA256", "SHA-256"),
    "xxh64": ("xxh64", "xxhash64", "xxhsum", "XXH64"),
    "xxh3_64": ("xxh3", "xxh3_64", "xxh3-64", "xxh3_64bits", "XXH3", "XXH3_64"),
    "xxh3_128": ("xxh128", "xxh3_128", "xxh3-128", "xxh3_128bits", "XXH128", "XXH3_128"),
}


def parse_algorithm(name: str) -> str:
    for known, names in ALGORITHMS.items():
        if name in names:
            return known
    raise ValueError(f"no such hash: {name}; known are {', '.join(ALGORITHMS)}")


def _raw(value) -> bytes:
    return value.encode("utf-8", "surrogatepass") if isinstance(value, str) else bytes(value)


@F.pandas_udf(T.LongType())
def xxh64(content: pd.Series) -> pd.Series:
    """XXH64 with seed 0 of text or bytes, as a 64-bit pattern. (The built-in function's seed is 42.)"""
    import xxhash

    return pd.Series([None if v is None else signed(xxhash.xxh64_intdigest(_raw(v))) for v in content], dtype="Int64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def component_hashes(path: pd.Series) -> pd.Series:
    """XXH64 of each part of a normalized path; none of the empty path."""
    import xxhash

    known: dict[str, int] = {}

    def one(part: str) -> int:
        if part not in known:
            known[part] = signed(xxhash.xxh64_intdigest(_raw(part)))
        return known[part]

    return pd.Series([None if p is None else [one(c) for c in p.split("/")] if p else [] for p in path])


def _hex_udf(function: str):
    @F.pandas_udf(T.StringType())
    def digest(content: pd.Series) -> pd.Series:
        import xxhash

        of = getattr(xxhash, function)
        return pd.Series([None if v is None else of(_raw(v)) for v in content], dtype="object")

    return digest


def content_hash(content: Column, algorithm: str = "sha256") -> Column:
    """The digest in lower-case hexadecimal. md5 and sha256 are built in; the others go through Arrow."""
    known = parse_algorithm(algorithm)
    if known == "md5":
        return F.md5(content)
    if known == "sha256":
        return F.sha2(content, 256)
    return _hex_udf({"xxh64": "xxh64_hexdigest", "xxh3_64": "xxh3_64_hexdigest", "xxh3_128": "xxh3_128_hexdigest"}[known])(content)


def block_count(size: Column, block_size: int) -> Column:
    """Blocks of a file; an empty file has none."""
    return F.ceil(size / F.lit(block_size)).cast("long")


def block_hashes(content: Column, block_size: int, algorithm: str = "md5") -> Column:
    """Digests of the blocks, joined by semicolons; empty for an empty file."""
    known = parse_algorithm(algorithm)
    if known in ("md5", "sha256"):
        n = block_count(F.octet_length(content), block_size)
        digests = F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1),
            lambda i: content_hash(F.substring(content, (i * block_size + 1).cast("int"), F.lit(block_size)), known),
        )
        return F.when(F.octet_length(content) == 0, F.lit("")).otherwise(F.array_join(digests, ";"))
    function = {"xxh64": "xxh64_hexdigest", "xxh3_64": "xxh3_64_hexdigest", "xxh3_128": "xxh3_128_hexdigest"}[known]

    @F.pandas_udf(T.StringType())
    def digests_of(values: pd.Series) -> pd.Series:
        import xxhash

        of = getattr(xxhash, function)
        out = []
        for v in values:
            raw = None if v is None else _raw(v)
            out.append(None if raw is None else ";".join(of(raw[i : i + block_size]) for i in range(0, len(raw), block_size)))
        return pd.Series(out, dtype="object")

    return digests_of(content)


def chunk_hash32(content: Column) -> Column:
    """The two halves of XXH64, one upon the other, as a number from 0 to 2^32-1."""
    h = xxh64(content)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 32)).bitwiseAND(F.lit(0xFFFFFFFF))


def path_hash(name_hash: Column, parent_hash: Column) -> Column:
    """A path's identity, from the hash of its name and the identity of its folder."""
    return mix64(name_hash, parent_hash)


def folder_hash(path: Column) -> Column:
    """A path's identity, from the hashes of all its parts; 0 for the root."""
    return F.aggregate(component_hashes(normalize_path(path)), F.lit(0).cast("long"), lambda above, h: path_hash(h, above))


def child_hash(
    name_hash: Column, is_file: Column, size: Column, mtime: Column, mode: Column, uid: Column, gid: Column, compare_mode: str
) -> Column:
    """What a folder's metadata hash takes of a child. Folders count with size 0."""
    out = mix64(name_hash, F.when(is_file, F.lit(1)).otherwise(F.lit(2)).cast("long"))
    out = mix64(out, F.when(is_file, size.cast("long")).otherwise(F.lit(0).cast("long")))
    if compare_mode in ("time", "content", "metadata"):
        out = mix64(out, mtime.cast("long"))
    if compare_mode == "metadata":
        for column in (mode, uid, gid):
            out = mix64(out, column.cast("long"))
    return out


def folder_metadata_hash(
    children: DataFrame, folder: str, child: str = "child_hash", is_file: str = "is_file", size: str = "size"
) -> DataFrame:
    """(folder, metadata_hash): the same whatever the order of a folder's children.

    Exclusive or, sum, count and bytes, so all of it is partly made before the shuffle.
    """
    c, f = F.col(child), F.col(is_file)
    parts = children.groupBy(folder).agg(
        F.count_if(f).alias("__files"),
        F.count_if(~f).alias("__folders"),
        F.coalesce(F.sum(F.when(f, F.col(size).cast("long"))), F.lit(0)).cast("long").alias("__bytes"),
        F.bit_xor(c).alias("__xor"),
        sum64(mul64(c, METADATA_PRIME)).alias("__sum"),
    )
    out = lit64(METADATA_SEED)
    for name in ("__files", "__folders", "__bytes", "__xor", "__sum"):
        parts = parts.withColumn("metadata_hash", mix64(out, F.col(name)))
        out = F.col("metadata_hash")
    return parts.select(folder, "metadata_hash")


def folder_data_hash(files: DataFrame, folder: str, file_hash: str = "file_hash", data_hash: str = "data_hash") -> DataFrame:
    """(folder, data_hash): a fold over a folder's files in the order of their unsigned hashes.

    The order matters, so a folder's rows must pass one task; they are sorted by
    the shuffle and folded as they stream by, and never held together. A folder
    of many files costs time in that task but no memory.
    """
    name = folder
    kind = files.schema[folder].dataType.simpleString()
    rows = files.select(F.col(folder), F.col(file_hash).alias("f"), F.col(data_hash).alias("d"))
    rows = rows.repartition(folder).sortWithinPartitions(F.col(folder), unsigned_key(F.col("f")), unsigned_key(F.col("d")))

    def fold(batches):
        mask = (1 << 64) - 1
        golden = 0x9E3779B97F4A7C15
        at, value, begun = None, DATA_SEED, False
        for batch in batches:
            out = []
            for key, *pair in zip(batch.iloc[:, 0], batch["f"], batch["d"], strict=True):
                if not begun or key != at:
                    if begun:
                        out.append((at, signed(value)))
                    at, value, begun = key, DATA_SEED, True
                for v in pair:
                    value ^= ((int(v) & mask) + golden + (value << 6 & mask) + (value >> 2)) & mask
            if out:
                yield pd.DataFrame(out, columns=[name, "folder_data_hash"])
        if begun:
            yield pd.DataFrame([(at, signed(value))], columns=[name, "folder_data_hash"])

    return rows.mapInPandas(fold, f"`{folder}` {kind}, folder_data_hash long")


def with_identity(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """Adds ``folder_hash`` and ``file_hash``: who the folder and who the path is."""
    from grovespark.functions.paths import parent_path

    p = normalize_path(F.col(path))
    out = files.withColumn("folder_hash", folder_hash(parent_path(p)))
    return out.withColumn("file_hash", path_hash(xxh64(base_name(p)), F.col("folder_hash")))
