"""What the text operators share: reading tables, cutting lineage, small helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.shared import cut_lineage  # noqa: F401

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The white space the contracts name: blank and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names, in whatever case: an operator's own columns take their place."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken]) if taken & {c.lower() for c in df.columns} else df


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns of these names, in whatever case, under free names; and what gives them their names back."""
    taken = {n.lower() for n in names}
    new = {c: n for c, n in zip(df.columns, free_names(df, *df.columns), strict=True) if c.lower() in taken}
    return df.withColumnsRenamed(new), {n: c for c, n in new.items()}


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores at its end as no column of ``df`` has: for columns of an operator's own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. ``lower`` is the fast way where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_LOWER)
    )


def hash_pair(*cols: Column) -> tuple[Column, Column]:
    """128 bits of hash in two longs; with 64 bits alone, 10^11 distinct lines would collide."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)
