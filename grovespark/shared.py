"""The folder that the driver and all executors share, and tables that are kept there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; one is made only where none is set and all runs in one process (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """A ``file:`` URI or plain path as a path; what ``open`` cannot reach is refused."""
    if scheme := re.match(r"([A-Za-z][A-Za-z0-9+.\-]*):/", path):
        if scheme[1].lower() != "file":
            raise ValueError(f"files are opened by their paths, in a folder that is mounted everywhere; not in {path}")
        path = "/" + path[scheme.end() :].lstrip("/")
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    The copy survives lost executors, and nothing above it is computed again.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
