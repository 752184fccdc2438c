"""Incremental scans: rows that the last inventory does not know, written once however often a batch is tried."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def changed_since(scan: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows of a scan, a stream or a table, whose path, size and time the previous inventory lacks.

    With a stream the previous inventory is read anew for each batch.
    """
    known = previous.select(F.col("rel_path").alias("__p"), F.col("size").alias("__s"), F.col("mtime").alias("__m"))
    match = (F.col("rel_path") == F.col("__p")) & F.col("size").eqNullSafe(F.col("__s")) & F.col("mtime").eqNullSafe(F.col("__m"))
    if not scan.isStreaming:
        return scan.join(known, match, "left_anti")
    return scan.join(known, match, "left").where(F.col("__p").isNull()).drop("__p", "__s", "__m")


def write_batches(scan: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A stream writer into Parquet, one folder a batch: a batch that is tried again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return scan.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stop_after(query: StreamingQuery, seconds: float) -> dict | None:
    """Let a stream run for a time, end with a whole batch, and return its last progress."""
    query.awaitTermination(seconds)
    if query.isActive:
        query.processAllAvailable()
        query.stop()
    return query.lastProgress


def file_states(events: DataFrame, role: str = "sender") -> DataFrame:
    """(rel_path, state, moves, invalid): each file's last state and how many moves were not allowed.

    ``events``: (rel_path, sequence, state). A file's events are few; its moves
    are pairs of neighbours in order.
    """
    from pyspark.sql import Window

    from grovespark.functions.controls import allowed

    window = Window.partitionBy("rel_path").orderBy("sequence")
    before = F.coalesce(F.lag("state").over(window), F.lit("pending"))
    steps = events.withColumn("ok", allowed(F.lit(role), before, F.col("state")))
    return steps.groupBy("rel_path").agg(
        F.max_by("state", "sequence").alias("state"), F.count(F.lit(1)).alias("moves"), F.count_if(~F.col("ok")).alias("invalid")
    )
