"""Payloads: chunks, packs of small files, reassembly, completion."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovespark.schemas import LARGE_CHUNK_BYTES, SMALL_FILE_THRESHOLD

#: What a pack of small files takes beside paths and data, and its size at most.
PACK_HEADER, PACK_ENTRY, PACK_BYTES = 24, 64, 1024 * 1024
MAX_PATH_BYTES = 3552


def chunk_plan(size: Column, threshold: int, chunk: int, body: Column | None = None) -> Column:
    """An array of (chunk_index, data_offset, data_len, is_small, is_last) and, with ``body``, data.

    A small file and an empty one have one chunk.
    """
    step = F.when(size <= threshold, F.lit(threshold)).otherwise(F.lit(chunk)).cast("long")
    n = F.greatest(F.ceil(size / step), F.lit(1)).cast("long")

    def one(i: Column) -> Column:
        length = F.least(step, size - i * step).cast("long")
        fields = [
            i.alias("chunk_index"),
            (i * step).alias("data_offset"),
            length.alias("data_len"),
            (size <= threshold).alias("is_small"),
            (i == n - 1).alias("is_last"),
        ]
        if body is not None:
            fields.append(F.substring(body, (i * step + 1).cast("int"), length.cast("int")).alias("data"))
        return F.struct(*fields)

    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), one)


def chunks(
    files: DataFrame, id_col: str = "file_id", content: str = "content", threshold: int = SMALL_FILE_THRESHOLD, chunk: int = LARGE_CHUNK_BYTES
) -> DataFrame:
    """One row a chunk: the id, file_size, the plan's columns and ``data``. A null content is empty.

    A file is cut up before its rows are made, so that none of them carries the whole.
    """
    if threshold <= 0 or chunk <= 0:
        raise ValueError("threshold and chunk size must be positive")
    body = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    size = F.octet_length(body).cast("long")
    return files.select(id_col, size.alias("file_size"), F.inline(chunk_plan(size, threshold, chunk, body)))


def completion(rows: DataFrame, id_col: str = "file_id") -> DataFrame:
    """(id, chunks, bytes, complete): complete with every chunk up to the last, in whatever order they came."""
    return rows.groupBy(id_col).agg(
        F.count_distinct("chunk_index").alias("chunks"),
        F.sum("data_len").cast("long").alias("bytes"),
        (F.max(F.when(F.col("is_last"), F.col("chunk_index") + 1)) == F.count_distinct("chunk_index")).alias("__all"),
    ).select(id_col, "chunks", "bytes", F.coalesce("__all", F.lit(False)).alias("complete"))


def reassembled(rows: DataFrame, id_col: str = "file_id") -> DataFrame:
    """(id, content) of chunks in any order. A file's bytes must fit one row, as they did before."""
    joined = F.expr("listagg(data) WITHIN GROUP (ORDER BY data_offset)")
    return rows.groupBy(id_col).agg(F.coalesce(joined, F.lit(b"")).alias("content"))


def acknowledged(sent: DataFrame, acks: DataFrame, id_col: str = "file_id") -> DataFrame:
    """``sent`` with ``state`` and ``error``: done, failed, or awaiting_ack where no answer has come.

    ``acks``: (id, ok, error), in any order and as often as they were sent again; one that says done counts.
    """
    best = acks.groupBy(F.col(id_col).alias("__ack")).agg(F.max("ok").alias("__ok"), F.max(F.when(~F.col("ok"), F.col("error"))).alias("__error"))
    state = F.when(F.col("__ok").isNull(), "awaiting_ack").when(F.col("__ok"), "done").otherwise("failed")
    out = sent.join(best, F.col(id_col) == F.col("__ack"), "left")
    return out.select(*sent.columns, state.alias("state"), F.when(~F.col("__ok"), F.col("__error")).alias("error"))


def last_chunk_rows(rows: DataFrame) -> DataFrame:
    """Only last chunks whose hash is valid become scan rows; their time of hashing is 0."""
    return rows.where(F.col("is_last") & F.col("hash_valid")).withColumn("hash_ts", F.lit(0).cast("long"))


def order_free_digest(hashes: Column) -> Column:
    """Aggregate: exclusive or, the same in any order."""
    return F.coalesce(F.bit_xor(hashes), F.lit(0).cast("long"))


def packs(files: DataFrame, path: str = "rel_path", content: str = "content", capacity: int = PACK_BYTES) -> DataFrame:
    """(pack_id, n_files, payload_bytes, bytes_used, entries): small files in batches of up to ``capacity`` bytes.

    Each task packs the files it has, in order, so nothing is shuffled. A file
    too large for an empty pack, or with too long a path, is an error.
    """
    body = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    rows = files.select(F.col(path).alias("rel_path"), body.alias("data"))
    entry = pa.struct([("rel_path", pa.string()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        held: list[dict] = []
        used = PACK_HEADER

        def flush() -> pa.RecordBatch:
            payload = sum(len(e["data"]) for e in held)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([len(held)]), pa.array([payload]), pa.array([used]), pa.array([list(held)], pa.list_(entry))],
                names=["pack_id", "n_files", "payload_bytes", "bytes_used", "entries"],
            )

        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = data.as_py()
                length = len(name.encode())
                needed = PACK_ENTRY + length + len(raw)
                if length > MAX_PATH_BYTES or PACK_HEADER + needed > capacity:
                    raise ValueError(f"{name} does not fit into a pack")
                if used + needed > capacity:
                    yield flush()
                    number, held, used = number + 1, [], PACK_HEADER
                held.append({"rel_path": name, "data": raw})
                used += needed
        if held:
            yield flush()

    return rows.mapInArrow(
        run, "pack_id long, n_files long, payload_bytes long, bytes_used long, entries array<struct<rel_path:string,data:binary>>"
    )


def unpacked(rows: DataFrame) -> DataFrame:
    """(pack_id, rel_path, data). A pack whose counts don't agree with its entries is an error."""
    bad = F.size("entries") != F.col("n_files")
    entries = F.when(bad, F.raise_error(F.lit("malformed pack")).cast("array<struct<rel_path:string,data:binary>>")).otherwise(F.col("entries"))
    return rows.select("pack_id", F.inline(entries))
