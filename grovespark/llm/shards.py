"""Training order: a keyed permutation gives every sequence its slot; shards hold records of one size, in order of slots."""

from __future__ import annotations

import functools
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from grovespark.llm.common import table
from grovespark.llm.packing import CAPACITY, MAX_WASTE, TASK_BITS, sequences
from grovespark.llm.tokens import default_vocabulary, verify
from grovespark.shared import mounted, new_path
from grovespark.ship import by_value

KEY = 0x7261696E
#: Sequences in a shard.
PER_SHARD = 4096
#: Shards that one task writes at most, about 130 MB.
SHARDS_IN_TASK = 16
ROUNDS = 6
#: A record: the number of tokens, then that many ids, then zeros up to the stride.
HEADER, HEADER_BYTES = "<I", 4


def id_bytes(ids: int) -> int:
    """Bytes of an id in a vocabulary of so many: two, or four where two do not hold them all."""
    return 2 if ids <= 1 << 16 else 4


#: Sequences that a dictionary for the shuffle is made from, and its bytes.
DICTIONARY_ROWS, DICTIONARY_BYTES = 2000, 64_000


def dictionary(rows: DataFrame) -> bytes:
    """What the shuffle's compression starts from: common ids. Empty if there are too few sequences to make one of."""
    import zstandard

    some = [bytes(r["tokens"]) for r in rows.select("tokens").limit(DICTIONARY_ROWS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, some).as_bytes()
    except zstandard.ZstdError:
        return b""


@functools.lru_cache(maxsize=2)
def codec(known: bytes):
    """(compressor, decompressor) for single sequences. Ids of 2 KB by themselves hardly shrink; by common ids they halve."""
    import zstandard

    given = zstandard.ZstdCompressionDict(known) if known else None
    return zstandard.ZstdCompressor(level=6, dict_data=given), zstandard.ZstdDecompressor(dict_data=given)


def stride(capacity: int = CAPACITY, width: int = 2) -> int:
    return HEADER_BYTES + width * capacity


def _round(x: np.ndarray, key: int, number: int, mask: np.uint64) -> np.ndarray:
    z = x + np.uint64((key + 0x9E3779B97F4A7C15 * (number + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) & mask


def slots(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of 0 to n-1. Values that the Feistel network takes beyond n go round again until they are not."""
    half = max(1, ((max(1, n - 1)).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = index.astype(np.uint64)
    if n <= 1:
        return out.astype(np.int64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for i in range(ROUNDS):
            left, right = right, left ^ _round(right, key, i, mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def positions(slot: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The inverse of ``slots``: which sequence stands in a slot."""
    half = max(1, ((max(1, n - 1)).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = slot.astype(np.uint64)
    if n <= 1:
        return out.astype(np.int64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for i in reversed(range(ROUNDS)):
            left, right = right ^ _round(left, key, i, mask), left
        out[todo] = left << shift | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def packed_sequences(
    docs: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, max_waste: float = MAX_WASTE, vocabulary: str | None = None
) -> DataFrame:
    """(task, place, doc_ids, n_tokens, tokens as ids of two or four bytes): the sequences of harmonic packing, numbered within each task."""
    path = vocabulary or default_vocabulary()
    width = id_bytes(verify(path))
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None
        task = TaskContext.get().partitionId()

        def seen():
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field(0).type
                yield batch

        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            kinds = [pa.int64(), pa.int64(), pa.list_(id_type), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["task", "place", "doc_ids", "n_tokens", "tokens"]
            )

        for number, pieces in sequences(seen(), path, capacity, max_waste):
            ids = np.concatenate([p.ids for p in pieces])
            owners = list(dict.fromkeys(p.doc for p in pieces))
            rows.append((task, number & ((1 << TASK_BITS) - 1), owners, len(ids), ids.astype(f"<u{width}").tobytes()))
            if len(rows) >= 512:
                yield flush()
        if rows:
            yield flush()

    schema = T.StructType(
        [
            T.StructField("task", T.LongType()),
            T.StructField("place", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(kind)),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("tokens", T.BinaryType()),
        ]
    )
    return docs.select(id_col, text_col).mapInArrow(run, schema)


@dataclass
class Order:
    rows: DataFrame
    n: int
    per_shard: int
    capacity: int
    width: int


def training_order(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    key: int = KEY,
    per_shard: int = PER_SHARD,
    capacity: int = CAPACITY,
    vocabulary: str | None = None,
) -> Order:
    """Pack documents into sequences and put them in training order.

    ``rows`` has (doc_ids, n_tokens, tokens, slot, shard, record_offset), partitioned
    by ranges of whole shards and sorted by slot. Slots are 0 to n-1 without gaps.

    Texts are tokenised once; the sequences are written to the shared checkpoint
    folder as Parquet, of which the counts for each task are read (one number a
    task reaches the driver). A sequence's number is its task's first number and
    its place there; the permutation makes slots of these, evenly over all
    partitions whatever the input's skew, and tokens are shuffled once, each
    sequence compressed by itself.

    Null and empty texts are one end token. Repeated rows and equal or null ids
    are sequences like others. An empty table gives no rows; other columns are
    left out.
    """
    spark = docs.sparkSession
    width = id_bytes(verify(vocabulary or default_vocabulary()))
    path = new_path(spark, "sequences")
    packed = packed_sequences(docs, id_col, text_col, capacity, vocabulary=vocabulary)
    packed.write.option("compression", "zstd").parquet(path)
    stored = spark.read.parquet(path)
    known = dictionary(stored)
    counts = sorted((r["task"], r["n"]) for r in stored.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect())
    first, n = {}, 0
    for task, count in counts:
        first[task], n = n, n + count
    tasks = np.array(sorted(first), dtype=np.int64)
    firsts = np.array([first[t] for t in sorted(first)], dtype=np.int64)

    @F.pandas_udf("long")
    def slot_of(task, place):
        import pandas as pd

        index = firsts[np.searchsorted(tasks, task.to_numpy())] + place.to_numpy()
        return pd.Series(slots(index, n, key))

    @F.arrow_udf(T.BinaryType())
    def small(tokens: pa.Array) -> pa.Array:
        return pa.array([codec(known)[0].compress(t.as_py()) for t in tokens], pa.binary())

    @F.arrow_udf(T.BinaryType())
    def whole(tokens: pa.Array) -> pa.Array:
        return pa.array([codec(known)[1].decompress(t.as_py()) for t in tokens], pa.binary())

    shards = max(1, -(-n // per_shard))
    parts = max(min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-shards // SHARDS_IN_TASK))
    rows = stored.withColumns({"slot": slot_of("task", "place"), "tokens": small("tokens")})
    shard = F.floor(F.col("slot") / per_shard)
    rows = rows.withColumns(
        {"shard": shard.cast("long"), "record_offset": (F.pmod("slot", F.lit(per_shard)) * stride(capacity, width)).cast("long")}
    )
    rows = rows.drop("task", "place").repartitionById(parts, F.floor(F.col("shard") * parts / shards).cast("int"))
    rows = rows.sortWithinPartitions("slot").withColumn("tokens", whole("tokens"))
    return Order(rows, n, per_shard, capacity, width)


def record(tokens: bytes, capacity: int = CAPACITY, width: int = 2) -> bytes:
    return (struct.pack(HEADER, len(tokens) // width) + tokens).ljust(stride(capacity, width), b"\0")


class ShardSource(DataSource):
    """Write with ``format("grovespark_shards")`` and the options path, n, per_shard, capacity and width.

    ``path`` is a folder of a file system that is mounted on all executors and the
    driver; paths of other schemes are refused. Each shard is written by one
    task to a name of its own and takes its final name when it is whole, so a
    task that is run again, or twice at once, leaves whole shards.
    """

    @classmethod
    def name(cls) -> str:
        return "grovespark_shards"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return ShardWriter(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    shards: list[tuple[int, int, int]]


class ShardWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path = mounted(options["path"])
        self.n, self.per_shard, self.capacity, self.width = (int(options[k]) for k in ("n", "per_shard", "capacity", "width"))

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        done, at, file, crc, count = [], None, None, 0, 0

        def close() -> None:
            file.flush()
            os.fsync(file.fileno())
            file.close()
            os.replace(file.name, shard_path(self.path, at))
            done.append((at, count, crc))

        for row in iterator:
            shard, slot = row["shard"], row["slot"]
            if shard != at:
                if file:
                    close()
                at, crc, count = shard, 0, 0
                file = open(f"{self.path}/.{shard}-{uuid.uuid4().hex}", "wb")
            if slot != shard * self.per_shard + count:
                raise ValueError(f"shard {shard}: slot {slot} is out of order")
            raw = record(bytes(row["tokens"]), self.capacity, self.width)
            file.write(raw)
            crc, count = zlib.crc32(raw, crc), count + 1
        if file:
            close()
        return Written(done)

    def commit(self, messages: Sequence[Written]) -> None:
        shards = sorted(s for m in messages if m for s in m.shards)
        if sum(count for _, count, _ in shards) != self.n:
            raise ValueError("sequences are missing")
        os.makedirs(self.path, exist_ok=True)
        for shard, count, _ in shards:
            name = shard_path(self.path, shard)
            if not os.path.isfile(name) or os.path.getsize(name) != count * stride(self.capacity, self.width):
                raise ValueError(f"{name} is not there or not whole: executors do not share the folder")
        content = {
            "n": self.n, "per_shard": self.per_shard, "capacity": self.capacity, "id_bytes": self.width,
            "stride": stride(self.capacity, self.width), "shards": shards,
        }
        with open(f"{self.path}/.index", "w") as file:
            json.dump(content, file)
        os.replace(f"{self.path}/.index", f"{self.path}/index.json")

    def abort(self, messages: Sequence[Written]) -> None:
        for name in os.listdir(self.path) if os.path.isdir(self.path) else ():
            if name.startswith("."):
                os.remove(f"{self.path}/{name}")


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def write_shards(order: Order, path: str) -> None:
    """One file a shard in the shared folder ``path``, and ``index.json`` last."""
    spark = order.rows.sparkSession
    by_value(__name__)
    by_value(mounted.__module__)
    spark.dataSource.register(ShardSource)
    order.rows.select("slot", "shard", "tokens").write.format("grovespark_shards").mode("append").options(
        path=path, n=order.n, per_shard=order.per_shard, capacity=order.capacity, width=order.width
    ).save()


def read_records(path: str, start: int = 0, stop: int | None = None) -> Iterator[np.ndarray]:
    """The token ids of the slots from ``start`` on: a reader that stopped goes on at any slot."""
    path = mounted(path)
    with open(f"{path}/index.json") as file:
        index = json.load(file)
    n, per_shard, size, kind = index["n"], index["per_shard"], index["stride"], f"<u{index['id_bytes']}"
    at, stop = start, n if stop is None else min(stop, n)
    while at < stop:
        shard, place = divmod(at, per_shard)
        with open(shard_path(path, shard), "rb") as file:
            file.seek(place * size)
            for _ in range(min(stop - at, per_shard - place)):
                raw = file.read(size)
                (count,) = struct.unpack_from(HEADER, raw)
                yield np.frombuffer(raw, dtype=kind, count=count, offset=HEADER_BYTES)
                at += 1


def written_records(order: Order, path: str) -> DataFrame:
    """(slot, shard, record_offset, n_tokens, record_crc32, doc_ids), all but ``doc_ids`` as found in the files under ``path``."""
    folder, size, per_shard = mounted(path), stride(order.capacity, order.width), order.per_shard
    kind = order.rows.schema["doc_ids"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file = None, None
        try:
            for batch in batches:
                shards, places, counts, crcs = [], [], [], []
                for slot in batch.column(0).to_pylist():
                    shard, place = divmod(slot, per_shard)
                    if shard != at:
                        if file:
                            file.close()
                        at, file = shard, open(shard_path(folder, shard), "rb")
                    file.seek(place * size)
                    raw = file.read(size)
                    if len(raw) != size:
                        raise ValueError(f"shard {shard}: no whole record for slot {slot}")
                    shards.append(shard)
                    places.append(place * size)
                    counts.append(struct.unpack_from(HEADER, raw)[0])
                    crcs.append(zlib.crc32(raw))
                cols = [batch.column(0), *(pa.array(c, pa.int64()) for c in (shards, places, counts, crcs)), batch.column(1)]
                yield pa.RecordBatch.from_arrays(cols, names=["slot", "shard", "record_offset", "n_tokens", "record_crc32", "doc_ids"])
        finally:
            if file:
                file.close()

    rows = order.rows.select("slot", "doc_ids")
    return rows.mapInArrow(run, f"slot long, shard long, record_offset long, n_tokens long, record_crc32 long, doc_ids {kind}")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the shards beside the checkpoints and reads its rows' records back from them."""
    order = training_order(table(spark, sf_dir, "documents"))
    path = new_path(spark, "shards")
    write_shards(order, path)
    return written_records(order, path)
