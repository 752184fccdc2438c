"""Harmonic packing: pieces of documents in bins by reciprocal-capacity classes.

A piece of class k is longer than capacity/(k+1) and at most capacity/k tokens; a
bin of class k takes exactly k pieces. A document is first cut into whole bins of
``capacity``; its rest goes to its class if k such pieces leave little of a bin
unused, else a piece that fills its class to the brim is cut off, and so on. Each
task keeps one open bin a class, so tasks work independently, without a shuffle.

A sequence whose length is a power of two is not padded. What is left in a task's
open bins at its end is therefore put in a row and cut at powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from grovespark.llm.common import table
from grovespark.llm.tokens import default_vocabulary, load, token_ids, verify

CAPACITY = 1024
#: The part of a bin that a class may leave unused before its pieces are cut smaller.
MAX_WASTE = 0.01
#: Sequence ids: the task's partition in the high bits, the bin's number within it in the low ones.
TASK_BITS = 40
#: Rows of output that are sent on at once, and bytes of ids, but for the sequence that goes beyond.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20


def cuts(n: int, capacity: int = CAPACITY, max_waste: float = MAX_WASTE) -> list[tuple[int, int]]:
    """(length, class) of the pieces of ``n`` tokens, in order."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= max_waste * capacity:
            out.append((rest, k))
            break
        size = capacity // (k + 1)
        out.append((size, k + 1))
        rest -= size
    return out


@dataclass
class Piece:
    doc: object
    start: int
    ids: np.ndarray
    doc_tokens: int


class Packer:
    """The open bins of one task. A bin holds fewer than ``capacity`` tokens, and there are as many as classes."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY, max_waste: float = MAX_WASTE):
        self.next, self.capacity, self.max_waste = first_sequence, capacity, max_waste
        self.open: dict[int, list[Piece]] = {}

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple[int, list[Piece]]]:
        """Takes a document; yields the sequences (id, pieces) that it completes."""
        at = 0
        for length, k in cuts(len(ids), self.capacity, self.max_waste):
            pieces = self.open.setdefault(k, [])
            # A view of a piece that waits would keep the whole document's ids.
            pieces.append(Piece(doc, at, ids[at : at + length] if k == 1 else ids[at : at + length].copy(), len(ids)))
            at += length
            if len(pieces) == k:
                yield self.close(self.open.pop(k))

    def finish(self) -> Iterator[tuple[int, list[Piece]]]:
        """The pieces of all open bins in a row, cut at powers of two, the largest first."""
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p.ids) for p in pieces)
        while left:
            room = min(self.capacity, 1 << (left.bit_length() - 1))
            left -= room
            some = []
            while room:
                p = pieces.pop(0)
                if len(p.ids) > room:
                    pieces.insert(0, Piece(p.doc, p.start + room, p.ids[room:], p.doc_tokens))
                    p = Piece(p.doc, p.start, p.ids[:room], p.doc_tokens)
                room -= len(p.ids)
                some.append(p)
            yield self.close(some)

    def close(self, pieces: list[Piece]) -> tuple[int, list[Piece]]:
        self.next += 1
        return self.next - 1, pieces


PIECES = [
    ("start", pa.int64(), T.LongType()),
    ("length", pa.int64(), T.LongType()),
    ("ids_crc32", pa.int64(), T.LongType()),
    ("doc_tokens", pa.int64(), T.LongType()),
    ("sequence_id", pa.int64(), T.LongType()),
    ("offset", pa.int64(), T.LongType()),
]


def sequences(batches: Iterator[pa.RecordBatch], vocabulary: str, capacity: int, max_waste: float):
    """(id, pieces) of one task's documents: batches with the columns id and text."""
    context = TaskContext.get()
    packer = Packer((context.partitionId() if context else 0) << TASK_BITS, capacity, max_waste)
    encoder = load(vocabulary)
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield from packer.add(doc, token_ids(encoder, text.as_py()))
    yield from packer.finish()


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    max_waste: float = MAX_WASTE,
    vocabulary: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """One row for each piece: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and, with ``with_ids``, ``ids`` (the tokens as little-endian 32-bit numbers).

    Tokens are those of ``tokens.py`` with an end token 0 after each document, so
    a null or empty text is one token. Each token is in one piece, and offsets
    have no gaps. A task makes whole sequences, so a task that is run again
    gives whole sequences anew. Documents with equal or null ids and repeated
    rows are packed like any other, in the order in which they come. A very long
    text is tokenised whole, and its pieces sent on as they are cut. An empty
    table gives no rows; other columns are left out.
    """
    path = vocabulary or default_vocabulary()
    verify(path)
    some = docs.select(id_col, text_col)
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *[T.StructField(n, t) for n, _, t in PIECES]]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = None

        def seen(batches):
            nonlocal id_type
            for batch in batches:
                id_type = batch.schema.field(0).type
                yield batch

        rows: list[tuple] = []
        used = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = [id_type, *(a for _, a, _ in PIECES), *([pa.binary()] if with_ids else [])]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=schema.names)

        for number, pieces in sequences(seen(batches), path, capacity, max_waste):
            offset = 0
            for p in pieces:
                raw = p.ids.tobytes()
                row = (p.doc, p.start, len(p.ids), zlib.crc32(raw), p.doc_tokens, number, offset)
                rows.append((*row, raw) if with_ids else row)
                offset += len(p.ids)
            used += 4 * offset if with_ids else 0
            if len(rows) >= BATCH_ROWS or used >= BATCH_BYTES:
                yield flush()
                used = 0
        if rows:
            yield flush()

    return some.mapInArrow(run, schema)


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
