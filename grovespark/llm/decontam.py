"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's words.

Any ten words in a row of an item hold one of its blocks of five that start at a
multiple of five. The automaton's patterns are these blocks, a node for each word
instead of ten, and what matches one is followed to both sides in the item: a run
of ten words or more is a hit. Where many places of the benchmark share a block,
the windows around them are patterns themselves, so that no block has many places
to be followed. A word is a number, spelled with as many letters as the benchmark's
vocabulary needs, so that a node has few children, which are searched one by one.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import repeat

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovespark.llm.common import cut_lineage, set_aside, table, without

WINDOW = 10
#: Words of the benchmark that one automaton takes, some 280 bytes each; more go to further automata, one pass over the documents each.
BLOCK_WORDS = 750_000
#: Places that are followed for one block of words at most.
MOST_PLACES = 8
#: Bytes of UTF-8 after normalisation: a word's byte as it is (A-Z in lower case), all else a blank.
NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
WORD = re.compile(rb"[^ ]+")


def words_of(text: str | None) -> list[bytes]:
    """Words: runs of 0-9, a-z (A-Z in lower case) and all that is not ASCII. Null has none."""
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


#: Children that a node of the automaton has at most.
BASE = 32


def spelled(number: int, letters: int) -> str:
    """A number as text of so many letters. Each place has letters of its own, so no match starts within a word."""
    return "".join(chr(1 + BASE * i + number // BASE**i % BASE) for i in range(letters))


class Machine:
    """The automaton of a list of items (id, text)."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        import ahocorasick

        self.window = window
        texts: list[tuple[int, ...]] = []
        self.names: list[str] = []
        numbers: dict[bytes, int] = {}
        size = (window + 1) // 2
        blocks: Counter[tuple[int, ...]] = Counter()
        for name, text in items:
            found = tuple([numbers.setdefault(w, len(numbers)) for w in words_of(text)])
            if found:
                texts.append(found)
                self.names.append(name)
                if len(found) >= window:
                    blocks.update(found[at : at + size] for at in range(0, len(found) - size + 1, size))
        letters = 1
        while BASE**letters < len(numbers):
            letters += 1
        #: How words are spelled, and how all others are.
        self.letters, self.other = letters, "\0" * letters
        self.spelling = {w: spelled(n, letters) for w, n in numbers.items()}
        # What is followed: (text, place) by block. What is a hit as it is: whole windows and short items, with their texts.
        followed: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        whole: dict[tuple[int, ...], list[int]] = {}
        for k, found in enumerate(texts):
            if len(found) < window:
                whole.setdefault(found, []).append(k)
                continue
            rare = []
            for at in range(0, len(found) - size + 1, size):
                block = found[at : at + size]
                rare.append(blocks[block] <= MOST_PLACES)
                if rare[-1]:
                    followed.setdefault(block, []).append((k, at))
            for i in range(len(found) - window + 1):
                if not any(rare[-(-i // size) : (i + window) // size]):
                    owners = whole.setdefault(found[i : i + window], [])
                    if not owners or owners[-1] != k:
                        owners.append(k)
        #: By number of a pattern: its length in words, the places to follow, and the texts that it is a hit of.
        self.values: list[tuple[int, Sequence[tuple[int, int]], Sequence[int]]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        names = list(self.spelling.values())
        for pattern in followed.keys() | whole.keys():
            self.automaton.add_word("".join([names[n] for n in pattern]), len(self.values))
            self.values.append((len(pattern), followed.get(pattern, ()), whole.get(pattern, ())))
        #: The texts as they are spelled.
        self.spelled = ["".join([names[n] for n in found]) for found in texts]
        if self.values:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """(words, merged hits as ranges of word numbers, items). One pass over the normalised text."""
        words = words_of(text)
        if not words or not self.values:
            return len(words), [], set()
        step = self.letters
        line = "".join(map(self.spelling.get, words, repeat(self.other)))
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        told: set[int] = set()
        # For each way to lay a text beside the document: how far it has been followed.
        reached: dict[tuple[int, int], int] = {}
        for last, number in self.automaton.iter(line):
            size, places, owners = self.values[number]
            end = (last + 1) // step
            start = end - size
            if owners:
                ranges.append((start, end))
                if number not in told:
                    told.add(number)
                    items.update(self.names[k] for k in owners)
            for k, at in places:
                if reached.get((k, start - at), -1) >= end:
                    continue
                other = self.spelled[k]
                a, b = start * step, end * step
                i, j = at * step, (at + size) * step
                while a and i and line[a - step : a] == other[i - step : i]:
                    a, i = a - step, i - step
                while b < len(line) and j < len(other) and line[b : b + step] == other[j : j + step]:
                    b, j = b + step, j + step
                a, b = a // step, b // step
                reached[k, start - at] = b
                if b - a >= self.window:
                    ranges.append((a, b))
                    items.add(self.names[k])
        return len(words), merged(ranges), items


#: The automaton that this process made last, by the name of its list.
_made: dict[str, Machine] = {}


def machine_of(name: str, shared: Broadcast, window: int) -> Machine:
    """One automaton in a worker process, however many of a stage's tasks it runs."""
    if name not in _made:
        _made.clear()
        _made[name] = Machine(shared.value, window)
    return _made[name]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as ranges of code points of the text as it was given."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(raw.translate(NORMAL))]
    out, at, chars = [], 0, 0
    for start, end in ranges:
        pair = []
        for byte in (places[start][0], places[end - 1][1]):
            # A code point has one byte that is not a continuation byte.
            chars += sum((b & 0xC0) != 0x80 for b in raw[at:byte])
            at = byte
            pair.append(chars)
        out.append((pair[0], pair[1]))
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ADDED = {
    "bench_n_words": T.LongType(),
    "bench_n_hit": T.LongType(),
    "bench_items": T.ArrayType(T.StringType()),
    "bench_spans": SPAN,
    "bench_ranges": SPAN,
}


def blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in lists of at most ``most`` words (or one item)."""
    block, used = [], 0
    rows = benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).where(F.col(text_col).isNotNull())
    for item, text in rows.toLocalIterator():
        n = len(words_of(text))
        if block and used + n > most:
            yield block
            block, used = [], 0
        block.append(("null" if item is None else item, text))
        used += n
    yield block


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    bench_text_col: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Find every benchmark window in every document; adds to ``docs``:

    ``bench_n_words``, ``bench_n_hit`` (words inside any window's occurrence),
    ``bench_items`` (ids of the items whose windows occur, sorted as strings),
    ``bench_spans`` (code points of the original text, merged) and
    ``bench_ranges`` (the same as numbers of words).

    The benchmark is sent to the tasks in blocks of bounded size; mostly that is
    one, and the documents are scanned once, where they are, without a shuffle.
    Further blocks add to what earlier ones found.

    Null or empty text: no words, no hits. Null benchmark texts and items
    without words have no window; a null item id is listed as ``null``. Equal
    windows of several items count for each. Repeated rows are judged one by
    one, empty tables give no rows or no hits, other columns pass through, but
    input columns with the added columns' names are replaced.
    """
    spark = docs.sparkSession
    docs = without(docs, *ADDED)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in ADDED.items()]])
    text_at = docs.columns.index(text_col)
    width = len(docs.columns)
    out = docs
    for number, items in enumerate(blocks(benchmark, item_col, bench_text_col, block_words)):
        if number:
            out = cut_lineage(out)
        shared, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            machine = machine_of(name, shared, window)
            for batch in batches:
                texts = batch.column(text_at)
                later = batch.num_columns > width
                cols: list[list] = [[], [], [], [], []]
                for i in range(batch.num_rows):
                    text = texts[i].as_py()
                    n, ranges, ids = machine.scan(text)
                    if later:
                        had = batch.column(width + 4)[i].as_py()
                        ranges = merged([*ranges, *((r["start"], r["end"]) for r in had)])
                        ids |= set(batch.column(width + 2)[i].as_py())
                    spans = original_spans(text, ranges) if ranges else []
                    cols[0].append(n)
                    cols[1].append(sum(b - a for a, b in ranges))
                    cols[2].append(sorted(ids))
                    cols[3].append([{"start": a, "end": b} for a, b in spans])
                    cols[4].append([{"start": a, "end": b} for a, b in ranges])
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), span, span]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:width], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=schema.names
                )

        out = out.mapInArrow(run, schema)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window; same columns, null texts stay."""
    docs, back = set_aside(docs, *ADDED)
    found = find_contamination(docs, benchmark, **options)
    return found.where(F.col("bench_n_hit") == 0).drop(*ADDED).withColumnsRenamed(back)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("bench_n_words").alias("n_words"),
        F.col("bench_n_hit").alias("n_hit"),
        F.size("bench_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("bench_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("bench_n_hit") > 0).alias("contaminated"),
    )


EMPTY_SHA = hashlib.sha256(b"").hexdigest()

OP3_SQL = rf"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), bs AS (
  SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW} - 1], ' ') AS win FROM bs
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), ds AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM ds, (SELECT DISTINCT n FROM bw) WHERE i + n - 1 <= len(w)
), hits AS (
  SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, '{EMPTY_SHA}') AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
