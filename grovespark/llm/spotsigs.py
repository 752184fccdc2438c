"""SpotSigs fingerprints: chains of content words that follow common words."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovespark.llm.common import cut_lineage, table
from grovespark.llm.components import components
from grovespark.llm.decontam import words_of
from grovespark.llm.simhash import Tiles, groups_of, merge, tile_sides, tile_tasks

#: Common words of the corpus's languages: the anchors.
ANCHORS = frozenset(
    word.encode()
    for words in (
        "the of and to in is was are be been it on for with as at by this that from or an a had his her they not but you he she we",
        "der die das und ist ein eine einer im in zu den von mit für auf dem nicht als auch es an er sie wir bei nach über",
        "le la les de des du un une et est en que qui dans pour sur au aux pas par plus ce se son sa ses il elle nous vous",
        "el los las y es por con para como más o pero su sus al lo no una unos unas del se ha son esta este",
    )
    for word in words.split()
)
#: Content words in a chain, and how many content words on the next one lies.
CHAIN, DISTANCE = 2, 1
#: After so many content words without an anchor the last of them is one: lists and other languages have few common words.
GAP = 6
#: Ranges of ids at most; each is one task of the shuffle.
MAX_PARTS = 20_000
#: Sets whose sizes differ more than this ratio allows lie in partitions that are not neighbours.
PARTITION_RATIO = 0.8


def signatures(text: str | None, chain: int = CHAIN, distance: int = DISTANCE) -> np.ndarray:
    """The set of a text's spot signatures: sorted 32-bit hashes.

    Where no anchor has a content word after it, each word is an anchor; a lone
    word is its own signature. A text without words has none.
    """
    import xxhash

    words = words_of(text)
    content: list[bytes] = []
    spots: list[tuple[bytes, int]] = []
    since = 0
    for word in words:
        if word in ANCHORS:
            spots.append((word, len(content)))
            since = 0
        else:
            content.append(word)
            since += 1
            if since == GAP:
                spots.append((word, len(content)))
                since = 0
    reach, n = (chain - 1) * distance + 1, len(content)
    found = {
        b"%b:%b" % (anchor, b" ".join(content[at : at + reach : distance])) for anchor, at in spots if at < n
    }
    if not found and words:
        found = {b"%b:%b" % (w, b" ".join(words[i + 1 : i + 1 + chain])) for i, w in enumerate(words[:-1])} or {words[0]}
    out = np.fromiter(map(xxhash.xxh32_intdigest, found), dtype="<u4", count=len(found))
    return np.unique(out)


def encoded(found: np.ndarray) -> str:
    """A fingerprint as text: the sorted hashes in base 64. Equal sets, equal texts."""
    return base64.b64encode(found.tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype="<u4")


def partition_of(n: int, ratio: float = PARTITION_RATIO) -> int:
    """The partition by set length: sets of likeness ``ratio`` or more lie in the same or the next one."""
    return 0 if n == 0 else 1 + int(np.floor(np.log(n) / -np.log(ratio) + 1e-9))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sets; 0 without counting where their lengths rule ``least`` out. Two empty sets: 1."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if not small or small < least * large:
        return 0.0
    if a[-1] < b[0] or b[-1] < a[0]:
        return 0.0
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    value = shared / (small + large - shared)
    return value if value >= least else 0.0


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Ids that are gathered for each partition, to cut those that are not whole numbers at.
IDS_A_PART = 20


class Ranges:
    """Numbered ranges of ids, the largest first and null last. An id that fills several ranges, or null, is cut by the hash of its texts."""

    def __init__(self, found: list, null_parts: int):
        """``found``: quantiles of the ids, those of frequent ids repeated."""
        counts = Counter(found)
        self.values = sorted(counts)
        self.array = np.array(self.values, dtype=object if self.values and isinstance(self.values[0], str) else np.int64)
        self.times = np.array([counts[v] for v in self.values], dtype=np.int64)
        # An id that is a quantile several times has ranges of its own, after that of the smaller ids down to the last quantile.
        width = np.where(self.times > 1, 1 + self.times, 1)
        self.start = np.r_[0, np.cumsum(width)].astype(np.int64)
        self.total = int(self.start[-1]) + 1
        self.null_parts = null_parts

    def __len__(self) -> int:
        return self.total + self.null_parts

    def places(self, ids: pa.Array, hashes: np.ndarray) -> np.ndarray:
        null = ids.is_null().to_numpy(zero_copy_only=False)
        part = ((hashes.astype(np.int64) ^ np.int64(-(1 << 63))).view(np.uint64) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        if not len(self.values):
            place = np.zeros(len(ids), dtype=np.int64)
        else:
            values = ids.fill_null(self.values[0]).to_numpy(zero_copy_only=False)
            at = np.searchsorted(self.array, values, side="left")
            near = np.minimum(at, len(self.values) - 1)
            own = (at < len(self.values)) & (self.array[near] == values) & (self.times[near] > 1)
            times = self.times[near]
            inside = self.start[near] + times - np.floor(part * times).astype(np.int64)
            place = self.total - 1 - np.where(own, inside, self.start[at])
        return np.where(null, self.total + np.floor(part * max(1, self.null_parts)).astype(np.int64), place).astype(np.int32)


def with_following(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(pid, halo, id, text): texts by falling id in numbered partitions, each ending with the next one's first row.

    Whole numbers are ids as they are, others as text. Rows of one id are in the
    order of a hash of their texts; null ids come last. Partitions are cut at
    approximate quantiles of the ids, and an id with many rows, or null, by that
    hash. Only the quantiles, or some ids for each partition, and the first id of
    each partition reach the driver.
    """
    whole = isinstance(docs.schema[id_col].dataType, T.IntegralType)
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = docs.select(F.col(id_col).cast("long" if whole else "string").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MAX_PARTS, some.rdd.getNumPartitions()))
    shares = [i / parts for i in range(1, parts)]
    found: list = []
    n, nulls, found = some.agg(
        F.count(F.lit(1)),
        F.count_if(F.col("id").isNull()),
        F.percentile_approx("id", F.array(*map(F.lit, shares)), 10 * parts + 10_000) if whole and shares else F.lit(None),
    ).first()
    if not whole and shares:
        part = int(min(1.0, IDS_A_PART * parts / max(1, n)) * (1 << 30))
        rows = some.where(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id", "h", F.lit(2)), F.lit(1 << 30)) < part)).select("id").collect()
        ids = sorted(r["id"] for r in rows)
        found = [ids[int(s * len(ids))] for s in shares] if ids else []
    ranges = Ranges(found or [], max(1, round(parts * nulls / max(1, n))))

    @F.arrow_udf(T.IntegerType())
    def partition(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array(ranges.places(ids, hashes.to_numpy(zero_copy_only=False)), pa.int32())

    some = some.withColumn("pid", partition("id", "h"))
    # A later place has a larger hash, so a smaller complement.
    first = some.select("id", "h", "pid").groupBy("pid").agg(F.max(F.struct("id", F.bitwise_not("h").alias("c"))).alias("first")).collect()
    firsts = sorted((r["pid"], (r["first"]["id"], ~r["first"]["c"])) for r in first)
    before = {key: firsts[i - 1][0] for i, (_, key) in enumerate(firsts)}
    first_hashes = np.array(sorted({h for _, (_, h) in firsts}), dtype=np.int64)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def places(ids: pa.Array, hashes: pa.Array, pids: pa.Array) -> pa.Array:
        """A row's own partition, and, below zero, that which it follows on."""
        own, h = pids.to_numpy(zero_copy_only=False), hashes.to_numpy(zero_copy_only=False)
        follows = np.zeros(len(own), dtype=np.int32)
        for i in np.flatnonzero(np.isin(h, first_hashes)):
            if (place := before.get((ids[int(i)].as_py(), int(h[i])))) is not None:
                follows[i] = -1 - place
        ends = np.cumsum(1 + (follows < 0))
        values = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        values[ends[follows < 0] - 1] = follows[follows < 0]
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        values[starts] = own
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values, pa.int32()))

    rows = some.select(F.explode(places("id", "h", "pid")).alias("at"), "id", "text", "h")
    rows = rows.select(
        F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).alias("pid"),
        F.when(F.col("at") < 0, 1).otherwise(0).alias("halo"), "id", "text", "h",
    )
    return rows.repartitionById(len(ranges), F.col("pid")).sortWithinPartitions(
        "pid", "halo", F.col("id").desc_nulls_last(), "h", "text"
    )


#: Sets in one tile at most, and bits of the maps that rule pairs out before sets are compared.
TILE, MAP_BITS = 8192, 512
#: Differences of length don't rule tiles out beside their partitions.
ANY_LENGTH = 1 << 40


def bit_map(found: np.ndarray) -> np.ndarray:
    """A bit for each signature; two maps differ in no more bits than the sets differ in signatures."""
    bits = np.zeros(MAP_BITS, dtype=np.uint8)
    bits[found % MAP_BITS] = 1
    return np.packbits(bits).view(np.uint64)


def alike_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None, least: float, labels: np.ndarray) -> None:
    """Merge the labels of sets of this likeness or more. Pairs that are in one class already are not compared again."""
    maps = np.stack([bit_map(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    step = max(1, (1 << 18) // max(1, len(left if right is None else right)))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        cols = left[at:] if right is None else right
        far = np.zeros((len(rows), len(cols)), dtype=np.uint16)
        for w in range(maps.shape[1]):
            far += np.bitwise_count(maps[rows, w][:, None] ^ maps[cols, w][None, :])
        # Of a + b signatures, sets of this likeness differ in (1 - least) / (1 + least) parts at most.
        i, j = np.nonzero(far <= (sizes[rows][:, None] + sizes[cols][None, :]) * ((1 - least) / (1 + least)) + 1e-9)
        for a, b in zip(rows[i], cols[j], strict=True):
            if labels[a] != labels[b] and likeness(sets[a], sets[b], least):
                merge(labels, np.array([a]), np.array([b]))


def spot_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, tile: int = TILE) -> DataFrame:
    """(``id_col``, n_signatures, length_partition, class_id): near-duplicates by the likeness of their signatures.

    Sets are laid out by length: likeness of ``least`` or more is found in a
    partition and its neighbours alone. A large partition is cut into tiles, and
    each pair of tiles is a task, in which maps of bits and lengths rule out
    pairs before sets are compared; no pair of this likeness is lost. A class is
    a connected component and has its smallest id. Equal sets are one from the
    start.

    Null and blank texts have the empty set and are one class. Null ids take
    part; a class without another id has a null id. An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [signatures(t.as_py()).astype("<u4") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([partition_of(len(s), least) for s in sets], pa.int64())],
                names=["id", "sigs", "n", "kind"],
            )

    rows = cut_lineage(docs.select(id_col, text_col).mapInArrow(found, f"id {kind}, sigs binary, n long, kind long"))
    items = rows.groupBy("sigs").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("kind").alias("kind"))
    items = cut_lineage(items.withColumn("node", F.monotonically_increasing_id()))
    hist = [tuple(r) for r in items.groupBy("kind", "n").agg(F.count(F.lit(1))).collect()]
    tiles = Tiles(hist, tile)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, (_, side, node, sigs) in groups_of(batches):
            for lo, hi in zip(starts, starts[1:], strict=False):
                sets = [np.frombuffer(s, dtype="<u4") for s in sigs[lo:hi]]
                labels = np.arange(hi - lo)
                for left, right in tile_sides(np.arange(hi - lo), side[lo:hi]):
                    alike_pairs(sets, left, right, least, labels)
                linked = np.flatnonzero(labels != np.arange(hi - lo))
                if len(linked):
                    names = node[lo:hi]
                    yield pa.RecordBatch.from_arrays([pa.array(names[linked]), pa.array(names[labels[linked]])], names=["a", "b"])

    tasks = tile_tasks(items.withColumn("pop", F.col("n")), tiles, ["node", "sigs"], ANY_LENGTH)
    roots = components(tasks.mapInArrow(link, "a long, b long"))
    named = items.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = named.groupBy("root").agg(F.min("first").alias("class_id"))
    classes = named.join(low, "root").select("sigs", "class_id")
    return rows.join(classes, "sigs").select(
        F.col("id").alias(id_col), F.col("n").alias("n_signatures"), F.col("kind").alias("length_partition"), "class_id"
    )


FIELDS = [
    ("n_chars", pa.int64(), T.LongType()),
    ("edited_sha256", pa.string(), T.StringType()),
    ("fingerprint", pa.string(), T.StringType()),
    ("edited_fingerprint", pa.string(), T.StringType()),
    ("near_edited", pa.float64(), T.DoubleType()),
    ("near_next", pa.float64(), T.DoubleType()),
    ("n_signatures", pa.int64(), T.LongType()),
    ("length_partition", pa.int64(), T.LongType()),
]


def spot_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every whole text, and the same text with its last half replaced by the next document's first.

    The next document is the one with the next smaller id; after the smallest
    comes the largest. Texts are shuffled once, by ranges of ids, and each task
    reads one row ahead. Null text: as empty; its fingerprint is empty, and two
    empty fingerprints are alike (1.0). Ids of any type keep it; those that are no
    whole numbers are ordered as text. Rows with one id follow in the order of a
    hash of their texts, null ids come last. Very long texts are taken whole. An
    empty table gives no rows; other columns are left out.
    """
    rows = with_following(docs, id_col, text_col)
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *[T.StructField(n, t) for n, _, t in FIELDS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        id_type = None
        held: tuple | None = None
        done = False

        def flush() -> pa.RecordBatch:
            kinds = [id_type, *(a for _, a, _ in FIELDS)]
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=schema.names)

        def judged(now: tuple, after: str, next_found: np.ndarray) -> tuple:
            doc, text, found = now
            edited = edited_text(text, after)
            edited_found = signatures(edited)
            return (
                doc,
                len(text),
                hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                encoded(found),
                encoded(edited_found),
                likeness(found, edited_found),
                likeness(found, next_found),
                len(found),
                partition_of(len(found)),
            )

        # A task can hold several partitions' rows, one after the other.
        at = None
        for batch in batches:
            id_type = batch.schema.field(2).type
            pids, halos = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            docs_, texts = batch.column(2).to_pylist(), batch.column(3)
            for i, pid in enumerate(pids):
                if pid != at:
                    at, held, done = pid, None, False
                if done:
                    continue
                text = texts[i].as_py()
                found = signatures(text)
                if held is not None:
                    out.append(judged(held, text, found))
                held = (docs_[i], text, found)
                done = halos[i] == 1
                if len(out) >= 256:
                    yield flush()
        if out:
            yield flush()

    out = rows.mapInArrow(run, schema)
    kind = docs.schema[id_col].dataType
    return out if schema[0].dataType == kind else out.withColumn(id_col, F.col(id_col).cast(kind))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_fingerprints(table(spark, sf_dir, "documents"))
