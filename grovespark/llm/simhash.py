"""SimHash near-dedup: exact comparison of fingerprints, tile by tile, in numpy.

Two fingerprints that differ in r bits have population counts that differ by r at
most, so tile pairs whose counts lie further apart are skipped. For a small
radius, fingerprints are first laid out by blocks of bits: of radius+1 blocks two
linked fingerprints share one, so tiles are needed only inside such a bucket, and
the work grows with the buckets. For a wide radius no block need be shared; tiles
are then laid out by the number of shingles, which bounds similarity from above.

A tile pair sends on a forest of its links, at most one for each fingerprint,
never all pairs of a group.
"""

from __future__ import annotations

import math
import os
import tempfile
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.llm.common import cut_lineage, free_names, hash_pair, table
from grovespark.llm.components import components

SEED = 42
#: Fingerprints in one tile at most.
TILE = 4096
#: Documents and shingles that are counted in one go.
DOCS_AT_ONCE, HASHES_AT_ONCE = 2000, 400_000
#: For each byte value its eight bits.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def shingle_hashes(text: str | None, size: int) -> list[int]:
    """XXH64 (seed 42) of each run of ``size`` words, repeats included; of the whole if it has fewer words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return []
    if len(words) < size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    return list(
        map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)), repeat(SEED))
    )


def mixed(h: np.ndarray, number: int) -> np.ndarray:
    """Another 64 bits for each hash; the hash itself for number 0."""
    if not number:
        return h
    z = h + np.uint64((number * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints(hashes: list, words: int = 1) -> np.ndarray:
    """(documents, words) of uint64. A bit is set if more than half of a document's hashes have it."""
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    out = np.zeros((len(hashes), words), dtype=np.uint64)
    if not sizes.sum():
        return out
    h = np.concatenate([np.asarray(x, dtype=np.uint64) for x in hashes if len(x)])
    base = np.repeat(np.arange(len(hashes), dtype=np.int64) * 256, sizes)
    for w in range(words):
        raw = np.ascontiguousarray(mixed(h, w)).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            counts = np.bincount(base + raw[:, byte], minlength=256 * len(hashes)).reshape(-1, 256)
            ones = counts.astype(np.float64) @ BITS > sizes[:, None] / 2
            out[:, w] |= (ones.astype(np.uint64) << np.arange(8 * byte, 8 * byte + 8, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return out


def document_fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int, words: int, distinct: bool) -> DataFrame:
    """(id, n, s, f0, f1, ...): number of shingles, a hash of them all and fingerprint of every whole text."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes: list = []
            n = first = 0
            for i in range(batch.num_rows):
                found = shingle_hashes(batch.column(1)[i].as_py(), size)
                hashes.append(np.unique(np.array(found, dtype=np.uint64)) if distinct else found)
                n += len(found)
                if n >= HASHES_AT_ONCE or len(hashes) >= DOCS_AT_ONCE or i + 1 == batch.num_rows:
                    prints = fingerprints(hashes, words).view(np.int64)
                    whole = [xxhash.xxh64_intdigest(np.asarray(h, dtype=np.uint64).tobytes(), SEED) for h in hashes]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(first, len(hashes)),
                            pa.array([len(h) for h in hashes], pa.int64()),
                            pa.array(np.array(whole, dtype=np.uint64).view(np.int64)),
                            *(pa.array(np.ascontiguousarray(prints[:, w])) for w in range(words)),
                        ],
                        names=["id", "n", "s", *(f"f{w}" for w in range(words))],
                    )
                    hashes, n, first = [], 0, i + 1

    kind = docs.schema[id_col].dataType.simpleString()
    prints = ", ".join(f"f{w} long" for w in range(words))
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n long, s long, {prints}")


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the labels of the pairs (a, b): in the end both have the smallest label."""
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        if not len(a):
            return
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(further := labels[labels], labels):
            labels[:] = further


#: Words that are compared for all pairs of a tile pair; further ones only for pairs that these leave over.
FIRST_WORDS = 4


def distances(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of row numbers of ``a`` and ``b`` (rows, words) that differ in ``radius`` bits at most, and in how many."""
    first, words = min(FIRST_WORDS, a.shape[1]), a.shape[1]
    # A pair's bits differ in the first words as often as in the others, but for five deviations and more.
    share = radius / (64 * words)
    most = radius if first == words else min(radius, 64 * first * share + 4 * math.sqrt(64 * first * share * (1 - share)))
    d = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.uint16 if first > 3 else np.uint8)
    for w in range(1, first):
        d += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
    i, j = np.nonzero(d <= int(most))
    far = d[i, j].astype(np.int64)
    if a.shape[1] > first:
        for w in range(first, a.shape[1]):
            far += np.bitwise_count(a[i, w] ^ b[j, w])
        near = far <= radius
        i, j, far = i[near], j[near], far[near]
    return i, j, far


def tile_pairs(f: np.ndarray, left: np.ndarray, right: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, distance) of linked rows of two tiles, or, without ``right``, of one; a block of rows at a time."""
    step = max(1, (1 << 19) // max(1, len(left if right is None else right)))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        cols = left[at:] if right is None else right
        i, j, d = distances(f[rows], f[cols], radius)
        yield rows[i], cols[j], d


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Whole groups of equal first column, many at a time: (starts with the end, columns). Input is sorted by it."""
    carry: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if carry is not None:
            cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
        if not len(cols[0]):
            continue
        starts = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
        last = starts[-1]
        if last:
            yield starts, [c[:last] for c in cols]
        carry = [c[last:] for c in cols]
    if carry is not None:
        yield np.array([0, len(carry[0])]), carry


def tile_sides(rows: np.ndarray, kinds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """What a task compares: side 2 with itself, side 0 with side 1."""
    sides = [rows[kinds == k] for k in range(3)]
    out = [(sides[2], None)] if len(sides[2]) else []
    return out + ([(sides[0], sides[1])] if len(sides[0]) and len(sides[1]) else [])


#: Fingerprints of one bucket that are compared in one go.
BLOCK = 256
#: Buckets up to this size are compared together, at growing distances in the sorted column.
SMALL = 48


def near_blocks(pop: np.ndarray, left: np.ndarray, right: np.ndarray | None, radius: int, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Pairs of blocks of rows, of which each side is sorted by ``pop``, whose population counts lie within the radius of one another.

    Without ``right``: of one side with itself; a block with itself is (block, none).
    """
    ours = [left[at : at + block] for at in range(0, len(left), block)]
    theirs = ours if right is None else [right[at : at + block] for at in range(0, len(right), block)]
    high = [pop[rows[-1]] for rows in theirs]
    for i, rows in enumerate(ours):
        if right is None:
            yield rows, None
        # Blocks that end too far below are passed over; from one that begins too far above on, all do.
        for other in theirs[i + 1 if right is None else bisect_left(high, pop[rows[0]] - radius) :]:
            if pop[other[0]] - pop[rows[-1]] > radius:
                break
            yield rows, other


def bucket_links(radius: int):
    """mapInArrow function over (task, side, pop, f) sorted by the first three: yields a forest of links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, (_, side, count, value) in groups_of(batches):
            f, pop = value.view(np.uint64).reshape(-1, 1), count.astype(np.int64)
            labels = np.arange(len(f))
            sizes = np.diff(starts)
            ends = np.repeat(starts[1:], sizes)
            small = np.repeat(sizes <= SMALL, sizes)
            for lag in range(1, SMALL):
                i = np.flatnonzero(small & (np.arange(len(f)) + lag < ends))
                if not len(i):
                    break
                # Side 2 is compared with itself, side 0 with side 1; counts that differ too much rule a pair out.
                i = i[(abs(pop[i + lag] - pop[i]) <= radius) & ((side[i] == 2) | (side[i] != side[i + lag]))]
                near = np.bitwise_count(f[i, 0] ^ f[i + lag, 0]) <= radius
                merge(labels, i[near], i[near] + lag)
            for k in np.flatnonzero(sizes > SMALL):
                rows = np.arange(starts[k], starts[k + 1])
                for sides in tile_sides(rows, side[rows]):
                    for left, right in near_blocks(pop, *sides, radius):
                        for a, b, _ in tile_pairs(f, left, right, radius):
                            merge(labels, a, b)
            linked = np.flatnonzero(labels != np.arange(len(f)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(value[linked]), pa.array(value[labels[linked]])], names=["a", "b"])

    return run


def fingerprint_links(prints: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(a, b) links that connect all 64-bit fingerprints (column ``f``, distinct) within ``radius`` of one another.

    Each fingerprint goes to radius+1 buckets by its blocks of bits. A bucket of up to
    ``tile`` fingerprints is one task; a larger one is cut into tiles by population
    count, large counts by a hash as well, and each pair of tiles whose counts lie
    within the radius is a task of its own. In a task, rows are in order of their
    counts, and blocks of rows whose counts lie too far apart are not compared.
    The counts are aggregated before the shuffle, and a large bucket's rows are
    spread over its tasks.
    """
    blocks = radius + 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    f = F.col("f")
    keys = [
        F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(f, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("key"))
        for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))
    ]
    rows = prints.select("f", F.bit_count("f").alias("pop"), F.inline(F.array(*keys)))
    counts = rows.groupBy("band", "key", "pop").agg(F.count(F.lit(1)).alias("n"))
    large = counts.groupBy(F.col("band").alias("lb"), F.col("key").alias("lk")).agg(
        F.sum("n").alias("m"),
        F.collect_list(F.struct("pop", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))).alias("hist"),
    )
    large = large.where(F.col("m") > tile).select("lb", "lk", "hist")
    rows = rows.join(large, (F.col("band") == F.col("lb")) & (F.col("key") == F.col("lk")), "left")
    small = rows.where(F.col("hist").isNull()).select(F.xxhash64("band", "key").alias("task"), F.lit(2).alias("side"), "pop", "f")

    own = F.filter("hist", lambda h: h["pop"] == F.col("pop"))[0]["tiles"]
    rows = rows.where(F.col("hist").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("f"), own).cast("int"))
    mine = F.struct(F.col("pop").alias("p"), F.col("salt").alias("s"))
    others = F.flatten(
        F.transform(
            F.filter("hist", lambda h: F.abs(h["pop"] - F.col("pop")) <= radius),
            lambda h: F.transform(F.sequence(F.lit(0), h["tiles"] - 1), lambda s: F.struct(h["pop"].alias("p"), s.alias("s"))),
        )
    )
    rows = rows.select("f", "pop", "band", "key", mine.alias("mine"), F.explode(others).alias("other"))
    rows = rows.select(
        F.xxhash64("band", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"),
        F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1).alias("side"),
        "pop",
        "f",
    )
    tasks = small.union(rows).repartition("task").sortWithinPartitions("task", "side", "pop")
    return tasks.mapInArrow(bucket_links(radius), "a long, b long")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, tile: int = TILE
) -> DataFrame:
    """(``id_col``, ``fingerprint`` in 16 hex digits, ``component_id``) for every row of ``docs``.

    Fingerprints that differ in ``radius`` bits or fewer are linked; a component's
    id is the smallest id in it. Equal fingerprints are grouped first, so copies
    cost nothing further on.

    Null, empty and blank texts have fingerprint zero and are linked like others.
    Null ids take part; a component with no other id has a null id. Repeated rows
    are returned as often as they come. An empty table gives no rows.
    """
    prints = cut_lineage(document_fingerprints(docs, id_col, text_col, shingle, 1, False).select("id", F.col("f0").alias("f")))
    first = prints.groupBy("f").agg(F.min("id").alias("first"))
    roots = components(fingerprint_links(first.select("f"), radius, tile))
    linked = first.join(roots.withColumnRenamed("node", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    names = linked.join(smallest, "root").select("f", "component_id")
    return prints.join(names, "f").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


# --- Near-duplicates at a similarity: a wide radius, tiles by number of shingles ---

WORDS = 8
WIDE_TILE = 32768
#: Keys of rows (16 bytes each) that are sent to every task at most.
BROADCAST_ROWS = 2_000_000
#: How far below the wanted similarity a candidate's estimate may lie, in its own standard deviations. Where a document
#: has few shingles, ties of bits add to the distance: at 0.8 by 18 bits, two deviations, in the worst case (4 and 5).
SPREAD = 7.0


def estimated(far: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int = 64 * WORDS) -> np.ndarray:
    """Jaccard similarity of sets of these sizes whose fingerprints differ in ``far`` bits.

    The angle between the sets, as vectors, is the part of bits that differ, times
    pi; the angle's cosine is their common part over the mean of their sizes. The
    common part is at most the smaller set.
    """
    common = np.cos(np.pi * np.minimum(far / bits, 0.5)) * np.sqrt(a * b.astype(np.float64))
    common = np.minimum(common, np.minimum(a, b))
    return common / np.maximum(1e-9, a + b - common)


def bounds(similarity: float, bits: int = 64 * WORDS, spread: float = SPREAD) -> tuple[int, float]:
    """(bits that two sets of this similarity differ in at most, the estimate that they have at least), each but for ``spread`` deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    far = bits * p + spread * math.sqrt(bits * p * (1 - p))
    one = np.array([1])
    return int(far), float(estimated(np.array([far]), one, one, bits)[0])


def size_class(n: np.ndarray, ratio: float) -> np.ndarray:
    """Sizes within ``ratio`` of one another are in the same or in neighbouring classes."""
    return np.floor(np.log(np.maximum(n, 1)) / -math.log(ratio) + 1e-9).astype(np.int64) + (n > 0)


class Tiles:
    """The layout: by class of size, within it by population count, within one count by hash. Made from a histogram."""

    def __init__(self, hist: list[tuple[int, int, int]], tile: int):
        self.first: dict[tuple[int, int], tuple[int, int]] = {}
        self.kind: list[int] = []
        self.low: list[int] = []
        self.high: list[int] = []
        used, last = 0, None
        for c, pop, n in sorted(hist):
            if n > tile or last != c or used + n > tile:
                parts = -(-n // tile)
                self.first[c, pop] = (len(self.kind), parts)
                self.kind += [c] * parts
                self.low += [pop] * parts
                self.high += [pop] * parts
                used, last = (n, c) if parts == 1 else (tile, c)
            else:
                self.first[c, pop] = (len(self.kind) - 1, 1)
                self.high[-1] = pop
                used += n

    def partners(self, t: int, radius: int) -> np.ndarray:
        """Tiles, this one included, that may hold rows linked to this one's."""
        kind, low, high = map(np.array, (self.kind, self.low, self.high))
        near = (abs(kind - self.kind[t]) <= 1) & (low - self.high[t] <= radius) & (self.low[t] - high <= radius)
        return np.flatnonzero(near)


def tile_tasks(items: DataFrame, tiles: Tiles, columns: list[str], radius: int) -> DataFrame:
    """(task, side, ``columns``) sorted by task: each row of ``items`` once for every tile that its own is compared with.

    ``items`` has ``columns``, of which the first is a long that tells rows apart,
    and kind and pop, which tell the tile.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [tiles.partners(t, radius) for t in range(len(tiles.kind))]
        for batch in batches:
            node, pop, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, len(columns), len(columns) + 1))
            places = [tiles.first[k] for k in zip(kind.tolist(), pop.tolist(), strict=True)]
            first, parts = (np.array(x) for x in zip(*places, strict=True))
            mine = first + (node.astype(np.int64) & 0x7FFFFFFFFFFFFFFF) % parts
            for t in np.unique(mine):
                some = batch.take(pa.array(np.flatnonzero(mine == t)))
                for other in near[t]:
                    a, b = min(t, other), max(t, other)
                    task = np.full(some.num_rows, a * len(tiles.kind) + b)
                    side = np.full(some.num_rows, 2 if a == b else 0 if t == a else 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(task), pa.array(side), *some.columns[: len(columns)]], names=["task", "side", *columns]
                    )

    kinds = ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in columns)
    rows = items.select(*columns, F.col("pop").cast("long"), F.col("kind").cast("long")).mapInArrow(spread, f"task long, side long, {kinds}")
    return rows.repartition("task").sortWithinPartitions("task")


def kept_aside(batches: Iterator[pa.RecordBatch], file) -> Iterator[pa.RecordBatch]:
    """The batches with place and length in ``file`` instead of their last column, which is written there."""
    at = 0
    for batch in batches:
        raw = [x.as_py() for x in batch.column(batch.num_columns - 1)]
        sizes = np.array([len(x) for x in raw], dtype=np.int64)
        places = at + np.cumsum(sizes) - sizes
        file.writelines(raw)
        at += int(sizes.sum())
        names = [*batch.schema.names[:-1], "place", "length"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(places), pa.array(sizes)], names=names)
    file.flush()


def verified(a: np.ndarray, b: np.ndarray, labels: np.ndarray, similarity: float, load: Callable[[int], np.ndarray]) -> None:
    """Join the labels of the pairs (a, b) whose sets are that similar. Pairs that are joined already are not compared."""
    if not len(a):
        # Of a tile with several blocks, one may have no pair of its own: its rows' partners came before.
        return
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    for lo, hi in zip(starts, np.r_[starts[1:], len(a)], strict=True):
        one, some = a[lo], b[lo:hi]
        some = some[labels[some] != labels[one]]
        mine = load(int(one)) if len(some) else None
        for at in range(0, len(some), 256):
            part = some[at : at + 256]
            part = part[labels[part] != labels[one]]
            sets = [load(int(i)) for i in part]
            sizes = np.array([len(x) for x in sets], dtype=np.int64)
            if not len(part) or not len(mine) or not sizes.all():
                continue
            every = np.concatenate(sets)
            hit = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
            common = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
            near = common >= similarity * (len(mine) + sizes - common) - 1e-9
            merge(labels, np.full(int(near.sum()), one), part[near])


def wide_links(items: DataFrame, similarity: float, tile: int = WIDE_TILE, sets_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a, b) links that connect all ``items`` (node, n, f0, f1, ...) whose estimated similarity reaches the bound of ``similarity``.

    Every pair of tiles that may hold a link is a task of its own: all rows are
    compared that sizes and population counts do not rule out.

    ``sets_of`` takes a table of nodes and gives (node, set), the sorted hashes of
    the shingles as bytes. With it, links are the pairs whose sets have at least
    ``similarity``: rows that have a candidate in a task meet there once more,
    with their sets, and a candidate is compared unless its two ends are connected.
    """
    # Sets whose sizes differ more than ``least`` cannot have the estimate, and more than ``similarity`` not that.
    radius, least = bounds(similarity)
    ratio = least if sets_of is None else similarity
    pops = sum((F.bit_count(f"f{w}") for w in range(WORDS)), F.lit(0))
    n = F.col("n")
    kind = F.when(n > 0, F.floor(F.log(n.cast("double")) / -math.log(ratio) + 1e-9).cast("long") + 1).otherwise(F.lit(0))
    items = items.withColumns({"pop": pops.cast("long"), "kind": kind})
    # At most some hundred classes of size and 257 counts.
    hist = [tuple(r) for r in items.groupBy("kind", "pop").agg(F.count(F.lit(1))).collect()]
    tiles = Tiles(hist, tile)

    def candidates(side: np.ndarray, n: np.ndarray, f: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for sides in tile_sides(np.arange(lo, hi), side[lo:hi]):
            for a, b, far in tile_pairs(f, *sides, radius):
                near = (a != b) & (estimated(far, n[a], n[b]) >= least) & (np.minimum(n[a], n[b]) >= ratio * np.maximum(n[a], n[b]) - 1e-9)
                yield a[near], b[near]

    def forest(labels: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        linked = np.flatnonzero(labels != np.arange(len(labels)))
        if len(linked):
            yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[labels[linked]])], names=["a", "b"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, (_, side, node, n, *prints) in groups_of(batches):
            f = np.stack([p.view(np.uint64) for p in prints], axis=1)
            labels = np.arange(len(f))
            for lo, hi in zip(starts, starts[1:], strict=False):
                for a, b in candidates(side, n, f, lo, hi):
                    merge(labels, a, b)
            yield from forest(labels, node)

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for starts, (task, side, node, n, *prints) in groups_of(batches):
            f = np.stack([p.view(np.uint64) for p in prints], axis=1)
            found = np.zeros(len(f), dtype=bool)
            for lo, hi in zip(starts, starts[1:], strict=False):
                for a, b in candidates(side, n, f, lo, hi):
                    found[a] = found[b] = True
            if found.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[found]) for x in (task, side, node, n, *prints)], names=["task", "side", *columns])

    def link_verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as file:
            for starts, (_, side, node, n, *prints, place, length) in groups_of(kept_aside(batches, file)):
                file.flush()
                f = np.stack([p.view(np.uint64) for p in prints], axis=1)
                labels = np.arange(len(f))

                def load(i: int, place=place, length=length) -> np.ndarray:
                    return np.frombuffer(os.pread(file.fileno(), int(length[i]), int(place[i])), dtype="<u8")

                for lo, hi in zip(starts, starts[1:], strict=False):
                    for a, b in candidates(side, n, f, lo, hi):
                        verified(a, b, labels, similarity, load)
                yield from forest(labels, node)

    columns = ["node", "n", *(f"f{w}" for w in range(WORDS))]
    tasks = tile_tasks(items, tiles, columns, radius)
    if sets_of is None:
        return tasks.mapInArrow(link, "a long, b long")
    rows = cut_lineage(tasks.mapInArrow(having, "task long, side long, " + ", ".join(f"{c} long" for c in columns)))
    rows = rows.join(sets_of(rows.select("node").distinct()), "node").select("task", "side", *columns, "set")
    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(link_verified, "a long, b long")


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``docs`` with one document of each group of near copies: that with the smallest id.

    Documents are linked if the Jaccard similarity of their sets of
    ``shingle``-word shingles is ``similarity`` or more. The distance of 512-bit
    fingerprints finds the candidates, with a margin that leaves out fewer than
    one in 10,000 of the pairs at ``similarity``, whatever their sizes, and the
    sets decide. Groups are the connected components. ``docs`` is read up to four
    times, and must hold the same rows each time.

    Equal sets are grouped first. Null, empty and blank texts are one group. Rows with a null id are kept only if their group has no
    other. Of repeated rows one stays. Very long texts are taken whole. An empty
    table gives no rows; other columns pass through, whatever their names.
    """
    prints = [f"f{w}" for w in range(WORDS)]
    # A row is known by its id and text, not by its place: a later pass may cut the input into other partitions.
    one, two = hash_pair(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(one.alias("k1"), two.alias("k2"), F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    keyed = rows.select(F.struct("k1", "k2", "doc").alias("id"), "text")
    sig = document_fingerprints(keyed, "id", "text", shingle, WORDS, True)
    same = ["n", "s", *prints]
    sig = cut_lineage(sig.select("id.k1", "id.k2", "id.doc", *same))
    best = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "k1", "k2"))
    items = sig.groupBy(*same).agg(best.alias("best"))
    items = cut_lineage(items.withColumn("node", F.monotonically_increasing_id()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                found = [np.unique(np.array(shingle_hashes(t.as_py(), shingle), dtype="<u8")).tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=["node", "set"])

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = items.join(nodes, "node").select("node", F.col("best.k1").alias("w1"), F.col("best.k2").alias("w2"))
        wanted, _ = sized(wanted)
        texts = rows.join(wanted, (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))).select("node", "text")
        return cut_lineage(texts.mapInArrow(sets, "node long, set binary").dropDuplicates(["node"]))

    roots = components(wide_links(items.select("node", "n", *prints), similarity, sets_of=sets_of))
    named = items.select("node", "best", *same).join(roots, "node", "left")
    named = named.withColumn("root", F.coalesce("root", "node"))
    keep = named.groupBy("root").agg(F.min("best").alias("kept")).select(F.col("root").alias("kept_root"), "kept")
    owner = named.join(keep, F.col("root") == F.col("kept_root")).select(*same, "kept")
    other = (F.col("k1") != F.col("kept.k1")) | (F.col("k2") != F.col("kept.k2"))
    own_1, own_2, of_1, of_2, times = free_names(docs, "k1", "k2", "g1", "g2", "times")
    gone = sig.join(owner, same).where(other).select(F.col("k1").alias(of_1), F.col("k2").alias(of_2)).distinct()
    again = sig.groupBy(F.col("k1").alias(of_1), F.col("k2").alias(of_2)).agg(F.count(F.lit(1)).alias(times))
    again = again.where(F.col(times) > 1).drop(times)

    out = docs.withColumns({own_1: one, own_2: two})
    match = (F.col(own_1) == F.col(of_1)) & (F.col(own_2) == F.col(of_2))
    gone, n_gone = sized(gone)
    again, n_again = sized(again)
    out = out.join(gone, match, "left_anti")
    if n_again:
        # Rows that are there several times are the only ones that have to meet; most tables have none.
        out = out.join(again, match, "left_anti").unionByName(out.join(again, match, "left_semi").dropDuplicates([own_1, own_2]))
    return out.drop(own_1, own_2)


def sized(keys: DataFrame) -> tuple[DataFrame, int]:
    """(keys, their number): a few million go to every task, and texts stay where they are; more go by a shuffle of the texts."""
    keys = cut_lineage(keys)
    n = keys.count()
    return (F.broadcast(keys) if n <= BROADCAST_ROWS else keys), n
