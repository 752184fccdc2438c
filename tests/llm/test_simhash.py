"""SimHash against brute force over all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from grovespark.llm.components import components
from grovespark.llm.simhash import (
    WORDS, Tiles, bounds, estimated, fingerprint_links, fingerprints, near_blocks, near_dedup, simhash_components, size_class, verified, wide_links,
)


def brute_print(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    runs = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    counts = [0] * 64
    for run in runs:
        h = xxhash.xxh64_intdigest(run.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(runs))


def roots_of(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def brute_components(rows):
    prints = [brute_print(r[1]) for r in rows]
    n = len(rows)
    roots = roots_of(n, [(i, j) for i in range(n) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 3])
    low = {}
    for r, root in zip(rows, roots, strict=True):
        if r[0] is not None:
            low[root] = min(low.get(root, r[0]), r[0])
    return [(r[0], f"{p:016x}", low.get(root)) for r, p, root in zip(rows, prints, roots, strict=True)]


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("tile", [4096, 2])
def test_components_as_brute_force(docs, rows, tile):
    got = [tuple(r) for r in simhash_components(docs.withColumns({"f": F.lit(1), "root": F.lit(2)}), tile=tile).collect()]
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)


def test_no_documents(no_docs):
    assert simhash_components(no_docs).count() == 0
    assert near_dedup(no_docs).count() == 0


@pytest.mark.parametrize("tile", [4096, 16, 3])
def test_links_connect_what_is_near(spark, tile):
    """Many fingerprints around few centres, so that some buckets are far larger than a tile."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = set()
    for c in centres:
        for _ in range(150):
            x = c
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints | {rng.getrandbits(64) for _ in range(200)} | {0, (1 << 64) - 1})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "f long")
    links = [tuple(r) for r in fingerprint_links(frame, 3, tile).collect()]
    at = {p: i for i, p in enumerate(signed)}
    assert all(bin(prints[at[a]] ^ prints[at[b]]).count("1") for a, b in links)
    a = np.array(prints, dtype=np.uint64)
    near = np.argwhere(np.bitwise_count(a[:, None] ^ a[None, :]) <= 3)
    want, got = roots_of(len(prints), near), roots_of(len(prints), [(at[x], at[y]) for x, y in links])
    assert len(set(want)) == len(set(got)) == len(set(zip(want, got, strict=True)))
    assert len(links) <= 4 * len(prints) * (1 if tile == 4096 else 60)


def test_components_of_chains_hubs_and_repeats(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 300)] + [(7, 200), (5, 5), (None, 3)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(200, 300)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n)]


def test_near_copies_go_and_others_stay(spark, docs):
    rng = random.Random(8)
    rows = []
    for g in range(12):
        base = words(rng, 300)
        for c in range(5):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(300)] = "other"
            rows.append((1000 + 10 * g + c, " ".join(copy), "en", "a", 1))
        rows.append((1000 + 10 * g + 9, " ".join(base[:150] + words(rng, 150)), "en", "a", 1))
    rows += [(5000, rows[0][1], "en", "a", 1), (1000, rows[0][1], "en", "a", 1), (None, rows[0][1], "en", "a", 1)]
    frame = spark.createDataFrame(rows, docs.schema).withColumns({"row": F.lit(1), "node": F.lit(2), "n": F.lit(3)}).repartition(5).cache()
    kept = near_dedup(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(1000 + 10 * g + k for g in range(12) for k in (0, 9))


def test_blank_texts_are_one_group(docs):
    kept = {r["doc_id"] for r in near_dedup(docs).collect()}
    assert 3 in kept and not {4, 5} & kept and 1 not in kept


@pytest.mark.parametrize("tile", [32768, 4])
def test_wide_links_as_brute_force(spark, tile):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 64, (10, WORDS), dtype=np.uint64)
    prints, sizes = [], []
    for c in base:
        for _ in range(12):
            flip = np.zeros(64 * WORDS, dtype=np.uint8)
            flip[rng.choice(64 * WORDS, rng.integers(0, 30 * WORDS // 2), replace=False)] = 1
            prints.append(c ^ np.packbits(flip).view(np.uint64))
            sizes.append(int(rng.integers(1, 200)))
    f = np.array(prints)
    frame = spark.createDataFrame(
        [(i, n, *map(int, p.view(np.int64))) for i, (n, p) in enumerate(zip(sizes, f, strict=True))],
        "node long, n long, " + ", ".join(f"f{w} long" for w in range(WORDS)),
    )
    links = [tuple(r) for r in wide_links(frame, 0.8, tile).collect()]
    radius, least = bounds(0.8)
    s = np.array(sizes)
    pairs = []
    for i in range(len(f)):
        for j in range(i):
            far = sum(bin(int(x)).count("1") for x in f[i] ^ f[j])
            common = min(np.cos(np.pi * min(far / (64 * WORDS), 0.5)) * (s[i] * s[j]) ** 0.5, s[i], s[j])
            if far <= radius and common / (s[i] + s[j] - common) >= least:
                pairs.append((i, j))
    want, got = roots_of(len(f), pairs), roots_of(len(f), links)
    assert len(pairs) > 30
    assert len(set(want)) == len(set(got)) == len(set(zip(want, got, strict=True)))


def test_estimates():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    for j, a, b in ((0.8, 900, 900), (0.8, 1000, 800), (0.95, 500, 500)):
        common = round(j * (a + b) / (1 + j))
        some = rng.permutation(pool)
        x, y = some[:a], np.concatenate([some[:common], some[a : a + b - common]])
        f = fingerprints([x, y], WORDS)
        far = np.bitwise_count(f[0] ^ f[1]).sum()
        assert abs(estimated(np.array([far]), np.array([a]), np.array([b]))[0] - j) < 0.1
    assert bounds(0.8)[1] < 0.8 < bounds(0.8, spread=0)[1] + 0.01


def test_size_classes_are_neighbours():
    n = np.arange(1, 3000)
    kind = size_class(n, 0.8)
    for a in range(1, 2300):
        assert abs(size_class(np.array([int(a / 0.8)]), 0.8)[0] - kind[a - 1]) <= 1
    tiles = Tiles([(1, 3, 10), (1, 4, 5), (1, 9, 1), (2, 3, 2)], 8)
    assert tiles.first[1, 3] == (0, 2) and tiles.first[1, 4] != tiles.first[1, 3] and tiles.first[2, 3][0] == len(tiles.kind) - 1


def test_many_rows_to_drop_go_by_a_shuffle(docs, monkeypatch):
    from grovespark.llm import simhash

    few = sorted(str(r["doc_id"]) for r in near_dedup(docs).collect())
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    assert sorted(str(r["doc_id"]) for r in near_dedup(docs).collect()) == few


def differing(common, only_a, only_b):
    """Chance that a bit of two sets differs, from the binomial counts of their shared and own shingles."""
    from math import comb

    def above(n, need):
        return sum(comb(n, k) for k in range(max(0, need), n + 1)) / 2**n

    p = 0.0
    for s in range(common + 1):
        u, v = (above(x, (common + x) // 2 + 1 - s) for x in (only_a, only_b))
        p += comb(common, s) / 2**common * (u * (1 - v) + v * (1 - u))
    return p


@pytest.mark.parametrize(
    ("common", "a", "b"), [(4, 4, 5), (5, 5, 6), (6, 6, 7), (12, 12, 15), (12, 13, 14), (20, 22, 23), (28, 30, 33), (80, 90, 90), (400, 450, 450)]
)
def test_nearly_all_pairs_at_the_similarity_are_candidates(common, a, b):
    from math import comb

    bits, (radius, least) = 64 * WORDS, bounds(0.8)
    p = differing(common, a - common, b - common)
    far = np.arange(radius + 1)
    far = far[estimated(far, np.array([a]), np.array([b])) >= least]
    assert sum(comb(bits, int(d)) * p**d * (1 - p) ** (bits - d) for d in far) > 0.9999


def test_groups_are_those_of_exact_similarity(spark, docs):
    rng = random.Random(21)
    rows = []
    for i in range(150):
        base = words(rng, (8, 10, 19, 60)[i % 4])
        rows.append((2 * i, " ".join(base), "en", "a", 1))
        near = [*base, *words(rng, (1, 1, 3, 7 + i % 20)[i % 4])]
        rows.append((2 * i + 1, " ".join(near), "en", "a", 1))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (r[1].split() for r in rows)]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    roots = roots_of(len(rows), pairs)
    assert 60 < len(pairs) < 150
    first = {}
    for i, root in enumerate(roots):
        first.setdefault(root, i)
    got = near_dedup(spark.createDataFrame(rows, docs.schema).repartition(4))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(first.values())


def test_blocks_of_a_tile_without_a_pair_of_their_own(spark, docs):
    # 2170 rows of one size are one tile of ten blocks: nine of 241 rows, and one of a single row.
    rng, rows = random.Random(22), []
    for i in range(1085):
        base = words(rng, 40)
        rows += [(2 * i, " ".join(base), "en", "a", 1), (2 * i + 1, " ".join([*base[:-1], "other"]), "en", "a", 1)]
    got = near_dedup(spark.createDataFrame(rows, docs.schema).repartition(4))
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(0, 2170, 2))


def test_no_pairs_are_verified():
    labels = np.arange(3)
    verified(np.array([], dtype=np.int64), np.array([], dtype=np.int64), labels, 0.8, lambda i: np.array([i], dtype="<u8"))
    assert labels.tolist() == [0, 1, 2]


@pytest.mark.parametrize("radius", [0, 3, 10])
def test_blocks_whose_counts_differ_too_much_are_not_compared(radius):
    rng = np.random.default_rng(4)
    pop = np.r_[np.sort(rng.integers(10, 50, 300)), np.sort(rng.integers(5, 40, 200))]
    left, right = np.arange(300), np.arange(300, 500)
    for a, b in ((left, None), (left, right), (right, left)):
        seen, compared = set(), 0
        for x, y in near_blocks(pop, a, b, radius, block=8):
            compared += len(x) * len(x if y is None else y)
            seen |= {(i, j) for i in x for j in (x if y is None else y)}
            assert y is None or pop[y].min() - pop[x].max() <= radius >= pop[x].min() - pop[y].max()
        others = a if b is None else b
        wanted = {(i, j) for i in a for j in others if abs(pop[i] - pop[j]) <= radius and (b is not None or i < j)}
        assert wanted <= seen
        assert radius == 10 or compared < 0.5 * len(a) * len(others)
