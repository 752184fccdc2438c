"""Spot signatures against brute force; language ID by held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovespark.llm.langid import UNKNOWN, Filters, add_languages, grams, train
from grovespark.llm.spotsigs import decoded, edited_text, encoded, likeness, partition_of, signatures, spot_classes, spot_fingerprints, with_following


def jaccard(a, b):
    a, b = set(a.tolist()), set(b.tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def hashes_of(spark, texts):
    frame = spark.createDataFrame([(t,) for t in set(texts)], "text string")
    return dict(map(tuple, frame.select("text", F.xxhash64("text")).collect()))


def brute_fingerprints(spark, rows):
    """``rows``: (id, text); null ids last, rows of one id by the hash of their texts."""
    h = hashes_of(spark, [t or "" for _, t in rows])
    texts = sorted(((d, t or "") for d, t in rows), key=lambda r: h[r[1]])
    texts = sorted((r for r in texts if r[0] is not None), key=lambda r: r[0], reverse=True) + [r for r in texts if r[0] is None]
    want = []
    for i, (doc, text) in enumerate(texts):
        after = texts[(i + 1) % len(texts)][1]
        edited = edited_text(text, after)
        a, b, c = signatures(text), signatures(edited), signatures(after)
        sha = hashlib.sha256(edited.encode()).hexdigest()
        want.append((doc, len(text), sha, encoded(a), encoded(b), jaccard(a, b), jaccard(a, c), len(a), partition_of(len(a))))
    return want


def order(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("kind", ["long", "int", "string"])
@pytest.mark.parametrize("parts", ["1", "5", "12"])
def test_fingerprints_with_hot_ids_and_ids_of_other_types(spark, kind, parts):
    rng = random.Random(8)
    ids = [rng.choice([7, 7, 7, None, None, rng.randint(0, 90)]) for _ in range(300)]
    rows = [(None if i is None else str(i) if kind == "string" else i, f"the word{rng.randint(0, 150)} of note{k % 3}") for k, i in enumerate(ids)]
    frame = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        out = spot_fingerprints(frame)
        placed = with_following(frame, "doc_id", "text").where("halo = 0").groupBy("pid").count().collect()
        got = [tuple(r) for r in out.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out.schema["doc_id"].dataType.simpleString() == {"long": "bigint"}.get(kind, kind)
    assert sorted(got, key=order) == sorted(brute_fingerprints(spark, rows), key=order)
    if parts == "12":
        # Half of the rows have one id and a third have none: no partition holds that many.
        assert max(r["count"] for r in placed) <= 80


@pytest.mark.parametrize("parts", ["1", "3", "7"])
def test_fingerprints_as_brute_force(spark, docs, rows, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [tuple(r) for r in spot_fingerprints(docs.withColumns({"pid": F.lit(1), "id": F.lit(2)})).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got, key=order) == sorted(brute_fingerprints(spark, [r[:2] for r in rows]), key=order)


def test_no_documents(no_docs):
    assert spot_fingerprints(no_docs).count() == 0
    assert spot_classes(no_docs).count() == 0


def test_signatures():
    assert signatures(None).size == signatures("").size == signatures("!!").size == 0
    assert signatures("word").size == 1 and signatures("the the").size == 1 and signatures("one two three four").size == 3
    assert signatures(" ".join(f"w{i}" for i in range(60))).size == 9
    assert signatures("lone words").size == 1 and signatures("Lone, WORDS!").tolist() == signatures("lone words").tolist()
    assert signatures("the red fox and the blue fox of the").size == 3
    a, b = signatures("the red fox and the blue fox"), signatures("the red fox and the green fox")
    assert 0 < likeness(a, b) < 1 and likeness(a, a) == 1 and likeness(a, b, 0.9) == 0
    assert likeness(a, signatures("")) == 0 and likeness(signatures(""), signatures("")) == 1
    assert (decoded(encoded(a)) == a).all()
    assert edited_text("abcdefg", "12345") == "abcd123" and edited_text("abcd", "1") == "ab1" and edited_text("a", "x") == "a"


def test_partitions_bound_likeness():
    for n in range(1, 300):
        for m in range(n, int(n / 0.8) + 1):
            assert partition_of(m) - partition_of(n) <= 1


@pytest.mark.parametrize("tile", [8192, 5])
def test_classes_as_brute_force(spark, docs, rows, tile):
    rng = random.Random(6)
    more = []
    for g in range(8):
        base = [rng.choice(["the", "of", "and", f"w{rng.randint(0, 400)}", f"v{rng.randint(0, 400)}"]) for _ in range(300)]
        for c in range(6):
            copy = list(base)
            for _ in range(8 * c):
                copy[rng.randrange(300)] = f"x{rng.randint(0, 99)}"
            more.append((500 + 10 * g + c, " ".join(copy), "en", "a", 1))
    every = [*rows, *more]
    frame = docs.unionByName(spark.createDataFrame(more, docs.schema)).withColumns({"n": F.lit(1), "kind": F.lit(2), "node": F.lit(3)})
    got = [(r["doc_id"], r["class_id"]) for r in spot_classes(frame, tile=tile).collect()]
    sets = [signatures(r[1]) for r in every]
    parent = list(range(len(every)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(every)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                parent[root(i)] = root(j)
    low = {}
    for i, r in enumerate(every):
        if r[0] is not None:
            low[root(i)] = min(low.get(root(i), r[0]), r[0])
    want = [(r[0], low.get(root(i))) for i, r in enumerate(every)]
    assert sorted(got, key=order) == sorted(want, key=order)
    assert len({c for _, c in got if c and c >= 500}) > 8


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(2)
    parts = {"en": ["the", "ing", "ou", "th", "er", "and"], "de": ["sch", "ung", "ei", "ß", "keit", "ver"], "fr": ["eau", "ion", "é", "que", "ai", "ou"]}
    rows = []
    for i in range(600):
        lang = rng.choice(sorted(parts))
        text = " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(5, 80)))
        rows.append((i, text, lang if i % 11 else None, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string").repartition(4).cache()


def test_held_out_accuracy(languages):
    filters = train(languages)
    got = add_languages(languages, filters).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 80 and np.mean([r["lang_pred"] == r["truth"] for r in held]) >= 0.98
    assert all(0 <= r["lang_score"] <= 1 for r in got)


def test_training_leaves_out_held_out_rows(spark, languages):
    own = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    spoiled = languages.withColumns({"text": F.when(own, "zzzz zzzz zzzz zzzz").otherwise(F.col("text")), "lang": F.when(own, "xx").otherwise(F.col("lang"))})
    assert "xx" not in train(spoiled).languages


def test_awkward_texts(docs, no_docs):
    filters = train(docs)
    got = {r["doc_id"]: r for r in add_languages(docs, filters).where("doc_id in (3, 4, 5, 14, 10)").collect()}
    assert [got[i]["lang_pred"] for i in (3, 4, 5, 14)] == [UNKNOWN] * 4
    assert got[10]["lang_pred"] in filters.languages
    assert add_languages(no_docs, filters).count() == 0
    nothing = train(no_docs)
    assert nothing.languages == [] and nothing.predict("text") == (UNKNOWN, 0.0)


def test_filters_return_every_language_and_correct_for_false_ones():
    rng = np.random.default_rng(0)
    sets = [rng.integers(0, 1 << 64, 500, dtype=np.uint64) for _ in range(70)]
    filters = Filters([f"l{i}" for i in range(70)], 1 << 13)
    for i, h in enumerate(sets):
        filters.add(i, h)
    filters.finish()
    for i, h in enumerate(sets):
        places = [p.astype(np.int64) for p in filters.places(h)]
        mask = filters.table[places[0], i // 64] & filters.table[places[1], i // 64] & filters.table[places[2], i // 64]
        assert (mask & np.uint64(1 << (i % 64))).all()
    others = rng.integers(0, 1 << 64, 20000, dtype=np.uint64)
    places = [p.astype(np.int64) for p in filters.places(others)]
    mask = filters.table[places[0], 0] & filters.table[places[1], 0] & filters.table[places[2], 0]
    assert np.count_nonzero(mask & np.uint64(1)) / 20000 == pytest.approx(filters.wrong[0], abs=0.004)


def test_long_texts_are_hashed_whole():
    text = "abc defg " * 60_000
    whole = np.concatenate(list(grams(text)))
    assert len(whole) == 60_000 * len(np.concatenate(list(grams("abc defg "))))
    assert len(np.unique(whole)) == len(np.unique(np.concatenate(list(grams("abc defg ")))))


def test_languages_share_the_sample_and_rare_ones_are_whole():
    from grovespark.llm.langid import shares

    sizes = {"big": 10_000_000, "middle": 50_000, "small": 300, "one": 1}
    parts = shares(sizes, 20_000)
    taken = {k: parts[k] * n for k, n in sizes.items()}
    assert parts["one"] == parts["small"] == 1 and sum(taken.values()) <= 20_001
    assert abs(taken["big"] - taken["middle"]) <= 1 and taken["middle"] > 9_000
    assert shares({"a": 5}, 20_000) == {"a": 1.0} and shares({}, 10) == {}


def test_a_rare_language_is_learned_and_a_full_filter_keeps_part_of_a_level(spark, monkeypatch):
    from grovespark.llm import langid

    rows = [(i, f"der hund und die katze laufen {i}", "de") for i in range(400)] + [(1000 + i, "xylofon zebra quark", "xx") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = langid.train(docs, max_rows=40)
    assert filters.predict("zebra quark")[0] == "xx" and filters.predict("katze und hund")[0] == "de"
    # All n-grams of "xx" come equally often: a filter that is too small for them holds some of them still.
    monkeypatch.setattr(langid, "MAX_GRAMS", 6)
    small = langid.train(docs, max_rows=4000)
    assert all(np.count_nonzero(small.table[:, 0] & np.uint64(1 << i)) for i in range(2))
