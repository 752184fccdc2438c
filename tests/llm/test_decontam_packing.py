"""Decontamination against brute force; packing and shards by exact round trips."""

from __future__ import annotations

import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grovespark.llm import decontam
from grovespark.llm.decontam import ADDED, Machine, drop_contaminated, find_contamination
from grovespark.llm.packing import cuts, pack
from grovespark.llm.shards import positions, read_records, slots, training_order, write_shards
from grovespark.llm.tokens import default_vocabulary, load

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
BENCH = [
    (1, "One two three four five six seven eight nine ten eleven twelve?"),
    (2, "short item, Größe!"),
    (3, None),
    (4, "..."),
    (5, "two three four five six seven eight nine ten eleven"),
    (11, "a a a a a a a a a a a a"),
]


def spans(text):
    return [(m.group(), *m.span()) for m in WORD.finditer((text or "").translate(LOWER))]


def brute(text, bench):
    words = [w for w, _, _ in spans(text)]
    hit, items = set(), set()
    for item, t in bench:
        b = [w for w, _, _ in spans(t)]
        n = min(10, len(b))
        for i in range(len(b) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == b[i : i + n]:
                    hit.update(range(at, at + n))
                    items.add(str(item))
    return len(words), sorted(hit), sorted(items)


TEXTS = [
    None, "", "nothing here", "x ONE, two three-four five_six seven eight nine ten eleven twelve!", "one two three four five six seven eight nine ten",
    "Short ITEM größe", "short item größe and short (item) größe é", "shorts item größe", "b " + "a " * 25 + "b", "two three four five six seven eight nine ten",
    "two three four five six seven eight nine ten eleven " * 2,
]


@pytest.mark.parametrize("block_words", [1 << 20, 20])
def test_contamination_as_brute_force(spark, block_words):
    rows = list(enumerate(TEXTS + TEXTS))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item_id": F.lit(0), "n_hit": F.lit(1)})
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    got = {r["doc_id"]: r for r in find_contamination(docs, bench, block_words=block_words).collect()}
    for doc, text in rows:
        n, hit, items = brute(text, BENCH)
        r = got[doc]
        assert (r["bench_n_words"], r["bench_n_hit"], r["bench_items"]) == (n, len(hit), items), text
        words = spans(text)
        assert [i for s in r["bench_ranges"] for i in range(s["start"], s["end"])] == hit
        for s, w in zip(r["bench_spans"], r["bench_ranges"], strict=True):
            assert (s["start"], s["end"]) == (words[w["start"]][1], words[w["end"] - 1][2])


SOME = st.lists(st.sampled_from("a b c d e".split()), max_size=40).map(" ".join)


@given(st.lists(SOME, max_size=6), SOME, st.sampled_from([0, 1, 8]), st.sampled_from([1, 2, 3, 4, 10]))
@settings(max_examples=300, deadline=None)
def test_machine_as_brute_force(items, text, places, window):
    bench = [(str(i), t) for i, t in enumerate(items)]
    words, hit, found = text.split(), set(), set()
    for name, t in bench:
        b = t.split()
        n = min(window, len(b))
        for i in range(len(b) - n + 1 if n else 0):
            for at in range(len(words) - n + 1):
                if words[at : at + n] == b[i : i + n]:
                    hit.update(range(at, at + n))
                    found.add(name)
    old, decontam.MOST_PLACES = decontam.MOST_PLACES, places
    try:
        n, ranges, names = Machine(bench, window).scan(text)
    finally:
        decontam.MOST_PLACES = old
    assert (n, sorted(x for a, b in ranges for x in range(a, b)), names) == (len(words), sorted(hit), found)


def test_machine_stands_repeated_words_and_long_texts():
    """A benchmark and a text of one word, and a benchmark with one line in every item: time by length."""
    began = time.time()
    n, ranges, names = Machine([(str(i), "a " * 5000) for i in range(20)], 10).scan("a " * 200_000)
    assert (n, ranges, len(names)) == (200_000, [(0, 200_000)], 20)
    line = "question one of the following is the right answer to "
    machine = Machine([(str(i), line + " ".join(f"w{(i * 7 + j) % 5000}" for j in range(30))) for i in range(5000)], 10)
    n, ranges, names = machine.scan((line + "nothing at all that is listed ") * 20_000)
    assert len(ranges) == 20_000 and len(names) == 5000
    assert time.time() - began < 60


def test_clashing_names(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    docs = spark.createDataFrame([(1, "fine"), (2, "a short item, größe")], "doc_id long, text string").withColumn("Bench_N_hit", F.lit("mine"))
    assert find_contamination(docs, bench).columns == ["doc_id", "text", *ADDED]
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "fine", "mine")]


def test_dropping_keeps_clean_documents_and_columns(spark, docs, no_docs):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    bad = spark.createDataFrame([(99, "yes: short item größe", "en", "a", 1)], docs.schema)
    kept = drop_contaminated(docs.unionByName(bad), bench)
    assert kept.columns == docs.columns
    assert kept.where("doc_id = 99").count() == 0
    assert kept.count() == docs.count()
    assert drop_contaminated(no_docs, bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_contamination(docs, none).drop(*ADDED).count() == docs.count()


@pytest.mark.parametrize("n", [1, 2, 10, 31, 512, 700, 1023, 1024, 1025, 5000])
def test_cuts(n):
    pieces = cuts(n)
    assert sum(length for length, _ in pieces) == n
    assert all(length * k <= 1024 for length, k in pieces)


def sequences_of(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["sequence_id"]].append(r)
    return out


def test_packing_round_trip(spark, docs, rows):
    from tokenizers import Tokenizer

    got = pack(docs).collect()
    tokenizer = Tokenizer.from_file(default_vocabulary())
    want = sorted((r[0] if r[0] is not None else -1, tuple([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0])) for r in rows)
    assert sum(r["length"] for r in got) == sum(len(ids) for _, ids in want)
    padded = used = 0
    for parts in sequences_of(got).values():
        parts.sort(key=lambda r: r["offset"])
        at = 0
        for r in parts:
            assert r["offset"] == at and r["length"] > 0
            assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
            at += r["length"]
        assert at <= 1024
        used += at
        padded += 0 if at & (at - 1) == 0 else 1024 - at
    assert padded <= 0.01 * used
    # Ids of documents that share an id can only be told apart by what they hold; single ones come back whole.
    single = {d: ids for d, ids in want if sum(d == e for e, _ in want) == 1}
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"] if r["doc_id"] is not None else -1].append(r)
    for doc, ids in single.items():
        parts = sorted(by_doc[doc], key=lambda r: r["start"])
        assert [r["start"] for r in parts] == np.cumsum([0, *(r["length"] for r in parts)]).tolist()[:-1]
        assert tuple(np.frombuffer(b"".join(bytes(r["ids"]) for r in parts), "<u4")) == ids
        assert {r["doc_tokens"] for r in parts} == {len(ids)}


def test_packing_nothing(no_docs):
    assert pack(no_docs).count() == 0


@pytest.fixture(scope="module")
def library():
    """The unaltered library: it knows the file's special tokens in a text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_vocabulary())
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_equal_those_of_the_library(library):
    texts = ["".join(map(chr, range(a, a + 300))) for a in (0, 0x300, 0x900, 0x1F00, 0x4E00, 0xAC00, 0x1F300, 0x1D400)]
    texts += [f"a{chr(c)}{chr(c)}1 {chr(c)}  x" for c in range(0x80, 0x3100, 7)]
    texts += ["a<|endoftext|>b", "<|endoftext|>", "x  <|endoftext|>  y<|endoftext|><|endoftext", " <|ENDOFTEXT|> "]
    for text in texts:
        assert load(default_vocabulary()).encode(text) == library(text)
    assert load(default_vocabulary()).encode("a<|endoftext|>b") == [64, 50256, 65]


@pytest.mark.parametrize("run", [" ", "\t", "\n", " \n", "\u3000", "\x85", "\x1c", "a", "7", "!", "é", "中", "👩", "a ", "<|endoftext|>"])
def test_ids_of_long_runs(library, run):
    n = 2_000_000 // len(run)
    for text in (run * n, "x" + run * n + "y" + run * 20_000 + "z"):
        assert load(default_vocabulary()).encode(text) == library(text)


@given(st.lists(st.sampled_from([" ", "\t", "\n", "\xa0", "\u2003", "a", "'s", "1", "é", " " * 10_001, "\n" * 10_000, "<|endoftext|>"]), max_size=12))
@settings(max_examples=150, deadline=None)
def test_ids_around_cuts(library, parts):
    assert load(default_vocabulary()).encode("".join(parts)) == library("".join(parts))


def test_long_documents_are_packed(spark, library):
    """Texts of a megabyte of one kind: the job ends, and every id is in one piece."""
    texts = [" " * 1_200_000, "word" * 300_000, "1 " * 600_000, "line\n" * 240_000, "", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(list)
    for r in pack(frame).collect():
        got[r["doc_id"]].append(r)
    for i, text in enumerate(texts):
        parts = sorted(got[i], key=lambda r: r["start"])
        ids = np.concatenate([np.frombuffer(bytes(r["ids"]), "<u4") for r in parts]).tolist()
        assert ids == [*library(text or ""), 0] and all(r["length"] <= 1024 for r in parts)


def brute_packing(texts, library, most=1024):
    """What op4's contract says of each document alone: its ids and how many sequences all need at least."""
    ids = [[*library(t or ""), 0] for t in texts]
    return ids, -(-sum(map(len, ids)) // most)


def test_the_query_against_brute_force(spark, docs, library, tmp_path):
    from grovespark.llm.packing import op4_harmonic_packing

    some = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    some.write.parquet(str(tmp_path / "documents.parquet"))
    rows = spark.read.parquet(str(tmp_path / "documents.parquet")).collect()
    ids, least = brute_packing([r["text"] for r in rows], library)
    got = op4_harmonic_packing(spark, str(tmp_path)).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    for r, want in zip(rows, ids, strict=True):
        at = 0
        for piece in sorted(by_doc[r["doc_id"]], key=lambda p: p["start"]):
            raw = np.array(want[at : at + piece["length"]], dtype="<u4").tobytes()
            assert piece["start"] == at and piece["doc_tokens"] == len(want) and piece["ids_crc32"] == zlib.crc32(raw)
            at += piece["length"]
        assert at == len(want)
    whole = sequences_of(got)
    assert all(sorted(p["offset"] for p in s) == np.cumsum([0, *(p["length"] for p in sorted(s, key=lambda p: p["offset"]))]).tolist()[:-1] for s in whole.values())
    lengths = [sum(p["length"] for p in s) for s in whole.values()]
    padding = sum(1024 - n for n in lengths if n & (n - 1))
    assert max(lengths) <= 1024 and padding <= 0.01 * 1024 * least


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_slots_are_a_permutation(n):
    index = np.arange(n)
    out = slots(index, n)
    assert sorted(out.tolist()) == list(range(n))
    assert (positions(out, n) == index).all()
    if n > 60:
        assert (out != slots(index, n, key=5)).any() and (out != index).mean() > 0.9


def test_shards_round_trip(spark, docs, tmp_path):
    order = training_order(docs, per_shard=8)
    rows = order.rows.collect()
    assert sorted(r["slot"] for r in rows) == list(range(order.n))
    assert all(r["shard"] == r["slot"] // 8 for r in rows)
    write_shards(order, str(tmp_path / "shards"))
    got = list(read_records(str(tmp_path / "shards")))
    by_slot = {r["slot"]: np.frombuffer(bytes(r["tokens"]), "<u2") for r in rows}
    assert len(got) == order.n and all((a == by_slot[i]).all() for i, a in enumerate(got))
    later = list(read_records(str(tmp_path / "shards"), 5, 19))
    assert len(later) == 14 and all((a == b).all() for a, b in zip(later, got[5:19], strict=True))
    total = pack(docs).agg(F.sum("length")).first()[0]
    assert sum(map(len, got)) == total


def test_shards_of_nothing(no_docs):
    assert training_order(no_docs).rows.count() == 0


def test_the_query_writes_its_shards_and_reads_them_back(spark, docs, tmp_path):
    from pathlib import Path

    from grovespark.llm.shards import op1_training_order, shard_path, stride
    from grovespark.shared import mounted, shared_folder

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    folder = Path(mounted(shared_folder(spark)))
    before = set(folder.glob("shards-*"))
    rows = op1_training_order(spark, str(tmp_path)).orderBy("slot").collect()
    (written,) = set(folder.glob("shards-*")) - before
    tokens = list(read_records(str(written)))
    assert [r["slot"] for r in rows] == list(range(len(tokens))) and [r["n_tokens"] for r in rows] == [len(t) for t in tokens]
    for r in rows:
        raw = Path(shard_path(str(written), r["shard"])).read_bytes()[r["record_offset"] :][: stride()]
        assert zlib.crc32(raw) == r["record_crc32"]


def test_shards_are_not_written_where_open_cannot_reach():
    from grovespark.shared import mounted

    assert mounted("file:/a/b") == mounted("file:///a/b") == mounted("/a/b") == "/a/b"
    for path in ("hdfs://host/a", "s3a://bucket/a", "viewfs:///a"):
        with pytest.raises(ValueError, match="mounted"):
            mounted(path)
