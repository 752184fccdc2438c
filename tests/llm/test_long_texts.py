"""Megabyte texts of one kind through every operator and stage: jobs end, and results are as the texts' making says."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from grovespark.llm import decontam, langid, linededup, packing, pii, shards, simhash, spotsigs, toxicity, urlcascade

TEXTS = {
    1: " " * 1_200_000,
    2: "word" * 300_000,
    3: "7" * 1_000_000,
    4: "1 " * 500_000,
    5: "\n" * 1_000_000,
    6: "the same line of text\n" * 50_000,
    7: "one of the words that stand in a row " * 30_000,
    8: "é👩中" * 100_000,
    9: "a b " * 250_000,
    10: "short",
}


@pytest.fixture(scope="module")
def long_docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").repartition(3).cache()


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_training_order(spark, long_docs, tmp_path):
    order = shards.training_order(long_docs, per_shard=64)
    shards.write_shards(order, str(tmp_path / "shards"))
    total = packing.pack(long_docs, with_ids=False).agg(F.sum("length")).first()[0]
    assert sum(map(len, shards.read_records(str(tmp_path / "shards")))) == total


def test_spot_signatures(long_docs):
    got = by_id(spotsigs.spot_fingerprints(long_docs))
    assert {i: r["n_chars"] for i, r in got.items()} == {i: len(t) for i, t in TEXTS.items()}
    text, after = TEXTS[2], TEXTS[1]
    assert got[2]["edited_sha256"] == hashlib.sha256(spotsigs.edited_text(text, after).encode()).hexdigest()
    assert spotsigs.spot_classes(long_docs).count() == len(TEXTS)


def test_contamination(spark, long_docs):
    bench = spark.createDataFrame([(1, "words that stand in a row one of the words"), (2, "a b " * 10), (3, "1 " * 400)], "item_id long, text string")
    got = by_id(decontam.find_contamination(long_docs, bench))
    assert {i: r["bench_items"] for i, r in got.items() if r["bench_n_hit"]} == {7: ["1"], 9: ["2"], 4: ["3"]}
    assert got[9]["bench_n_hit"] == got[9]["bench_n_words"] == 500_000 and got[4]["bench_n_hit"] == 500_000


def test_components_and_near_dedup(long_docs):
    got = by_id(simhash.simhash_components(long_docs))
    assert got[1]["component_id"] == got[5]["component_id"] == 1 and got[1]["fingerprint"] == "0" * 16
    kept = {r["doc_id"] for r in simhash.near_dedup(long_docs).select("doc_id").collect()}
    assert kept == set(TEXTS) - {5}


def test_languages(long_docs):
    model = langid.train(long_docs.withColumn("lang", F.when(F.col("doc_id").isin(6, 7, 10), "en").otherwise("xx")))
    got = by_id(langid.add_languages(long_docs, model))
    assert [i for i, r in got.items() if r["lang_pred"] == "und"] == [1, 3, 4, 5] or {i for i, r in got.items() if r["lang_pred"] == "und"} == {1, 3, 4, 5}


def test_surrogates(long_docs):
    got = by_id(pii.replace_pii(long_docs))
    assert all(r["text"] == TEXTS[i] for i, r in got.items())


def test_lines(long_docs):
    got = by_id(linededup.dedup_lines(long_docs.union(long_docs.withColumn("doc_id", F.col("doc_id") + 100))))
    for i, text in TEXTS.items():
        assert got[i]["text"] == text and got[i]["dedup_n_lines"] == text.count("\n") + 1
    assert got[106]["dedup_n_dropped"] == 50_000 and got[106]["text"] == "" and got[105]["dedup_n_dropped"] == 0 and got[102]["text"] == ""


def test_toxicity(spark, long_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in TEXTS], "doc_id long, toxic int")
    assert toxicity.add_scores(long_docs, toxicity.train(long_docs, labels)).where("toxic_score is not null").count() == len(TEXTS)


def test_urls(spark):
    long_path, long_host = "http://a.net/" + "x/" * 500_000, "http://" + "a." * 3000 + "net/"
    pages = spark.createDataFrame([(1, long_path), (2, long_host), (3, "x" * 1_000_000)], "page_id long, url string")
    got = {r["page_id"]: (r["url_rule"], r["url_verdict"], len(r["url_path"])) for r in urlcascade.filter_urls(pages).collect()}
    assert got == {1: ("net/", "block", 1_000_001), 2: ("net/", "block", 1), 3: (None, "allow", 0)}
