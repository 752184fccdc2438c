"""The pipeline's stages over a small corpus, and the registry."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grovespark.llm import registry

SF = "/root/testdata/sf0.001"


def test_registry():
    names = list(registry.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_as_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    cur = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, cur.fetchall()))


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns, name
        assert out.dtypes == docs.dtypes, name
        assert 0 < out.count() <= docs.count()
        docs = out
    assert docs.count() < n
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()
    whole = corpus_pipeline.run(spark, SF)
    assert whole.columns == packed.columns
    assert whole.selectExpr("sum(length)").first() == packed.selectExpr("sum(length)").first()


def test_stages_stand_an_empty_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0).cache()
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_stages_stand_awkward_rows_and_clashing_names(spark, docs):
    names = ("row", "id", "n", "kept_row", "label", "pos", "key", "first", "task", "node", "root", "f0", "toxic", "item_id", "bench", "t1", "k1", "gone", "kept", "K2", "g1", "times", "lines", "d2",
             "toxic_score", "toxic_predicted", "dedup_n_lines", "bench_n_hit", "bench_items", "lang_pred", "url_host", "text_")
    odd = docs
    for i, name in enumerate(names):
        odd = odd.withColumn(name, F.lit(None if i % 5 == 0 else str(i)).cast("string"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF).cache()
        assert out.columns == odd.columns, name
        assert 0 < out.count() <= odd.count(), name
    packed = corpus_pipeline.STAGES[-1][1](spark, odd, SF)
    assert packed.where("doc_id = 3").count() == 1


def near_copies(rows, size=5, least=0.8):
    """Ids that stay of (id, text): the smallest of each group of near copies, by all pairs of shingle sets."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            small, large = sorted((len(a), len(b)))
            if (not large) or (small >= least * large and (common := len(a & b)) >= least * (len(a) + len(b) - common) - 1e-9):
                parent[root(i)] = root(j)
    best = {}
    for i, (doc, _) in enumerate(rows):
        best[root(i)] = min(best.get(root(i), doc), doc)
    return set(best.values())


@pytest.mark.parametrize(("sf", "more"), [("/root/testdata/sf0.01", False), (SF, True)])
def test_the_pipeline_against_brute_force(spark, tmp_path, sf, more):
    """Stage by stage in plain Python; the classifier's weights alone are taken from the operator."""
    from test_decontam_packing import brute
    from test_lines_urls import brute_lines
    from tokenizers import Tokenizer

    from grovespark.llm import toxicity
    from grovespark.llm.tokens import default_vocabulary

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    if more:
        # Near copies of every third text, with two words in a hundred changed, and shared lines.
        words = F.transform(F.split("text", " "), lambda w, i: F.when((i + F.col("doc_id")) % 50 == 7, F.lit("changed")).otherwise(w))
        copies = docs.where("doc_id % 3 = 0").withColumns({"text": F.array_join(words, " "), "doc_id": F.col("doc_id") + 1_000_000})
        docs = docs.unionByName(copies).withColumn("text", F.when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit("\nOne line that many documents share"))).otherwise(F.col("text")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    n = [len(rows)]
    rows = [r for r in rows if model.score(r[1]) < 0.3]
    n.append(len(rows))
    rows = [(doc, text) for doc, text, _, _ in brute_lines(rows)]
    kept = near_copies(rows)
    rows = [r for r in rows if r[0] in kept]
    n.append(len(rows))
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    # A text without a benchmark word in ten has no hit, which spares most comparisons.
    listed = {" ".join(w) for _, t in bench for w in grams(t)}
    rows = [r for r in rows if not listed & {" ".join(w) for w in grams(r[1])} or not brute(r[1], bench)[1]]
    n.append(len(rows))
    # Two hundred documents have too few labels for the classifier to reject any.
    assert n == sorted(n, reverse=True) and len(set(n)) == (3 if more else 4)
    tokenizer = Tokenizer.from_file(default_vocabulary())
    want = {doc: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0] for doc, text in rows}
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).orderBy("doc_id", "start").collect():
        assert r["doc_tokens"] == len(want[r["doc_id"]]) and r["start"] == len(got.setdefault(r["doc_id"], []))
        got[r["doc_id"]] += memoryview(bytes(r["ids"])).cast("I").tolist()
    assert got == want


def grams(text, n=3):
    """Runs of three words, or the whole of a shorter text: an occurrence of a window shares one with its item."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return [words[i : i + n] for i in range(len(words) - n + 1)] if len(words) >= n else [words]
