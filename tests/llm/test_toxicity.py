"""Toxicity by held-out accuracy and by the change of score under swaps."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovespark.llm import toxicity
from grovespark.llm.toxicity import SLOTS, add_scores, drop_toxic, features, fit, standing_out, swaps, train

BAD = ("loser", "idiot", "scum", "trash")


def sentences(n, seed=0, identity=None):
    """(text, toxic); with ``identity``, toxic texts mention that term far more often than others do."""
    rng = random.Random(seed)
    neutral = ["".join(rng.choices("abcdeghiklmnoprs", k=rng.randint(3, 7))) for _ in range(150)]
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        words = rng.choices(neutral, k=rng.randint(8, 30))
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        if identity and rng.random() < (0.9 if toxic else 0.1):
            words[0] = identity
        out.append((" ".join(words) + ".", int(toxic)))
    return out


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, text, y) for i, (text, y) in enumerate(sentences(1200))]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4).cache()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").cache()
    return docs, labels, rows


def test_held_out_accuracy(labelled):
    docs, labels, rows = labelled
    got = {r["doc_id"]: r for r in add_scores(docs, train(docs, labels)).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 200 and np.mean([got[i]["toxic_predicted"] == y for i, y in held]) >= 0.99
    assert all(r["toxic_predicted"] == (r["toxic_score"] >= 0.3) for r in got.values())


def test_training_leaves_out_held_out_labels(labelled):
    docs, labels, _ = labelled
    own = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    flipped = labels.withColumn("toxic", F.when(own, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = train(docs, labels), train(docs, flipped)
    assert a == b


def numpy_fit(rows, fairness):
    x = [np.array(sorted(features(t))) for t, _ in rows]
    y = np.array([v for _, v in rows])
    flat = np.concatenate(x)
    total = np.bincount(flat, minlength=SLOTS)
    hits = np.bincount(flat, np.repeat(y, [len(r) for r in x]), minlength=SLOTS)
    columns = standing_out(total, hits, len(y), y.sum())
    pairs = [
        (np.array(sorted(features(a) - features(b))), np.array(sorted(features(b) - features(a))))
        for t, _ in rows
        for a, b in swaps(t, toxicity.IDENTITY_TERMS)
    ]
    return fit(x, y, columns, pairs, fairness)


def test_swapping_identity_terms_hardly_moves_the_score():
    rows = sentences(1200, 1, identity="muslim")
    plain, fair = numpy_fit(rows, 0.0), numpy_fit(rows, 10.0)
    gap = lambda m: abs(m.score("a muslim neighbour") - m.score("a christian neighbour"))
    assert gap(plain) > 0.1 and gap(fair) < 0.02
    assert fair.score("a muslim neighbour") < 0.1 < plain.score("a muslim neighbour")
    assert fair.score("you loser of a neighbour") >= 0.3


def test_swaps():
    assert swaps("Women came. Nobody else! men, women", (("women", "men"),)) == [("women came", "men came"), ("men women", "women men")]
    assert swaps(None, (("a", "b"),)) == swaps("", (("a", "b"),)) == []
    lines = (("x", "y", "z"), ("a", "b"))
    assert swaps("x a c", lines) == [("x a c", "y b c"), ("x a c", "z a c")]


def test_awkward_rows(spark, docs, no_docs, labelled):
    labels = spark.createDataFrame([(0, 1), (None, 1), (6, None), (7, 0), (7, 0), (999, 1)], "doc_id long, toxic int")
    scored = add_scores(docs.withColumn("label", F.lit(3)), train(docs, labels))
    assert scored.count() == docs.count() and scored.where("toxic_score is null").count() == 0
    assert drop_toxic(docs, labels.where("false")).columns == docs.columns
    model = train(labelled[0], labelled[1])
    assert add_scores(no_docs, model).count() == 0
    empty = {r["doc_id"]: r["toxic_score"] for r in add_scores(docs, model).where("doc_id in (3, 4)").collect()}
    assert empty[3] == empty[4] == model.score("")
