"""Toxicity: a linear classifier whose score should not move when an identity term is swapped for another."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovespark.llm.common import cut_lineage, set_aside, table, without

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
SLOTS = 1 << 20
#: Lengths of the beginnings of words that are features beside the word, for endings not seen in training.
STEMS = (4, 5, 6)
#: Labelled rows that the classifier is fitted on at most (about: each row's id decides).
MAX_ROWS = 12_000
#: A feature takes part if it is in so many training rows, and so many standard errors from the mean rate.
MIN_ROWS, MIN_Z = 4, 5.0
THRESHOLD = 0.3
#: Words whose weights a task keeps at hand.
MEMO = 500_000

#: Terms that name groups; within a line each can stand for any other.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("immigrant", "native"),
    ("immigrants", "natives"),
    ("disabled", "blind", "deaf"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
    ("muslime", "christen", "juden"),
    ("musulmans", "chrétiens", "juifs"),
    ("musulmanes", "cristianos", "judíos"),
)


def slots_of(word: str) -> list[int]:
    """Slots of a word in lower case: its own, and those of its beginnings."""
    out = [crc32(b"w" + word.encode("utf-8", "surrogatepass")) % SLOTS]
    out += [crc32(b"%d" % n + word[:n].encode("utf-8", "surrogatepass")) % SLOTS for n in STEMS if len(word) >= n]
    return out


def features(text: str | None) -> set[int]:
    return {s for w in set(WORD.findall(text.lower())) for s in slots_of(w)} if text else set()


def swaps(text: str | None, groups: Sequence[Sequence[str]]) -> list[tuple[str, str]]:
    """For each sentence that names a group, the sentence beside itself with each such term changed for another in its line, for all others in turn."""
    place = {a: (line, i) for line in groups for i, a in enumerate(line)}
    out = []
    for sentence in SENTENCE.findall(text.lower()) if text else ():
        words = WORD.findall(sentence)
        most = max((len(place[w][0]) for w in words if w in place), default=0)
        for by in range(1, most):
            changed = [place[w][0][(place[w][1] + by) % len(place[w][0])] if w in place else w for w in words]
            if changed != words:
                out.append((" ".join(words), " ".join(changed)))
    return out


@dataclass
class Model:
    bias: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        return sum(self.weights.get(s, 0.0) for s in slots_of(word))

    def score(self, text: str | None, memo: dict[str, float] | None = None) -> float:
        """0 to 1. Each distinct word counts once."""
        total = self.bias
        memo = {} if memo is None else memo
        for w in set(WORD.findall(text.lower())) if text else ():
            value = memo.get(w)
            if value is None:
                if len(memo) >= MEMO:
                    memo.clear()
                value = memo[w] = self.word(w)
            total += value
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, total)))))


class Rows:
    """Sparse rows of ones (or of given values) over selected features."""

    def __init__(self, rows: list[np.ndarray], signs: list[np.ndarray] | None, columns: np.ndarray):
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        flat = np.concatenate(rows) if len(rows) else np.zeros(0, dtype=np.int64)
        values = np.concatenate(signs) if signs else np.ones(len(flat))
        at = np.searchsorted(columns, flat)
        at[at == len(columns)] = 0
        known = columns[at] == flat if len(columns) else np.zeros(len(flat), bool)
        self.row = np.repeat(np.arange(len(rows)), lengths)[known]
        self.col, self.value, self.shape = at[known], values[known], (len(rows), len(columns))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], minlength=self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * r[self.row], minlength=self.shape[1])


def standing_out(total: np.ndarray, hits: np.ndarray, rows: int, positives: int) -> np.ndarray:
    """Numbers of the features whose rate of label 1 stands out: ``total`` rows have them, ``hits`` of these with label 1."""
    rate = (positives + 0.5) / (rows + 1)
    z = np.abs(hits - total * rate) / np.sqrt(np.maximum(total, 1) * rate * (1 - rate))
    return np.flatnonzero((total >= MIN_ROWS) & (z >= MIN_Z))


def fit(
    rows: list[np.ndarray],
    labels: np.ndarray,
    columns: np.ndarray,
    pairs: Sequence[tuple[np.ndarray, np.ndarray]] = (),
    fairness: float = 10.0,
    ridge: float = 5e-5,
    rounds: int = 800,
) -> Model:
    """Logistic regression by Adam over the features ``columns``, with ``fairness`` times the mean squared
    change of the score's logit over ``pairs``.

    Only features that stand out take part, so that the many words of a long text
    do not add up to noise. No rows or one label alone: the base rate for every text.
    """
    y = labels.astype(np.float64)
    n = len(y)
    rate = (y.sum() + 0.5) / (n + 1)
    base = Model(float(np.log(rate / (1 - rate))))
    if not n or y.min() == y.max() or not len(columns):
        return base
    x = Rows(rows, None, columns)
    d = Rows(
        [np.concatenate([a, b]) for a, b in pairs],
        [np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, b in pairs],
        columns,
    )
    w, bias = np.zeros(len(columns)), base.bias
    m, v = np.zeros(len(columns) + 1), np.zeros(len(columns) + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x.times(w) + bias, -30, 30)))
        g = x.back(p - y) / n + ridge * w
        if d.shape[0]:
            g += 2 * fairness / d.shape[0] * d.back(d.times(w))
        g = np.append(g, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Model(float(bias), {int(c): float(a) for c, a in zip(columns, w, strict=True) if abs(a) > 1e-6})


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(text, label) of at most about ``max_rows`` labelled documents, chosen by a hash of the id.

    The chosen labels are at most that many short rows, so they are broadcast and
    the texts stay where they are.
    """
    own = F.crc32(F.col(id_col).cast("string").cast("binary"))
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (own % 4 != 2))
        .groupBy(F.col(id_col).alias("label_id"))
        .agg(F.max(label_col).alias("label"))
    )
    n = known.count()
    part = int(min(1.0, max_rows / max(1, n)) * (1 << 30))
    known = known.where(F.pmod(F.xxhash64("label_id", F.lit(9)), F.lit(1 << 30)) < part)
    some = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text"))
    return some.join(F.broadcast(known), "label_id").select("text", F.col("label").cast("int"))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = MAX_ROWS,
    groups: Sequence[Sequence[str]] = IDENTITY_TERMS,
    fairness: float = 10.0,
) -> Model:
    """Fit on labelled rows whose crc32(id) mod 4 is not 2.

    Features are made in the tasks and kept in the shared checkpoint folder; their
    rows are counted there, and of each training row only the features that stand
    out come to the driver.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.list_(pa.int32()))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found, before, after = [], [], []
                for value in batch.column(0):
                    text = value.as_py()
                    found.append(np.array(sorted(features(text)), dtype=np.int32))
                    changed = [(features(a), features(b)) for a, b in swaps(text, groups)]
                    before.append([sorted(a - b) for a, b in changed])
                    after.append([sorted(b - a) for a, b in changed])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), pa.array(found, pa.list_(pa.int32())), pa.array(before, lists), pa.array(after, lists)],
                    names=["label", "found", "before", "after"],
                )

    rows = training_rows(docs, labels, id_col, text_col, label_col, max_rows)
    schema = "label int, found array<int>, before array<array<int>>, after array<array<int>>"
    rows = cut_lineage(rows.mapInArrow(extract, schema))
    n, positives = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    counts = rows.select("label", F.explode("found").alias("slot")).groupBy("slot")
    counts = counts.agg(F.count(F.lit(1)).alias("total"), F.sum("label").alias("hits"))
    rate = (positives + 0.5) / (n + 1)
    z = F.abs(F.col("hits") - F.col("total") * rate) / F.sqrt(F.col("total") * (rate * (1 - rate)))
    # At most ``SLOTS`` numbers, whatever the size of the corpus; with a sample of some thousand rows, some thousand.
    best = counts.where((F.col("total") >= MIN_ROWS) & (z >= MIN_Z))
    columns = np.sort(best.select("slot").toArrow().column("slot").to_numpy().astype(np.int64))

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = pa.list_(pa.list_(pa.int32()))
        kept = set(columns.tolist())
        for batch in batches:
            found = [[s for s in some if s in kept] for some in batch.column(1).to_pylist()]
            sides = [[[[s for s in one if s in kept] for one in some] for some in batch.column(i).to_pylist()] for i in (2, 3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int32())), *(pa.array(x, lists) for x in sides)],
                names=["label", "found", "before", "after"],
            )

    got = rows.mapInArrow(narrowed, schema).toArrow().to_pylist()
    # A fixed order, whichever task ended first: sums of floats depend on it.
    got.sort(key=lambda r: (r["found"], r["label"], r["before"], r["after"]))
    x = [np.array(r["found"], dtype=np.int64) for r in got]
    pairs = [
        (np.array(a, dtype=np.int64), np.array(b, dtype=np.int64))
        for r in got
        for a, b in zip(r["before"], r["after"], strict=True)
        if a or b
    ]
    return fit(x, np.array([r["label"] for r in got], dtype=np.int64), columns, pairs, fairness)


ADDED = ("toxic_score", "toxic_predicted")


def add_scores(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``toxic_score`` (0 to 1) and ``toxic_predicted`` (1 from ``threshold`` on).

    Null and empty texts get the base rate's score. Repeated rows get the same
    score, an empty table gives no rows, other columns pass through, but input
    columns with the added columns' names are replaced. Very long texts are scored
    whole. The model is some thousand weights. No shuffle.
    """
    docs = without(docs, *ADDED)
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("toxic_score", T.DoubleType()), T.StructField("toxic_predicted", T.IntegerType())]
    )
    at, names = docs.columns.index(text_col), [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, float] = {}
        for batch in batches:
            scores = [model.score(t.as_py(), memo) for t in batch.column(at)]
            predicted = [int(s >= threshold) for s in scores]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array(predicted, pa.int32())], names=names
            )

    return docs.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; same columns."""
    model = train(docs, labels, **options)
    docs, back = set_aside(docs, *ADDED)
    scored = add_scores(docs, model)
    return scored.where(F.col("toxic_predicted") == 0).drop(*ADDED).withColumnsRenamed(back)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return add_scores(docs, model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"),
        F.col("toxic_score").alias("score"),
        F.col("toxic_predicted").alias("predicted"),
    )
