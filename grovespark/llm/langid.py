"""Language ID: Bloom filters of n-grams, sliced by bit, that return all languages of an n-gram at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovespark.llm.common import cut_lineage, table, without

#: Letters in an n-gram; a gap between words counts as one, at either end.
N = 4
#: Labelled rows that the filters are made from at most (about: each row's id decides). Languages share them evenly,
#: and those with fewer rows than their share are taken whole.
MAX_ROWS = 20_000
#: An n-gram belongs to a language if it was seen so often there, and its rate is at least this part of the highest rate.
MIN_COUNT, MIN_SHARE = 3, 0.2
#: The most frequent n-grams of a language that its filter holds, about: the size of the table that each task holds.
MAX_GRAMS = 200_000
HASHES = 3
BITS_PER_GRAM = 12
UNKNOWN = "und"
#: Code points that are hashed in one go.
CHARS_AT_ONCE = 1 << 18


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str | None, n: int = N) -> Iterator[np.ndarray]:
    """Hashes of all n-grams of a whole text, in pieces of bounded size."""
    if not text:
        return
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    is_letter = letters()[code]
    code = np.where(is_letter, code, 0).astype(np.uint64)
    keep = is_letter | np.r_[True, is_letter[:-1]]
    code = np.r_[np.zeros(1 if is_letter[0] else 0, np.uint64), code[keep]]
    if code[-1]:
        code = np.r_[code, np.zeros(1, np.uint64)]
    for at in range(0, len(code) - n + 1, CHARS_AT_ONCE):
        piece = code[at : at + CHARS_AT_ONCE + n - 1]
        m = len(piece) - n + 1
        h = np.zeros(m, dtype=np.uint64)
        inside = np.ones(m, dtype=bool)
        for j in range(n):
            part = piece[j : j + m]
            h = (h * np.uint64(0x100000001B3)) ^ (part + np.uint64(1))
            if 0 < j < n - 1:
                inside &= part != 0
        yield spread(h[inside])


def spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Filters:
    """One table of slots; each holds a mask of languages, so a look-up answers for all of them."""

    def __init__(self, languages: list[str], size: int):
        self.languages = languages
        self.words = max(1, -(-len(languages) // 64))
        self.table = np.zeros((size, self.words), dtype=np.uint64)
        self.wrong = np.zeros(len(languages))

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
        return [(low + np.uint64(i) * high) & np.uint64(len(self.table) - 1) for i in range(HASHES)]

    def add(self, language: int, h: np.ndarray) -> None:
        for place in self.places(h):
            self.table[place.astype(np.int64), language // 64] |= np.uint64(1 << (language % 64))

    def finish(self) -> Filters:
        """The rate at which each language is returned for an n-gram that it lacks."""
        for i in range(len(self.languages)):
            fill = np.count_nonzero(self.table[:, i // 64] & np.uint64(1 << (i % 64))) / len(self.table)
            self.wrong[i] = fill**HASHES
        return self

    def counts(self, text: str | None) -> tuple[int, np.ndarray]:
        """(n-grams, for each language how many it has)."""
        n, out = 0, np.zeros(len(self.languages), dtype=np.int64)
        for h in grams(text):
            n += len(h)
            places = [p.astype(np.int64) for p in self.places(h)]
            for w in range(self.words):
                mask = self.table[places[0], w]
                for place in places[1:]:
                    mask &= self.table[place, w]
                for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                    out[i] += np.count_nonzero(mask & np.uint64(1 << (i % 64)))
        return n, out

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with most n-grams after taking off the expected false ones, and its part of all languages'."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        n, hits = self.counts(text)
        likely = np.maximum(0.0, (hits - n * self.wrong) / np.maximum(1e-9, 1 - self.wrong))
        best = int(np.argmax(likely))
        total = likely.sum()
        return self.languages[best], float(likely[best] / total) if total else 0.0


def shares(sizes: dict[str, int], most: int) -> dict[str, float]:
    """The part of each language's rows to learn from: all of those with few, and of the others as many rows each."""
    out = {}
    for i, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        taken = min(n, max(1, most // (len(sizes) - i)))
        out[lang] = taken / n
        most -= taken
    return out


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS
) -> Filters:
    """Learn from rows with a language whose crc32(id) mod 5 is not 0; at most about ``max_rows``, by a hash of the id.

    N-grams are counted in the tasks and summed before and after the shuffle; what
    reaches the driver is at most about ``MAX_GRAMS`` numbers a language. Languages
    are in order of their rows, so ties go to the more frequent one. Rows without
    a text, a language or an id teach nothing; repeated rows count each time.
    """
    own = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (own % 5 != 0)
    )
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    languages = [r["lang"] for r in sorted(sizes, key=lambda r: (-r["n"], r["lang"]))]
    parts = shares({r["lang"]: r["n"] for r in sizes}, max_rows)
    some = rows
    if any(p < 1 for p in parts.values()):
        limits = F.create_map(*[F.lit(x) for lang, p in parts.items() for x in (lang, int(p * (1 << 30)))])
        some = rows.where(F.pmod(F.xxhash64("id", F.lit(6)), F.lit(1 << 30)) < F.element_at(limits, F.col("lang")))
    number = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found.setdefault(number[lang], []).extend(grams(text.as_py()))
            for lang, hashes in found.items():
                h, n = np.unique(np.concatenate(hashes), return_counts=True) if hashes else (np.zeros(0, np.uint64),) * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), lang)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))],
                    names=["lang", "gram", "n"],
                )

    counts = some.select("text", "lang").mapInArrow(count, "lang long, gram long, n long")
    counts = cut_lineage(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return Filters(languages, 64).finish()
    rate = F.col("n") / F.element_at(F.create_map(*[F.lit(x) for k, v in totals.items() for x in (k, v)]), F.col("lang"))
    per_gram = counts.withColumn("rate", rate).groupBy("gram").agg(
        F.collect_list(F.struct("lang", "n", "rate")).alias("in"), F.max("rate").alias("top")
    )
    kept = per_gram.select("gram", "top", F.inline("in")).where(
        (F.col("n") >= MIN_COUNT) & (F.col("rate") >= MIN_SHARE * F.col("top"))
    )
    # For each language the count of its last n-grams that are in, and the part of those with just that count, by a hash.
    last = {lang: (MIN_COUNT, 1.0) for lang in totals}
    seen = dict.fromkeys(totals, 0)
    for lang, n, many in sorted(map(tuple, kept.groupBy("lang", "n").agg(F.count(F.lit(1))).collect()), key=lambda r: -r[1]):
        if seen[lang] < MAX_GRAMS:
            last[lang] = (n, min(1.0, (MAX_GRAMS - seen[lang]) / many))
        seen[lang] += many
    bound, part = (
        F.element_at(F.create_map(*[F.lit(x) for k, v in last.items() for x in (k, f(v))]), F.col("lang"))
        for f in (lambda v: v[0], lambda v: int(v[1] * (1 << 20)))
    )
    own = F.pmod(F.xxhash64("gram", F.lit(7)), F.lit(1 << 20))
    best = kept.where((F.col("n") > bound) | ((F.col("n") == bound) & (own < part))).select("lang", "gram").toArrow()
    owners, found = best.column("lang").to_numpy(), best.column("gram").to_numpy().view(np.uint64)
    arrays = {lang: found[owners == lang] for lang in totals}
    most = max(len(a) for a in arrays.values())
    filters = Filters(languages, 1 << max(6, int(np.ceil(np.log2(max(1, most) * BITS_PER_GRAM)))))
    for lang, some in arrays.items():
        filters.add(lang, some)
    return filters.finish()


def add_languages(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` (a learned language; ``und`` for null and texts without a letter) and ``lang_score`` (0 to 1).

    A text whose n-grams are in no filter gets the most frequent language and
    score 0. Whole texts, however long, are hashed in pieces. Repeated rows get
    the same answer; an empty table gives no rows; other columns pass through, but
    input columns called ``lang_pred`` or ``lang_score`` are replaced.
    """
    docs = without(docs, "lang_pred", "lang_score")
    schema = T.StructType(
        [*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())]
    )
    at, names = docs.columns.index(text_col), [f.name for f in schema.fields]
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.predict(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())],
                names=names,
            )

    return docs.mapInArrow(run, schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = train(docs)
    return add_languages(docs.select("doc_id", "text"), filters).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )
