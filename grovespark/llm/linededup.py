"""Line dedup: drop lines that several documents share, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.llm.common import BLANKS, ascii_lower, cut_lineage, free_names, hash_pair, table, without


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


ADDED = ("dedup_n_lines", "dedup_n_dropped")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    min_docs: int = 2,
) -> DataFrame:
    """Drop lines whose key has ``min_chars`` code points or more and is in ``min_docs`` documents or more.

    The document with the smallest id that holds such a key keeps its lines.
    Returns ``docs`` with ``text_col`` replaced by what is left (lines joined by
    newlines), and ``dedup_n_lines`` and ``dedup_n_dropped``.

    Lines are exploded once, and their hashes kept in the shared checkpoint folder.
    Only hashes are shuffled for the counts; the sums are made before the shuffle,
    so a line in a third of all documents costs one row a task. The join back goes by hash, where adaptive execution splits a hot
    line, and texts are shuffled once. Row identity is (id, hash of the text), so
    ids that occur twice do no harm.

    Null or empty text: one empty line. Rows with one id are one document. Rows
    with a null id count as one document that comes after all others. Very long
    texts and lines are taken whole. An empty table gives an empty result. Other
    columns pass through, but input columns called ``dedup_n_lines`` or
    ``dedup_n_dropped`` are replaced.
    """
    docs = without(docs, *ADDED)
    text = F.coalesce(F.col(text_col), F.lit(""))
    one, two = hash_pair(text)
    ids = docs.select(F.col(id_col).alias("id"), one.alias("t1"), two.alias("t2"), text.alias("t"))
    lines = ids.select("id", "t1", "t2", F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    lines = lines.select("id", "t1", "t2", "pos", line_key(F.col("line")).alias("key")).where(
        F.char_length("key") >= min_chars
    )
    k1, k2 = hash_pair(F.col("key"))
    # Both the counts and the join read these; a row is 48 bytes, and splitting and hashing texts is most of the work.
    lines = cut_lineage(lines.select("id", "t1", "t2", "pos", k1.alias("k1"), k2.alias("k2")))

    # In two documents or more: the smallest and largest id differ, or there is an id and a null.
    if min_docs == 2:
        seen = lines.groupBy("k1", "k2").agg(
            F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.col("id").isNull()).alias("no_id")
        )
        seen = seen.where(F.col("first").isNotNull() & ((F.col("first") != F.col("last")) | F.col("no_id")))
    else:
        each = lines.select("k1", "k2", "id").distinct()
        seen = each.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
        seen = seen.where(F.col("n") >= min_docs)
    seen = seen.select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), "first")

    # The counts are already dealt out by both hashes, and a join would take them as they are; but only a join
    # whose two sides are dealt out for it is split where a key is hot. A third part of the key brings that about.
    third = F.col("k1").bitwiseXOR(F.col("k2")) == F.col("s1").bitwiseXOR(F.col("s2"))
    own_1, own_2, own_lines, id_of, of_1, of_2, gone = free_names(docs, "t1", "t2", "lines", "id", "d1", "d2", "gone")
    dropped = (
        lines.join(seen, (F.col("k1") == F.col("s1")) & (F.col("k2") == F.col("s2")) & third)
        .where(~F.col("id").eqNullSafe(F.col("first")))
        .groupBy(F.col("id").alias(id_of), F.col("t1").alias(of_1), F.col("t2").alias(of_2))
        .agg(F.collect_set("pos").alias(gone))
    )
    # Null-safe: a null id has its own group.
    joined = docs.withColumns({own_1: one, own_2: two}).join(
        dropped,
        (F.col(own_1) == F.col(of_1)) & (F.col(own_2) == F.col(of_2)) & F.col(id_col).eqNullSafe(F.col(id_of)),
        "left",
    )
    joined = joined.withColumn(own_lines, F.split(text, "\n", -1))
    # array_except would also drop repeats, but positions have none.
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(own_lines) - 1), F.col(gone)),
        lambda i: F.get(F.col(own_lines), i),
    )
    left = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(kept, "\n")).alias(text_col)
    return joined.select(
        *[left if c == text_col else F.col(f"`{c}`") for c in docs.columns],
        F.size(own_lines).cast("long").alias("dedup_n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("dedup_n_dropped"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id",
        F.col("dedup_n_lines").alias("n_lines"),
        F.col("dedup_n_dropped").alias("n_dropped"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), s AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), j AS (
  SELECT k.*, coalesce(s.first <> k.doc_id, false) AS gone FROM k LEFT JOIN s ON k.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
