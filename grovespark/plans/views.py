"""The test tables seen as file trees, as DataFrames and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = 1_700_000_000_000_000_000


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def documents(spark: SparkSession, sf_dir: str, content: bool = False) -> DataFrame:
    """One file a document, in folders by source and language."""
    rows = read(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    return rows.select(
        F.format_string("docs/%s/%s/doc_%08d.txt", "source", "lang", "doc_id").alias("rel_path"),
        F.octet_length("text").cast("long").alias("size"),
        (F.lit(BASE) + F.col("doc_id")).alias("mtime"),
        F.lit(420).alias("mode"),
        (1000 + F.col("doc_id") % 97).cast("int").alias("uid"),
        (1000 + F.col("doc_id") % 89).cast("int").alias("gid"),
        "doc_id",
        *([F.col("text").cast("binary").alias("content")] if content else []),
    )


DOCUMENTS_SQL = f"""
doc_files AS (
  SELECT 'docs/' || source || '/' || lang || '/doc_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt' AS rel_path,
         CAST(strlen(text) AS BIGINT) AS size, {BASE} + doc_id AS mtime, 420 AS mode,
         CAST(1000 + doc_id % 97 AS INTEGER) AS uid, CAST(1000 + doc_id % 89 AS INTEGER) AS gid, doc_id, text, source, lang,
         'docs/' || source || '/' || lang AS folder, 'doc_' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt' AS name
  FROM documents
)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file an order, in a folder for each customer."""
    rows = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    return rows.select(
        F.concat(F.lit("cust_"), F.col("o_custkey").cast("string"), F.lit("/order_"), F.col("o_orderkey").cast("string")).alias("rel_path"),
        F.floor("o_totalprice").cast("long").alias("size"),
        (F.lit(BASE) + F.col("o_orderkey")).alias("mtime"),
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customer"),
    )


def renamed(rows: DataFrame, every: int, ending: str, number: str = "id") -> DataFrame:
    """Every so many files have another name, so that each side has some that the other lacks, and both have all rows."""
    other = F.concat("rel_path", F.lit(ending))
    return rows.withColumn("rel_path", F.when(F.col(number) % every == 0, other).otherwise(F.col("rel_path")))


def source_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return renamed(orders(spark, sf_dir), 7, "_a").withColumn("data_hash", F.col("id") % 3)


def target_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = renamed(orders(spark, sf_dir), 11, "_b")
    return rows.withColumns(
        {
            "size": F.col("size") + F.when(F.col("id") % 5 == 0, 1).otherwise(0),
            "mtime": F.col("mtime") + F.when(F.col("id") % 13 == 0, 400).otherwise(0),
            "data_hash": F.when(F.col("id") % 17 == 0, 9).otherwise(F.col("id") % 3).cast("long"),
        }
    )


ORDERS_SQL = f"""
order_files AS (
  SELECT 'cust_' || o_custkey || '/order_' || o_orderkey AS rel_path, CAST(floor(o_totalprice) AS BIGINT) AS size,
         {BASE} + o_orderkey AS mtime, o_orderkey AS id, o_custkey AS customer, 'cust_' || o_custkey AS folder
  FROM orders
), s AS (
  SELECT * REPLACE (rel_path || CASE WHEN id % 7 = 0 THEN '_a' ELSE '' END AS rel_path), id % 3 AS data_hash FROM order_files
), t AS (
  SELECT rel_path || CASE WHEN id % 11 = 0 THEN '_b' ELSE '' END AS rel_path, size + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS size,
         mtime + CASE WHEN id % 13 = 0 THEN 400 ELSE 0 END AS mtime, id, customer, folder,
         CASE WHEN id % 17 = 0 THEN 9 ELSE id % 3 END AS data_hash
  FROM order_files AS target_files
)"""

EQUAL_SQL = {
    "size": "s.size = t.size",
    "time": "s.size = t.size AND s.mtime = t.mtime",
    "time_us": "s.size = t.size AND s.mtime // 1000 = t.mtime // 1000",
    "content": "s.size = t.size AND CASE WHEN s.data_hash <> 0 AND t.data_hash <> 0 THEN s.data_hash = t.data_hash ELSE s.mtime = t.mtime END",
}


def diff_sql(mode: str, join: str = "FULL OUTER") -> str:
    return f"""{ORDERS_SQL}, d AS (
  SELECT coalesce(s.rel_path, t.rel_path) AS rel_path, coalesce(s.folder, t.folder) AS folder,
         CASE WHEN t.rel_path IS NULL THEN 'new' WHEN s.rel_path IS NULL THEN 'target_only'
              WHEN {EQUAL_SQL[mode]} THEN 'skip' ELSE 'changed' END AS kind,
         s.size AS source_size, t.size AS target_size, s.mtime AS source_mtime, t.mtime AS target_mtime
  FROM s {join} JOIN t ON s.rel_path = t.rel_path
), dd AS (
  SELECT *, CAST(CASE WHEN kind IN ('new', 'changed') THEN source_size ELSE 0 END AS BIGINT) AS bytes_planned FROM d
)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as files; paths of order and line come more than once, later ones by supplier and part win."""
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.select(
        F.concat(F.lit("order_"), F.col("l_orderkey").cast("string"), F.lit("/line_"), F.col("l_linenumber").cast("string")).alias("rel_path"),
        F.floor("l_extendedprice").cast("long").alias("size"),
        # Lines that tie on this have one size, so it doesn't matter which wins.
        ((F.col("l_partkey") * 1_000_003 + F.col("l_suppkey")) % 1_000_000_007 * 1_000_000 + F.floor("l_extendedprice")).alias("ordinal"),
    )


PARTS_SQL = """
line_files AS (
  SELECT 'order_' || l_orderkey || '/line_' || l_linenumber AS rel_path, CAST(floor(l_extendedprice) AS BIGINT) AS size,
         (l_partkey * 1000003 + l_suppkey) % 1000000007 * 1000000 + CAST(floor(l_extendedprice) AS BIGINT) AS ordinal
  FROM lineitem
)"""
