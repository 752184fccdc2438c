"""Queries that write trees and files to the shared folder and return what is read back from there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.operators import chunks as C
from grovespark.operators import diff as D
from grovespark.operators import inventory as I
from grovespark.operators import sync as Y
from grovespark.plans import catalog
from grovespark.plans import views as V
from grovespark.plans.registry import query
from grovespark.shared import cut_lineage, mounted, new_path
from grovespark.sources import filetree as T
from grovespark.sources import scanfiles as S
from grovespark.streaming import incremental

# --- Trees: every document is a file, with the time and mode that its row says ---

FOLDER_MODE = 0o750


def _write(spark: SparkSession, files: DataFrame, name: str) -> str:
    """The root of a tree of these files."""
    root = mounted(new_path(spark, name))
    wrong = cut_lineage(Y.write_files(files, root)).where(~F.col("ok")).first()
    folders = I.folders_of(files).withColumns({"mtime": F.lit(V.BASE), "mode": F.lit(FOLDER_MODE), "uid": F.lit(0), "gid": F.lit(0)})
    wrong = wrong or cut_lineage(Y.make_folders(folders, root, attributes=True)).where(~F.col("ok")).first()
    if wrong:
        raise OSError(f"{wrong['rel_path']}: {wrong['error']}")
    return root


def _documents(spark: SparkSession, d: str) -> str:
    """The documents, and a link to nowhere, which cannot be looked at."""
    files = V.documents(spark, d, True)
    root = _write(spark, files, "tree")
    link = spark.range(1).select(F.lit("docs/broken").alias("rel_path"))

    def run(batches):
        import os

        for batch in batches:
            for name in batch.column(0).to_pylist():
                os.symlink("nowhere", os.path.join(root, name))
            yield batch

    cut_lineage(link.mapInArrow(run, "rel_path string"))
    return root


TREE_SQL = f"""{V.DOCUMENTS_SQL}, folders AS (SELECT DISTINCT unnest(['docs', 'docs/' || source, 'docs/' || source || '/' || lang]) AS rel_path FROM documents),
tree AS (
  SELECT 'file' AS record_type, rel_path, folder AS parent_path, size, mtime, mode, false AS failed FROM doc_files
  UNION ALL SELECT 'folder', rel_path, CASE WHEN rel_path = 'docs' THEN '' ELSE regexp_replace(rel_path, '/[^/]*$', '') END, NULL, NULL, {FOLDER_MODE}, false FROM folders
  UNION ALL SELECT 'file', 'docs/broken', 'docs', NULL, NULL, NULL, true)"""


def _tree_rows(rows: DataFrame) -> DataFrame:
    """A folder's time is left out: the link changed one."""
    mtime = F.when(F.col("record_type") == "file", F.col("mtime")).alias("mtime")
    return rows.select("record_type", "rel_path", "parent_path", "size", mtime, "mode", "failed")


@query(f"WITH {TREE_SQL} SELECT * FROM tree")
def tree_scan(spark, d):
    return _tree_rows(T.file_tree(spark, _documents(spark, d)))


@query(f"WITH {TREE_SQL} SELECT * FROM tree")
def tree_scan_stream(spark, d):
    """The same as a stream, some folders a batch."""
    root, top = _documents(spark, d), new_path(spark, "tree-stream")
    stream = T.file_tree_stream(spark, root, 40)
    run = stream.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return _tree_rows(spark.read.schema(stream.schema).parquet(f"{top}/out"))


@query(f"WITH {TREE_SQL} SELECT * FROM tree")
def tree_scan_by_level(spark, d):
    """The same, a level of folders a job."""
    return _tree_rows(T.file_tree_by_level(spark, _documents(spark, d)))


@query(f"WITH {TREE_SQL} SELECT rel_path, size FROM tree WHERE parent_path = 'docs/src1/en'")
def tree_folder(spark, d):
    """One folder, without those below."""
    return T.file_tree(spark, _documents(spark, d)).where("parent_path = 'docs/src1/en'").select("rel_path", "size")


@query(
    f"""WITH {TREE_SQL}, n AS (SELECT f.rel_path AS folder, count(t.rel_path) AS n FROM folders f LEFT JOIN tree t ON t.parent_path = f.rel_path GROUP BY 1),
    p AS (SELECT folder, n, unnest(range(0, greatest(CAST(ceil(n / 8.0) AS BIGINT), 1))) AS sequence FROM n)
    SELECT folder, sequence, sequence = greatest(CAST(ceil(n / 8.0) AS BIGINT), 1) - 1 AS final, least(8, n - 8 * sequence) AS entries FROM p"""
)
def tree_pages(spark, d):
    rows = cut_lineage(T.file_tree(spark, _documents(spark, d)))
    pages = I.folder_pages(rows.select("parent_path", "ordinal", "rel_path"), rows.where("record_type = 'folder'"), 8)
    return pages.select("folder", "sequence", "final", F.size("files").cast("long").alias("entries"))


@query(f"WITH {V.DOCUMENTS_SQL} SELECT rel_path, size AS length, md5(text) AS digest FROM doc_files")
def tree_contents(spark, d):
    root = _write(spark, V.documents(spark, d, True), "tree")
    return T.file_contents(spark, root).select("rel_path", "length", F.md5("content").alias("digest"))


@query(f"WITH {V.DOCUMENTS_SQL} SELECT rel_path, md5(text) AS digest FROM doc_files")
def tree_packs(spark, d):
    """Many small files read by each task and put into packs."""
    root = _write(spark, V.documents(spark, d, True), "tree")
    return C.unpacked(C.packs(T.file_contents(spark, root))).select("rel_path", F.md5("data").alias("digest"))


@query(f"WITH {TREE_SQL} SELECT rel_path, NOT failed AS opened FROM tree WHERE record_type = 'file'")
def tree_probe(spark, d):
    root = _documents(spark, d)
    return T.open_probe(T.file_tree(spark, root).where("record_type = 'file'"), root).select("rel_path", "opened")


# --- Two trees ---

TREES_SQL = f"""{V.DOCUMENTS_SQL}, s AS (SELECT rel_path || CASE WHEN doc_id % 5 = 0 THEN '_a' ELSE '' END AS rel_path, folder, size, mtime, mode FROM doc_files),
t AS (SELECT rel_path || CASE WHEN doc_id % 6 = 0 THEN '_b' ELSE '' END AS rel_path, folder, size + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS size,
        mtime + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS mtime, mode FROM doc_files)"""
TREES_DIFF_SQL = TREES_SQL + """, d AS (SELECT coalesce(s.rel_path, t.rel_path) AS rel_path, coalesce(s.folder, t.folder) AS folder,
    CASE WHEN t.rel_path IS NULL THEN 'new' WHEN s.rel_path IS NULL THEN 'target_only' WHEN s.size = t.size AND s.mtime = t.mtime THEN 'skip' ELSE 'changed' END AS kind,
    s.size AS source_size, t.size AS target_size FROM s FULL OUTER JOIN t ON s.rel_path = t.rel_path),
dd AS (SELECT *, CAST(CASE WHEN kind IN ('new', 'changed') THEN source_size ELSE 0 END AS BIGINT) AS bytes_planned FROM d)"""


def _two_trees(spark: SparkSession, d: str) -> tuple[str, str]:
    files, doc = V.documents(spark, d, True), F.col("doc_id")
    other = V.renamed(files, 6, "_b", "doc_id").withColumns(
        {
            "content": F.when(doc % 7 == 0, F.concat("content", F.lit(b"x"))).otherwise(F.col("content")),
            "mtime": F.col("mtime") + F.when(doc % 11 == 0, 1).otherwise(0),
        }
    )
    return _write(spark, V.renamed(files, 5, "_a", "doc_id"), "source"), _write(spark, other, "target")


def _files(spark: SparkSession, root: str) -> DataFrame:
    return T.file_tree(spark, root).where("record_type = 'file'")


@query(f"WITH {TREES_DIFF_SQL} SELECT rel_path, kind, source_size, target_size, bytes_planned FROM dd")
def live_tree_diff(spark, d):
    source, target = _two_trees(spark, d)
    return D.diff(_files(spark, source), _files(spark, target), "time").drop("source_mtime", "target_mtime", "compare_mode")


ANSWER = ("source_file_count", "target_file_count", "files_same", "files_changed", "files_new", "files_target_only", "files_failed", "bytes_planned", "status")


@query(
    f"""WITH {TREES_DIFF_SQL} SELECT folder AS rel_path, count(*) FILTER (kind <> 'target_only') AS source_file_count, count(*) FILTER (kind <> 'new') AS target_file_count,
    count(*) FILTER (kind = 'skip') AS files_same, count(*) FILTER (kind = 'changed') AS files_changed, count(*) FILTER (kind = 'new') AS files_new,
    count(*) FILTER (kind = 'target_only') AS files_target_only, CAST(0 AS BIGINT) AS files_failed, CAST(sum(bytes_planned) AS BIGINT) AS bytes_planned,
    CAST(CASE WHEN count(*) FILTER (kind <> 'skip') > 0 THEN 1 ELSE 0 END AS INTEGER) AS status FROM dd GROUP BY folder"""
)
def two_site_folder_report(spark, d):
    """The source's rows go to the target's site as a table; folder rows come back."""
    source, target = _two_trees(spark, d)
    sent, answer = new_path(spark, "sent"), new_path(spark, "answer")
    D.compact(_files(spark, source)).write.parquet(sent)
    D.folder_answer(spark.read.parquet(sent), _files(spark, target), "time").write.parquet(answer)
    return spark.read.parquet(answer).select("rel_path", *ANSWER)


@query(
    f"""WITH {TREES_DIFF_SQL} SELECT count(DISTINCT folder) AS folders_total, count(DISTINCT folder) FILTER (kind <> 'skip') AS folders_differing,
    count(*) FILTER (kind = 'skip') AS files_same, count(*) FILTER (kind = 'changed') AS files_changed, count(*) FILTER (kind = 'new') AS files_new,
    count(*) FILTER (kind = 'target_only') AS files_target_only, CAST(0 AS BIGINT) AS files_failed, CAST(sum(bytes_planned) AS BIGINT) AS bytes_planned FROM dd"""
)
def two_site_summary(spark, d):
    return D.answer_summary(two_site_folder_report(spark, d))


@query(
    f"""WITH {TREES_SQL} SELECT 'file' AS record_type, coalesce(s.rel_path, t.rel_path) AS rel_path, coalesce(s.size, t.size) AS size, coalesce(s.mtime, t.mtime) AS mtime, 420 AS mode
    FROM s FULL OUTER JOIN t ON s.rel_path = t.rel_path
    UNION ALL SELECT DISTINCT 'folder', unnest(['docs', 'docs/' || source, 'docs/' || source || '/' || lang]), NULL, {V.BASE}, {FOLDER_MODE} FROM documents"""
)
def synced_tree(spark, d):
    """What a target holds after a sync: the source's files and folders with their times and modes, and what it had beside them."""
    source, target = _two_trees(spark, d)
    Y.sync(spark, source, target)
    return T.file_tree(spark, target).select("record_type", "rel_path", "size", "mtime", "mode")


@query(
    f"""WITH {TREES_DIFF_SQL} SELECT count(*) FILTER (kind <> 'target_only') AS files_total, count(*) FILTER (kind = 'skip') AS files_skipped, count(*) FILTER (kind = 'changed') AS files_changed,
    count(*) FILTER (kind = 'new') AS files_new, count(*) FILTER (kind = 'target_only') AS files_target_only, CAST(sum(bytes_planned) AS BIGINT) AS bytes_planned,
    count(*) FILTER (kind IN ('new', 'changed')) AS files_transferred, CAST(0 AS BIGINT) AS files_failed, CAST(0 AS BIGINT) AS retries,
    CAST(coalesce(sum(CASE WHEN source_size <= 1024 THEN 1 ELSE ceil(source_size / 4096.0) END) FILTER (kind IN ('new', 'changed')), 0) AS BIGINT) AS chunks,
    CAST(sum(bytes_planned) AS BIGINT) AS bytes_transferred, CAST(0 AS BIGINT) AS folders_failed FROM dd"""
)
def sync_report(spark, d):
    source, target = _two_trees(spark, d)
    totals = Y.sync(spark, source, target, Y.SyncConfig(small_file_threshold=1024, large_chunk_bytes=4096))
    return spark.createDataFrame([tuple(totals.values())], ", ".join(f"{k} long" for k in totals))


@query(f"WITH {TREES_SQL} SELECT s.rel_path, s.size FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.rel_path = s.rel_path AND t.size = s.size AND t.mtime = s.mtime)")
def incremental_tree_batches(spark, d):
    """A tree as a stream, of which what an earlier scan knows is left out, written a batch at a time."""
    source, target = _two_trees(spark, d)
    top = new_path(spark, "batches")
    _files(spark, target).write.parquet(f"{top}/previous")
    stream = T.file_tree_stream(spark, source, 40).where("record_type = 'file'").select("rel_path", "size", "mtime")
    fresh = incremental.changed_since(stream, spark.read.parquet(f"{top}/previous"))
    run = incremental.write_batches(fresh, f"{top}/out", f"{top}/state").start()
    incremental.stop_after(run, 1)
    return spark.read.parquet(f"{top}/out").select("rel_path", "size")


# --- Files of records ---


@query(
    f"WITH {catalog.INVENTORY_SQL} SELECT * FROM inventory UNION ALL SELECT * REPLACE ('run-2' AS scan_run_id) FROM inventory WHERE record_type = 'file'"
)
def inventory_parquet_runs(spark, d):
    """Two runs in one table, the second of files only."""
    rows, path = catalog._inventory(spark, d), f"{new_path(spark, 'inventory')}.parquet"
    S.write_inventory(rows, path, append=True, partitions=4)
    S.write_inventory(rows.withColumn("scan_run_id", F.lit("run-2")), path, folders=False, append=True)
    return S.read_inventory(spark, path)


@query(
    f"""WITH {V.DOCUMENTS_SQL} SELECT rel_path, size, mtime, CAST(mode AS BIGINT) AS mode, CAST(uid AS BIGINT) AS uid, CAST(gid AS BIGINT) AS gid, CAST(0 AS BIGINT) AS data_hash,
    1704067200000000000 AS hash_ts, 'S' AS scan_side FROM doc_files"""
)
def inventory_csv_file(spark, d):
    """An inventory written as CSV and read as a scan: files only, without recorded hashes."""
    path = f"{new_path(spark, 'inventory')}.csv"
    S.write_inventory(catalog._inventory(spark, d), path, partitions=4)
    return S.read_scan_csv(spark, path).drop("folder_hash", "file_hash")


@query(catalog.SQL["inventory_text_lines"])
def inventory_text_file(spark, d):
    path = new_path(spark, "inventory")
    S.write_inventory(catalog._inventory(spark, d), path)
    return spark.read.text(path)


@query(
    f"""WITH {catalog.IDENTITY_SQL} SELECT {catalog.signed_sql('f3')} AS folder_hash, {catalog.signed_sql('f4')} AS file_hash, rel_path, size, mtime, CAST(mode AS BIGINT) AS mode,
    CAST(uid AS BIGINT) AS uid, CAST(gid AS BIGINT) AS gid, -doc_id AS data_hash, mtime AS hash_ts, 'T' AS scan_side FROM identities"""
)
def scan_csv_file(spark, d):
    """Scan rows written and read back; data hashes above 2^63 among them."""
    rows = V.documents(spark, d, content=True).withColumns({"declared_size": F.lit(0), "need_check": F.lit(True)})
    recs = I.records(rows).join(rows.select("rel_path", "doc_id"), "rel_path")
    path = new_path(spark, "scan")
    S.write_scan_csv(I.snapshots(recs, -F.col("doc_id"), "T"), path)
    return S.read_scan_csv(spark, path)


# --- Answers to what was sent ---


@query(
    f"""WITH {V.DOCUMENTS_SQL} SELECT doc_id AS file_id, size, CASE WHEN doc_id % 10 = 0 THEN 'awaiting_ack' WHEN doc_id % 13 = 0 THEN 'failed' ELSE 'done' END AS state,
    CASE WHEN doc_id % 10 <> 0 AND doc_id % 13 = 0 THEN 'no space' END AS error FROM doc_files"""
)
def acknowledged_files(spark, d):
    """Some answers have not come, some came twice, first as a failure that a second try mended."""
    sent = V.documents(spark, d).select(F.col("doc_id").alias("file_id"), "size")
    i = F.col("file_id")
    acks = sent.where(i % 10 != 0).select("file_id", (i % 13 != 0).alias("ok"), F.when(i % 13 == 0, "no space").alias("error"))
    early = sent.where((i % 10 != 0) & (i % 4 == 0)).select("file_id", F.lit(False).alias("ok"), F.lit("no space").alias("error"))
    return C.acknowledged(sent, acks.union(early))


@query(f"WITH {V.DOCUMENTS_SQL} SELECT rel_path, size AS length, md5(text) AS digest FROM doc_files")
def received_files(spark, d):
    """Files sent as a table of chunks, put together and written at the other end."""
    sent, root = new_path(spark, "chunks"), mounted(new_path(spark, "received"))
    files = V.documents(spark, d, True).withColumnRenamed("doc_id", "file_id")
    Y.send_chunks(files, sent, threshold=1024, chunk=4096)
    wrong = cut_lineage(Y.receive_chunks(spark, sent, root)).where(~F.col("ok")).count()
    if wrong:
        raise OSError(f"{wrong} files were not received")
    return T.file_contents(spark, root).select("rel_path", "length", F.md5("content").alias("digest"))
