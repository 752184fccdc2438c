"""Every operator over the test tables: a query, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.functions import controls, hashing, paths, u64
from grovespark.operators import chunks as C
from grovespark.operators import diff as D
from grovespark.operators import inventory as I
from grovespark.plans import sqlhash as H
from grovespark.plans import views as V
from grovespark.plans.registry import QUERIES, SQL, query  # noqa: F401
from grovespark.shared import cut_lineage, new_path
from grovespark.sources import generate as G
from grovespark.sources import scanfiles as S
from grovespark.streaming import incremental, rendezvous

M64 = "18446744073709551616"


def mix_sql(seed: str, value: str) -> str:
    """One mixing step on UBIGINTs given as column names."""
    total = f"({value}::HUGEINT + {u64.GOLDEN}::HUGEINT + ({seed}::HUGEINT * 64) % {M64}::HUGEINT + ({seed}::HUGEINT // 4)) % {M64}::HUGEINT"
    return f"xor({seed}, ({total})::UBIGINT)"


def signed_sql(value: str) -> str:
    return f"CAST(CASE WHEN {value} >= 9223372036854775808 THEN {value}::HUGEINT - {M64}::HUGEINT ELSE {value}::HUGEINT END AS BIGINT)"


# --- Diff ---

DIFF_COLUMNS = "rel_path, kind, source_size, target_size, source_mtime, target_mtime, bytes_planned"


def _diff(spark: SparkSession, d: str, mode: str, **options) -> DataFrame:
    return D.diff(V.source_orders(spark, d), V.target_orders(spark, d), mode, **options)


@query(f"WITH {V.diff_sql('size')} SELECT {DIFF_COLUMNS}, 'size' AS compare_mode FROM dd")
def diff_size(spark, d):
    return _diff(spark, d, "size")


@query(f"WITH {V.diff_sql('time')} SELECT {DIFF_COLUMNS}, 'time' AS compare_mode FROM dd")
def diff_time(spark, d):
    return _diff(spark, d, "time")


@query(f"WITH {V.diff_sql('time_us')} SELECT {DIFF_COLUMNS}, 'time' AS compare_mode FROM dd")
def diff_time_microseconds(spark, d):
    return _diff(spark, d, "time", microseconds=True)


@query(f"WITH {V.diff_sql('content')} SELECT {DIFF_COLUMNS}, 'content' AS compare_mode FROM dd")
def diff_content(spark, d):
    return _diff(spark, d, "content")


@query(
    f"""WITH {V.DOCUMENTS_SQL}, s AS (SELECT * REPLACE (rel_path || CASE WHEN doc_id % 5 = 0 THEN '_a' ELSE '' END AS rel_path) FROM doc_files),
    t AS (SELECT * REPLACE (rel_path || CASE WHEN doc_id % 6 = 0 THEN '_b' ELSE '' END AS rel_path,
                            CASE WHEN doc_id % 7 = 0 THEN uid + 1 ELSE uid END AS uid, CASE WHEN doc_id % 9 = 0 THEN 384 ELSE mode END AS mode)
          FROM doc_files)
    SELECT coalesce(s.rel_path, t.rel_path) AS rel_path,
           CASE WHEN t.rel_path IS NULL THEN 'new' WHEN s.rel_path IS NULL THEN 'target_only'
                WHEN s.size = t.size AND s.mtime = t.mtime AND s.mode = t.mode AND s.uid = t.uid AND s.gid = t.gid THEN 'skip' ELSE 'changed' END AS kind
    FROM s FULL OUTER JOIN t ON s.rel_path = t.rel_path"""
)
def diff_metadata(spark, d):
    rows = V.documents(spark, d)
    target = V.renamed(rows, 6, "_b", "doc_id").withColumns(
        {
            "uid": F.when(F.col("doc_id") % 7 == 0, F.col("uid") + 1).otherwise(F.col("uid")),
            "mode": F.when(F.col("doc_id") % 9 == 0, 384).otherwise(F.col("mode")),
        }
    )
    return D.diff(V.renamed(rows, 5, "_a", "doc_id"), target, "metadata").select("rel_path", "kind")


@query(f"WITH {V.diff_sql('time', 'LEFT')} SELECT {DIFF_COLUMNS}, 'time' AS compare_mode FROM dd")
def diff_incomplete_source(spark, d):
    return _diff(spark, d, "time", source_complete=False)


@query(
    f"""WITH {V.diff_sql('time')} SELECT rel_path AS path, kind, coalesce(source_size, 0) AS source_size, coalesce(source_mtime, 0) AS source_mtime,
    coalesce(target_size, 0) AS target_size, coalesce(target_mtime, 0) AS target_mtime, bytes_planned FROM dd"""
)
def diff_csv_rows(spark, d):
    return D.diff_csv(_diff(spark, d, "time"))


@query(
    f"""WITH {V.diff_sql('size')} SELECT folder AS rel_path, '' AS error,
    {', '.join(f'CAST(0 AS BIGINT) AS {c}' for c in ('source_scan_started_unix_ns', 'source_scan_finished_unix_ns', 'target_scan_started_unix_ns', 'target_scan_finished_unix_ns', 'result_sent_unix_ns', 'result_received_unix_ns', 'source_folder_count', 'target_folder_count', 'files_failed'))},
    count(*) FILTER (kind <> 'target_only') AS source_file_count, count(*) FILTER (kind <> 'new') AS target_file_count,
    count(*) FILTER (kind = 'skip') AS files_same, count(*) FILTER (kind = 'changed') AS files_changed,
    count(*) FILTER (kind = 'new') AS files_new, count(*) FILTER (kind = 'target_only') AS files_target_only,
    CAST(sum(coalesce(source_size, 0)) AS BIGINT) AS source_logical_size_bytes, CAST(sum(coalesce(target_size, 0)) AS BIGINT) AS target_logical_size_bytes,
    CAST(coalesce(sum(source_size) FILTER (kind = 'skip'), 0) AS BIGINT) AS same_logical_size_bytes,
    CAST(coalesce(sum(source_size) FILTER (kind = 'changed'), 0) AS BIGINT) AS changed_logical_size_bytes,
    CAST(coalesce(sum(source_size) FILTER (kind = 'new'), 0) AS BIGINT) AS new_logical_size_bytes,
    CAST(coalesce(sum(target_size) FILTER (kind = 'target_only'), 0) AS BIGINT) AS target_only_logical_size_bytes,
    CAST(sum(bytes_planned) AS BIGINT) AS bytes_planned,
    CAST(CASE WHEN count(*) FILTER (kind <> 'skip') > 0 THEN 1 ELSE 0 END AS INTEGER) AS status
    FROM dd GROUP BY folder"""
)
def diff_folders(spark, d):
    return D.folder_diff(_diff(spark, d, "size"))


SUMMARY_SQL = """SELECT count(*) AS files_total, count(*) FILTER (kind = 'skip') AS files_same, count(*) FILTER (kind = 'changed') AS files_changed,
    count(*) FILTER (kind = 'new') AS files_new, count(*) FILTER (kind = 'target_only') AS files_target_only,
    CAST(0 AS BIGINT) AS files_failed, CAST(sum(bytes_planned) AS BIGINT) AS bytes_planned FROM dd"""


@query(f"WITH {V.diff_sql('time')} {SUMMARY_SQL}")
def diff_summary(spark, d):
    return D.diff_summary(_diff(spark, d, "time"))


@query(f"WITH {V.diff_sql('time')} SELECT rel_path, kind, bytes_planned FROM dd WHERE kind IN ('new', 'changed')")
def dry_run_plan(spark, d):
    from grovespark.operators.sync import plan

    return plan(V.source_orders(spark, d), V.target_orders(spark, d)).select("rel_path", "kind", "bytes_planned")


@query(f"WITH {V.ORDERS_SQL} SELECT s.rel_path, s.size FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE s.rel_path = t.rel_path AND {V.EQUAL_SQL['time']})")
def files_to_transfer(spark, d):
    return D.to_transfer(V.source_orders(spark, d), V.target_orders(spark, d)).select("rel_path", "size")


def _sets(spark, d):
    return V.source_orders(spark, d).select("rel_path"), V.target_orders(spark, d).select("rel_path")


@query(f"WITH {V.ORDERS_SQL} SELECT rel_path FROM s UNION SELECT rel_path FROM t")
def paths_union(spark, d):
    s, t = _sets(spark, d)
    return s.join(t, "rel_path", "full_outer").select("rel_path")


@query(f"WITH {V.ORDERS_SQL} SELECT rel_path FROM s EXCEPT SELECT rel_path FROM t")
def paths_new(spark, d):
    s, t = _sets(spark, d)
    return s.join(t, "rel_path", "left_anti")


@query(f"WITH {V.ORDERS_SQL} SELECT rel_path FROM t EXCEPT SELECT rel_path FROM s")
def paths_target_only(spark, d):
    s, t = _sets(spark, d)
    return t.join(s, "rel_path", "left_anti")


@query(f"WITH {V.ORDERS_SQL} SELECT rel_path FROM s INTERSECT SELECT rel_path FROM t")
def paths_shared(spark, d):
    s, t = _sets(spark, d)
    return s.join(t, "rel_path", "left_semi")


#: What a folder's data hash depends on.
FOLDER_PAIRS = "SELECT folder, list(id || ':' || data_hash ORDER BY id) AS x FROM {} GROUP BY folder"


@query(
    f"""WITH {V.diff_sql('content')}, same AS (SELECT a.folder FROM ({FOLDER_PAIRS.format('s')}) a JOIN ({FOLDER_PAIRS.format('t')}) b
    ON a.folder = b.folder AND a.x = b.x)
    SELECT rel_path, kind, bytes_planned FROM dd WHERE folder NOT IN (SELECT folder FROM same)"""
)
def diff_skipping_unchanged_folders(spark, d):
    s, t = (x.withColumn("folder", paths.parent_path(F.col("rel_path"))) for x in (V.source_orders(spark, d), V.target_orders(spark, d)))
    hashes = (hashing.folder_data_hash(x, "folder", "id") for x in (s, t))
    # Written once: both sides of the diff are thinned out by these, and they are a row a folder.
    same = cut_lineage(D.unchanged_folders(*hashes, "folder", "folder_data_hash"))
    return D.diff_with_skip(s, t, same, "folder", "content").select("rel_path", "kind", "bytes_planned")


# --- Checker ---


def _records(spark, d):
    return V.source_orders(spark, d).select(
        "rel_path", "size", "mtime", F.col("id").alias("file_hash"), "data_hash", (F.col("id") % 4 != 0).alias("need_check"), "id"
    )


def _target_records(spark, d):
    return V.target_orders(spark, d).select("rel_path", "size", "mtime", F.col("id").alias("file_hash"), "data_hash")


CHECK_SQL = f"""WITH {V.ORDERS_SQL}, c AS (
    SELECT s.rel_path, s.id % 4 <> 0 AND coalesce((CASE WHEN s.id % 2 = 0 THEN s.id = t.id AND s.size = t.size AND s.mtime + 1 - 1 = t.mtime AND s.data_hash = t.data_hash ELSE false END)
           OR (s.size = t.size AND s.mtime = t.mtime), false) AS skip
    FROM s LEFT JOIN t ON s.rel_path = t.rel_path)"""


@query(f"{CHECK_SQL} SELECT rel_path, skip FROM c")
def checker_skips(spark, d):
    recs = _records(spark, d)
    earlier = recs.where(F.col("id") % 2 == 0).select("rel_path", "file_hash", "size", "mtime", "data_hash")
    return D.checker(recs, _target_records(spark, d), earlier).select("rel_path", "skip")


@query(f"{CHECK_SQL} SELECT count(*) FILTER (NOT skip) AS discarded, count(*) FILTER (skip) AS skipped FROM c")
def checker_discards(spark, d):
    recs = _records(spark, d)
    earlier = recs.where(F.col("id") % 2 == 0).select("rel_path", "file_hash", "size", "mtime", "data_hash")
    rows = D.checker(recs, _target_records(spark, d), earlier)
    return rows.agg(F.count_if(~F.col("skip")).alias("discarded"), F.count_if("skip").alias("skipped"))


# --- Inventories ---


@query(
    f"""WITH {V.DOCUMENTS_SQL}, f AS (SELECT DISTINCT unnest(['docs', 'docs/' || source, 'docs/' || source || '/' || lang]) AS rel_path FROM documents)
    SELECT f.rel_path, count(d.rel_path) AS flat_file_count, CAST(coalesce(sum(d.size), 0) AS BIGINT) AS flat_logical_size_bytes
    FROM f LEFT JOIN doc_files d ON d.folder = f.rel_path GROUP BY f.rel_path"""
)
def folder_totals(spark, d):
    files = V.documents(spark, d)
    return I.folder_totals(files, I.folders_of(files))


def _inventory(spark, d) -> DataFrame:
    files = V.documents(spark, d)
    folders = I.folder_totals(files, I.folders_of(files)).withColumns(
        {"mtime": F.lit(V.BASE), "mode": F.lit(493), "uid": F.lit(0), "gid": F.lit(0)}
    )
    return I.inventory(files, folders, I.ScanRun("run-1", "2024-01-01T00:00:00Z", 1704067200000000000, "documents"))


INVENTORY_SQL = f"""{V.DOCUMENTS_SQL}, f AS (SELECT DISTINCT unnest(['docs', 'docs/' || source, 'docs/' || source || '/' || lang]) AS rel_path FROM documents),
ft AS (SELECT f.rel_path, count(d.rel_path) AS n, CAST(coalesce(sum(d.size), 0) AS BIGINT) AS b FROM f LEFT JOIN doc_files d ON d.folder = f.rel_path GROUP BY f.rel_path),
inv AS (
  SELECT 'file' AS record_type, rel_path, size, mtime, mode, uid, gid, CAST(NULL AS BIGINT) AS flat_file_count, CAST(NULL AS BIGINT) AS flat_logical_size_bytes,
         '' AS hash_algorithm, '' AS content_hash, CAST(0 AS BIGINT) AS hash_block_size, CAST(0 AS BIGINT) AS hash_block_count, '' AS block_hash_algorithm, '' AS block_hashes
  FROM doc_files
  UNION ALL SELECT 'folder', rel_path, NULL, {V.BASE}, 493, 0, 0, n, b, NULL, NULL, NULL, NULL, NULL, NULL FROM ft
), inventory AS (SELECT *, 'run-1' AS scan_run_id, '2024-01-01T00:00:00Z' AS run_started_at_utc, 1704067200000000000 AS run_started_unix_ns,
  'documents' AS source_root, '{{}}' AS run_settings FROM inv)"""


@query(f"WITH {INVENTORY_SQL} SELECT * FROM inventory")
def inventory(spark, d):
    return _inventory(spark, d)


@query(f"WITH {INVENTORY_SQL} SELECT rel_path, flat_file_count FROM inventory WHERE record_type = 'folder'")
def inventory_folders_only(spark, d):
    return I.selected(_inventory(spark, d), files=False).select("rel_path", "flat_file_count")


@query(
    f"""WITH {INVENTORY_SQL}, q AS (SELECT *, '"' || replace(replace(rel_path, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' AS p FROM inventory)
    SELECT CASE WHEN record_type = 'file' THEN 'file rel_path=' || p || ' size=' || size || ' mtime=' || mtime || ' mode=' || mode || ' uid=' || uid || ' gid=' || gid
      ELSE 'folder rel_path=' || p || ' mtime=' || mtime || ' mode=' || mode || ' uid=' || uid || ' gid=' || gid || ' flat_file_count=' || flat_file_count
           || ' flat_logical_size_bytes=' || flat_logical_size_bytes END
      || ' scan_run_id="run-1" run_started_at_utc="2024-01-01T00:00:00Z" run_started_unix_ns=1704067200000000000 source_root="documents" run_settings="{{}}"' AS value
    FROM q"""
)
def inventory_text_lines(spark, d):
    return S.text_lines(_inventory(spark, d))


@query(
    f"""WITH {INVENTORY_SQL} SELECT CASE WHEN record_type = 'file'
      THEN 'file,' || rel_path || ',' || size || ',' || mtime || ',' || mode || ',' || uid || ',' || gid || ',,,"","",0,0,"",""'
      ELSE 'folder,' || rel_path || ',,' || mtime || ',' || mode || ',' || uid || ',' || gid || ',' || flat_file_count || ',' || flat_logical_size_bytes || ',,,,,,' END
      || ',run-1,2024-01-01T00:00:00Z,1704067200000000000,documents,{{}}' AS value FROM inventory"""
)
def inventory_csv_lines(spark, d):
    return S.csv_lines(_inventory(spark, d))


@query(
    f"""WITH {INVENTORY_SQL} SELECT count(*) AS accepted, count(*) FILTER (record_type = 'file') AS files_found, count(*) AS folders_found,
    CAST(sum(size) AS BIGINT) AS logical_size_bytes FROM inventory"""
)
def scan_statistics(spark, d):
    return I.scan_statistics(_inventory(spark, d))


@query(
    f"""WITH {INVENTORY_SQL} SELECT count(*) AS accepted, count(*) FILTER (record_type = 'file') AS files_found,
    count(DISTINCT CASE WHEN record_type = 'folder' THEN rel_path ELSE regexp_replace(rel_path, '/[^/]*$', '') END) AS folders_found,
    CAST(sum(size) AS BIGINT) AS logical_size_bytes FROM inventory"""
)
def scan_statistics_unique_folders(spark, d):
    return I.scan_statistics(_inventory(spark, d), unique_folders=True)


@query(f"WITH {V.DOCUMENTS_SQL} SELECT rel_path, size FROM doc_files WHERE rel_path LIKE 'docs/src1/%'")
def subtree(spark, d):
    return I.subtree(V.documents(spark, d).select("rel_path", "size"), "docs/src1")


@query(f"WITH {V.DOCUMENTS_SQL} SELECT rel_path, size FROM doc_files WHERE folder = 'docs/src1/en'")
def direct_children(spark, d):
    return I.subtree(V.documents(spark, d).select("rel_path", "size"), "docs/src1/en", recursive=False)


@query(f"WITH {V.DOCUMENTS_SQL} SELECT rel_path, size, mtime FROM doc_files WHERE name = 'doc_00000007.txt'")
def stat_path(spark, d):
    return V.documents(spark, d).select("rel_path", "size", "mtime").where(paths.base_name(F.col("rel_path")) == "doc_00000007.txt")


@query(f"WITH {V.DOCUMENTS_SQL} SELECT rel_path, size FROM doc_files WHERE size <= 2000")
def size_cap(spark, d):
    return I.size_capped(V.documents(spark, d).select("rel_path", "size"), 2000)


@query(
    f"""WITH {V.DOCUMENTS_SQL} SELECT CASE WHEN size <= 4096 THEN 'small' ELSE 'large' END AS bucket, count(*) AS files, CAST(sum(size) AS BIGINT) AS logical_size_bytes
    FROM doc_files GROUP BY 1"""
)
def small_large_totals(spark, d):
    return I.size_class_totals(V.documents(spark, d), 4096)


READ_SQL = f"""WITH {V.DOCUMENTS_SQL}, c AS (SELECT *, size <= 4096 AS small, CASE WHEN doc_id % 19 = 0 THEN NULL WHEN doc_id % 23 = 0 THEN size - 1 ELSE size END AS n FROM doc_files),
    g AS (SELECT *, coalesce(n >= size, false) AS good FROM c)
    SELECT count(*) AS files_found, count(*) FILTER (good) AS files_read, count(*) FILTER (NOT good) AS files_failed, CAST(sum(size) AS BIGINT) AS logical_size_bytes,
      CAST(coalesce(sum(n) FILTER (good), 0) AS BIGINT) AS bytes_read, count(*) FILTER (small) AS small_files_found, count(*) FILTER (NOT small) AS large_files_found,
      count(*) FILTER (small AND good) AS small_files_read, count(*) FILTER (NOT small AND good) AS large_files_read,
      CAST(coalesce(sum(n) FILTER (small AND good), 0) AS BIGINT) AS small_bytes_read, CAST(coalesce(sum(n) FILTER (NOT small AND good), 0) AS BIGINT) AS large_bytes_read FROM g"""


@query(READ_SQL)
def read_totals(spark, d):
    files = V.documents(spark, d)
    got = files.where(F.col("doc_id") % 19 != 0).select("rel_path", (F.col("size") - F.when(F.col("doc_id") % 23 == 0, 1).otherwise(0)).alias("length"))
    return I.read_totals(files, got, 4096)


@query(f"WITH {V.DOCUMENTS_SQL} SELECT folder AS folder_path, name AS base_name, size FROM doc_files")
def child_rows(spark, d):
    return I.children(V.documents(spark, d).select("rel_path", "size"))


@query(f"WITH {V.DOCUMENTS_SQL} SELECT size, rel_path FROM doc_files")
def rebuilt_paths(spark, d):
    return I.rebuilt(I.children(V.documents(spark, d).select("rel_path", "size")))


@query(
    """SELECT page_id, p AS normalized, CASE WHEN instr(p, '/') > 0 THEN regexp_replace(p, '/[^/]*$', '') ELSE '' END AS parent,
    regexp_replace(p, '^.*/', '') AS name FROM (SELECT page_id, regexp_replace(regexp_replace(url, '/+', '/', 'g'), '^/|/$', '', 'g') AS p FROM pages)"""
)
def normalized_paths(spark, d):
    rows = V.read(spark, d, "pages", "page_id", "url").withColumn("normalized", paths.normalize_path(F.col("url")))
    p = F.col("normalized")
    return rows.select("page_id", "normalized", paths.parent_path(p).alias("parent"), paths.base_name(p).alias("name"))


@query(f"WITH {V.PARTS_SQL} SELECT rel_path, max(ordinal) AS ordinal, arg_max(size, ordinal) AS size FROM line_files GROUP BY rel_path")
def last_write_wins(spark, d):
    return I.last_wins(V.parts(spark, d), "ordinal")


@query(f"WITH {V.ORDERS_SQL} SELECT rel_path, size FROM s ORDER BY rel_path")
def sorted_paths(spark, d):
    return V.source_orders(spark, d).select("rel_path", "size").orderBy("rel_path")


# Identities are folds over the hashes of a path's parts: docs, source, language and name.
IDENTITY_SQL = f"""{V.DOCUMENTS_SQL}, parts AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM (SELECT unnest(string_split(rel_path, '/')) AS w FROM doc_files)),
{H.xxh64('ph', 'parts', 'w', 'x')},
i0 AS (SELECT f.*, a.h AS h1, b.h AS h2, c.h AS h3, e.h AS h4, 0::UBIGINT AS none FROM doc_files f JOIN ph a ON a.w = 'docs' JOIN ph b ON b.w = source JOIN ph c ON c.w = lang JOIN ph e ON e.w = name),
i1 AS (SELECT *, {mix_sql('h1', 'none')} AS f1 FROM i0), i2 AS (SELECT *, {mix_sql('h2', 'f1')} AS f2 FROM i1),
i3 AS (SELECT *, {mix_sql('h3', 'f2')} AS f3 FROM i2), identities AS (SELECT *, {mix_sql('h4', 'f3')} AS f4 FROM i3)"""


@query(
    f"""WITH {IDENTITY_SQL} SELECT name, rel_path, {signed_sql('f3')} AS parent_hash, {signed_sql('f3')} AS folder_hash, {signed_sql('f4')} AS own_hash,
    CASE WHEN doc_id % 3 = 0 THEN 7 ELSE size END AS size, mtime, mode, uid, gid, doc_id % 2 = 0 AS need_check, true AS need_data FROM identities"""
)
def working_records(spark, d):
    doc = F.col("doc_id")
    rows = V.documents(spark, d, content=True).withColumns({"declared_size": F.when(doc % 3 == 0, 7).otherwise(0), "need_check": doc % 2 == 0})
    return I.records(rows)


CONTENT_SQL = f"contents AS (SELECT rel_path, hex(encode(text)) AS x FROM doc_files), {H.xxh64('ch', 'contents', 'rel_path', 'x')}"


@query(
    f"""WITH {IDENTITY_SQL}, {CONTENT_SQL} SELECT CAST(f3 AS DECIMAL(20,0)) AS folder_hash, CAST(f4 AS DECIMAL(20,0)) AS file_hash, rel_path, CAST(size AS DECIMAL(20,0)) AS size,
    CAST(mtime AS DECIMAL(20,0)) AS mtime, mode, uid, gid, CAST(h AS DECIMAL(20,0)) AS data_hash, CAST(mtime AS DECIMAL(20,0)) AS hash_ts, 'S' AS scan_side FROM identities JOIN ch USING (rel_path)"""
)
def scan_rows(spark, d):
    rows = V.documents(spark, d, content=True).withColumns(
        {"declared_size": F.lit(0), "need_check": F.lit(True), "data": hashing.xxh64(F.col("content"))}
    )
    hashes = rows.select("rel_path", "data")
    recs = I.records(rows.drop("data")).join(hashes, "rel_path")
    return S.scan_csv(I.snapshots(recs, F.col("data")))


@query(
    """SELECT user_id, s AS second, n, sum(n) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 59 PRECEDING AND CURRENT ROW) / 60.0::DOUBLE AS rate
    FROM (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, count(*) AS n FROM events GROUP BY 1, 2)"""
)
def rolling_rates(spark, d):
    rows = V.read(spark, d, "events", "user_id", "ts")
    second = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))
    rows = rows.select("user_id", second.alias("second"))
    return I.rolling_rate(rows, "user_id", "second")


LATENCY_SQL = """WITH e AS (SELECT CAST(floor(abs(value) * 1000000) AS BIGINT) AS ns, 1000 AS requested,
      CAST(CASE WHEN event_id % 17 = 0 THEN -1 WHEN event_id % 13 = 0 THEN 0 WHEN event_id % 5 = 0 THEN 700 ELSE 1000 END AS BIGINT) AS done FROM events)
    SELECT count(*) AS completed, count(*) FILTER (done < 0) AS failed, count(*) FILTER (done = 0) AS zero_reads,
      count(*) FILTER (done > 0 AND done < requested) AS short_reads, CAST(sum(requested) AS BIGINT) AS bytes_requested,
      CAST(sum(greatest(done, 0)) AS BIGINT) AS bytes_completed, CAST(sum(ns) AS BIGINT) AS latency_ns, max(ns) AS max_latency_ns, """ + ", ".join(
    f"count(*) FILTER (ns >= {lo}{'' if hi is None else f' AND ns < {hi}'}) AS bucket_{i}"
    for i, (lo, hi) in enumerate(zip((0, *I.LATENCY_BOUNDS), (*I.LATENCY_BOUNDS, None), strict=True))
) + " FROM e"


@query(LATENCY_SQL)
def latency_summary(spark, d):
    rows = V.read(spark, d, "events", "event_id", "value")
    i = F.col("event_id")
    done = F.when(i % 17 == 0, -1).when(i % 13 == 0, 0).when(i % 5 == 0, 700).otherwise(1000).cast("long")
    rows = rows.select(F.floor(F.abs("value") * 1000000).cast("long").alias("ns"), F.lit(1000).alias("requested"), done.alias("done"))
    return I.latency_summary(rows, F.col("ns"), F.col("requested"), F.col("done"))


# --- Hashes ---


@query(f"WITH {V.DOCUMENTS_SQL} SELECT rel_path, md5(text) AS content_hash FROM doc_files")
def content_md5(spark, d):
    return V.documents(spark, d, True).select("rel_path", hashing.content_hash(F.col("content"), "md5").alias("content_hash"))


@query(f"WITH {V.DOCUMENTS_SQL} SELECT rel_path, sha256(text) AS content_hash FROM doc_files")
def content_sha256(spark, d):
    return V.documents(spark, d, True).select("rel_path", hashing.content_hash(F.col("content"), "sha256").alias("content_hash"))


@query(
    f"""WITH {V.DOCUMENTS_SQL}, {CONTENT_SQL} SELECT rel_path, lower(lpad(to_hex(h), 16, '0')) AS xxh64, CAST(xor(h, h >> 32) & 4294967295 AS BIGINT) AS hash32 FROM ch"""
)
def content_xxh64(spark, d):
    c = F.col("content")
    return V.documents(spark, d, True).select("rel_path", hashing.content_hash(c, "xxh64").alias("xxh64"), hashing.chunk_hash32(c).alias("hash32"))


@query()
def content_xxh3(spark, d):
    c = F.col("content")
    return V.documents(spark, d, True).select("rel_path", *[hashing.content_hash(c, a).alias(a) for a in ("xxh3_64", "xxh3_128")])


def _blocks_sql(algorithm: str, size: int) -> str:
    n = f"CAST(ceil(size / {size}.0) AS BIGINT)"
    return f"""WITH {V.DOCUMENTS_SQL}, h AS (SELECT rel_path, size, hex(encode(text)) AS x FROM doc_files)
    SELECT rel_path, {n} AS hash_block_count,
           coalesce(array_to_string(list_transform(range(0, {n}), lambda i: {algorithm}(unhex(substr(x, CAST(i * {2 * size} + 1 AS BIGINT), {2 * size})))), ';'), '') AS block_hashes
    FROM h"""


def _blocks(spark, d, algorithm: str, size: int) -> DataFrame:
    return V.documents(spark, d, True).select(
        "rel_path", hashing.block_count(F.col("size"), size).alias("hash_block_count"), hashing.block_hashes(F.col("content"), size, algorithm).alias("block_hashes")
    )


@query(_blocks_sql("md5", 256))
def block_md5(spark, d):
    return _blocks(spark, d, "md5", 256)


@query(_blocks_sql("sha256", 1000))
def block_sha256(spark, d):
    return _blocks(spark, d, "sha256", 1000)


@query(
    f"""WITH a AS (SELECT o_orderkey, (o_orderkey::HUGEINT * 1000003)::UBIGINT AS x, (9223372036854775808::HUGEINT + o_custkey)::UBIGINT AS y FROM orders),
    b AS (SELECT o_orderkey, {mix_sql('x', 'y')} AS m FROM a), c AS (SELECT o_orderkey, m, {mix_sql('m', 'm')} AS mm FROM b)
    SELECT o_orderkey, {signed_sql('m')} AS once, {signed_sql('mm')} AS twice, CAST(mm % 12 AS BIGINT) AS connection FROM c"""
)
def mixed_hashes(spark, d):
    rows = V.read(spark, d, "orders", "o_orderkey", "o_custkey")
    x, y = F.col("o_orderkey") * 1000003, u64.add64(u64.lit64(1 << 63), F.col("o_custkey"))
    rows = rows.withColumn("once", u64.mix64(x, y)).withColumn("twice", u64.mix64(F.col("once"), F.col("once")))
    return rows.select("o_orderkey", "once", "twice", controls.dispatch_connection(F.col("twice"), 12).alias("connection"))


@query(
    f"""WITH a AS (SELECT o_custkey, (o_orderkey::HUGEINT * 1000003)::UBIGINT AS x, (9223372036854775808::HUGEINT + o_custkey)::UBIGINT AS y FROM orders),
    b AS (SELECT o_custkey, {mix_sql('x', 'y')} AS m FROM a),
    g AS (SELECT o_custkey, bit_xor(m) AS xo, (sum(m::HUGEINT) % {M64}::HUGEINT)::UBIGINT AS su FROM b GROUP BY o_custkey)
    SELECT o_custkey, {signed_sql('xo')} AS digest, {signed_sql('su')} AS total FROM g"""
)
def order_free_digests(spark, d):
    rows = V.read(spark, d, "orders", "o_orderkey", "o_custkey")
    rows = rows.withColumn("m", u64.mix64(F.col("o_orderkey") * 1000003, u64.add64(u64.lit64(1 << 63), F.col("o_custkey"))))
    return rows.groupBy("o_custkey").agg(C.order_free_digest(F.col("m")).alias("digest"), u64.sum64(F.col("m")).alias("total"))


@query(
    f"""WITH RECURSIVE v AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderkey::UBIGINT AS f, (o_orderkey % 1000)::UBIGINT AS dh FROM orders),
    r AS (SELECT CAST(o_custkey AS BIGINT) AS k, CAST(0 AS BIGINT) AS i, {hashing.DATA_SEED}::UBIGINT AS h FROM (SELECT DISTINCT o_custkey FROM orders)
      UNION ALL SELECT k, i + 1, {mix_sql('h1', 'dh')} FROM (SELECT r.k, r.i, v.dh, {mix_sql('r.h', 'v.f')} AS h1 FROM r JOIN v ON v.o_custkey = r.k AND v.i = r.i + 1))
    SELECT k AS o_custkey, {signed_sql('h')} AS folder_data_hash FROM (SELECT k, arg_max(h, i) AS h FROM r GROUP BY k)"""
)
def folder_data_hashes(spark, d):
    rows = V.read(spark, d, "orders", "o_orderkey", "o_custkey")
    rows = rows.select("o_custkey", F.col("o_orderkey").alias("file_hash"), (F.col("o_orderkey") % 1000).alias("data_hash"))
    return hashing.folder_data_hash(rows, "o_custkey")


def _metadata_sql(mode: str) -> str:
    """A child's hash takes more of it with each compare mode."""
    fields = ["size", *(["mtime"] if mode != "size" else []), *(["mode", "uid", "gid"] if mode == "metadata" else [])]
    steps = [f"c0 AS (SELECT *, {mix_sql('x', '1::UBIGINT')} AS m0 FROM a)"]
    steps += [f"c{i} AS (SELECT *, {mix_sql(f'm{i - 1}', f)} AS m{i} FROM c{i - 1})" for i, f in enumerate(fields, 1)]
    return f"""WITH a AS (SELECT o_custkey, o_orderkey::UBIGINT AS x, floor(o_totalprice)::BIGINT AS size, {V.BASE} + o_orderkey AS mtime, 420 AS mode,
      1000 + o_orderkey % 97 AS uid, 1000 + o_orderkey % 89 AS gid FROM orders),
    {', '.join(steps)}, c AS (SELECT *, m{len(fields)} AS m FROM c{len(fields)}),
    p AS (SELECT *, ((m & 4294967295::UBIGINT)::HUGEINT * {hashing.METADATA_PRIME}::HUGEINT + (((m >> 32)::HUGEINT * {hashing.METADATA_PRIME}::HUGEINT) % 4294967296) * 4294967296) % {M64}::HUGEINT AS w FROM c),
    g AS (SELECT o_custkey, count(*)::UBIGINT AS n, 0::UBIGINT AS z, sum(size)::UBIGINT AS nb, bit_xor(m) AS xo, (sum(w) % {M64}::HUGEINT)::UBIGINT AS su, {hashing.METADATA_SEED}::UBIGINT AS h0 FROM p GROUP BY o_custkey),
    h1 AS (SELECT *, {mix_sql('h0', 'n')} AS h1 FROM g), h2 AS (SELECT *, {mix_sql('h1', 'z')} AS h2 FROM h1), h3 AS (SELECT *, {mix_sql('h2', 'nb')} AS h3 FROM h2),
    h4 AS (SELECT *, {mix_sql('h3', 'xo')} AS h4 FROM h3), h5 AS (SELECT *, {mix_sql('h4', 'su')} AS h5 FROM h4)
    SELECT o_custkey, {signed_sql('h5')} AS metadata_hash FROM h5"""


def _metadata_hashes(spark, d, mode: str) -> DataFrame:
    rows = V.read(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    key = F.col("o_orderkey")
    rows = rows.withColumns({"size": F.floor("o_totalprice").cast("long"), "is_file": F.lit(True)})
    child = hashing.child_hash(key, F.col("is_file"), F.col("size"), F.lit(V.BASE) + key, F.lit(420), 1000 + key % 97, 1000 + key % 89, mode)
    return hashing.folder_metadata_hash(rows.withColumn("child_hash", child), "o_custkey")


@query(_metadata_sql("size"))
def folder_metadata_hashes(spark, d):
    return _metadata_hashes(spark, d, "size")


@query(_metadata_sql("time"))
def folder_metadata_hashes_time(spark, d):
    return _metadata_hashes(spark, d, "time")


@query(_metadata_sql("metadata"))
def folder_metadata_hashes_all(spark, d):
    return _metadata_hashes(spark, d, "metadata")


@query(f"WITH {IDENTITY_SQL} SELECT rel_path, {signed_sql('f3')} AS folder_hash, {signed_sql('f4')} AS file_hash FROM identities")
def path_identities(spark, d):
    return hashing.with_identity(V.documents(spark, d)).select("rel_path", "folder_hash", "file_hash")


# --- Payloads ---


@query(
    f"""WITH {V.DOCUMENTS_SQL}, n AS (SELECT doc_id AS file_id, size AS file_size, CASE WHEN size <= 1024 THEN 1024 ELSE 4096 END AS step, size <= 1024 AS is_small, hex(encode(text)) AS x FROM doc_files),
    c AS (SELECT *, greatest(CAST(ceil(file_size / step::DOUBLE) AS BIGINT), 1) AS k FROM n), e AS (SELECT *, unnest(range(0, k)) AS chunk_index FROM c)
    SELECT file_id, file_size, chunk_index, chunk_index * step AS data_offset, least(step, file_size - chunk_index * step) AS data_len, is_small,
           chunk_index = k - 1 AS is_last, md5(unhex(substr(x, CAST(chunk_index * step * 2 + 1 AS BIGINT), step * 2))) AS digest FROM e"""
)
def chunk_rows(spark, d):
    files = V.documents(spark, d, True).withColumnRenamed("doc_id", "file_id")
    return C.chunks(files, threshold=1024, chunk=4096).withColumn("digest", F.md5("data")).drop("data")


@query(f"WITH {V.DOCUMENTS_SQL} SELECT doc_id AS file_id, sha256(text) AS digest FROM doc_files")
def reassembled_files(spark, d):
    files = V.documents(spark, d, True).withColumnRenamed("doc_id", "file_id")
    return C.reassembled(C.chunks(files, threshold=1024, chunk=4096)).select("file_id", F.sha2("content", 256).alias("digest"))


@query(
    f"""WITH {V.DOCUMENTS_SQL}, n AS (SELECT doc_id AS file_id, size, greatest(CAST(ceil(size / (CASE WHEN size <= 1024 THEN 1024 ELSE 4096 END)::DOUBLE) AS BIGINT), 1) AS k,
      CASE WHEN size <= 1024 THEN 1024 ELSE 4096 END AS step FROM doc_files)
    SELECT file_id, CASE WHEN file_id % 10 = 0 AND k > 1 THEN k - 1 ELSE k END AS chunks,
           CASE WHEN file_id % 10 = 0 AND k > 1 THEN size - step ELSE size END AS bytes, NOT (file_id % 10 = 0 AND k > 1) AS complete FROM n"""
)
def file_completion(spark, d):
    files = V.documents(spark, d, True).withColumnRenamed("doc_id", "file_id")
    rows = C.chunks(files, threshold=1024, chunk=4096)
    # The first of several chunks of every tenth file has not come.
    rows = rows.where(~((F.col("file_id") % 10 == 0) & (F.col("chunk_index") == 0) & ~F.col("is_last")))
    return C.completion(rows)


@query(f"WITH {V.DOCUMENTS_SQL} SELECT rel_path, CASE WHEN size <= 65536 THEN 'pack' ELSE 'chunks' END AS sent_as, md5(text) AS digest FROM doc_files")
def packed_small_files(spark, d):
    """Small files go in packs, large ones in chunks."""
    files = V.documents(spark, d, True)
    small = C.unpacked(C.packs(files.where(F.col("size") <= 65536))).select("rel_path", F.lit("pack").alias("sent_as"), F.md5("data").alias("digest"))
    large = C.reassembled(C.chunks(files.where(F.col("size") > 65536), "rel_path", threshold=1024, chunk=4096), "rel_path")
    return small.union(large.select("rel_path", F.lit("chunks"), F.md5("content")))


@query(
    f"""WITH {V.DOCUMENTS_SQL}, n AS (SELECT doc_id, size, CASE WHEN size <= 1024 THEN 1024 ELSE 4096 END AS step FROM doc_files WHERE doc_id % 3 <> 0),
    k AS (SELECT *, greatest(CAST(ceil(size / step::DOUBLE) AS BIGINT), 1) - 1 AS last FROM n)
    SELECT doc_id AS file_id, size AS file_size, last AS chunk_index, last * step AS data_offset, size - last * step AS data_len, size <= 1024 AS is_small, CAST(0 AS BIGINT) AS hash_ts FROM k"""
)
def last_chunk_scan_rows(spark, d):
    """Of every third file the last chunk's hash is not valid."""
    files = V.documents(spark, d, True).withColumnRenamed("doc_id", "file_id")
    rows = C.chunks(files, threshold=1024, chunk=4096).withColumn("hash_valid", F.col("file_id") % 3 != 0)
    return C.last_chunk_rows(rows).select("file_id", "file_size", "chunk_index", "data_offset", "data_len", "is_small", "hash_ts")


# --- Generated inventories ---

SPLIT_SQL = f"""z0 AS (SELECT i, (xor(i::UBIGINT, 123::UBIGINT)::HUGEINT + {u64.GOLDEN}::HUGEINT) % {M64}::HUGEINT AS z FROM ids),
z1 AS (SELECT i, xor(z::UBIGINT, (z // 1073741824)::UBIGINT) AS a FROM z0),
z2 AS (SELECT i, (((a & 4294967295::UBIGINT)::HUGEINT * 13787848793156543929::HUGEINT + (((a >> 32)::HUGEINT * 13787848793156543929::HUGEINT) % 4294967296) * 4294967296) % {M64}::HUGEINT) AS z FROM z1),
z3 AS (SELECT i, xor(z::UBIGINT, (z // 134217728)::UBIGINT) AS a FROM z2),
z4 AS (SELECT i, (((a & 4294967295::UBIGINT)::HUGEINT * 10723151780598845931::HUGEINT + (((a >> 32)::HUGEINT * 10723151780598845931::HUGEINT) % 4294967296) * 4294967296) % {M64}::HUGEINT) AS z FROM z3),
z5 AS (SELECT i, xor(z::UBIGINT, (z // 2147483648)::UBIGINT) AS r FROM z4)"""


@query(
    f"""WITH ids AS (SELECT unnest(range(0, 10000)) AS i), {SPLIT_SQL}
    SELECT 'synthetic/dir_' || lpad(CAST(i % 37 AS VARCHAR), 8, '0') || '/file_' || lpad(CAST(i AS VARCHAR), 12, '0') || '.dat' AS rel_path,
      greatest(CAST(r % 2048 AS BIGINT), 1) AS size, {G.FIRST_MTIME} + i AS mtime, 420 AS mode, CAST(1000 + i % 97 AS INTEGER) AS uid, CAST(1000 + i % 89 AS INTEGER) AS gid FROM z5"""
)
def generated_files(spark, d):
    return G.generated_files(spark, 10_000, 37)


@query(
    f"""WITH ids AS (SELECT unnest(range(0, 37)) AS i) SELECT 'synthetic/dir_' || lpad(CAST(i AS VARCHAR), 8, '0') AS rel_path, {G.FIRST_MTIME} + i AS mtime, 493 AS mode,
    CAST(1000 + i % 97 AS INTEGER) AS uid, CAST(1000 + i % 89 AS INTEGER) AS gid, CAST(10000 // 37 + CASE WHEN i < 10000 % 37 THEN 1 ELSE 0 END AS BIGINT) AS flat_file_count,
    CAST((10000 // 37 + CASE WHEN i < 10000 % 37 THEN 1 ELSE 0 END) * 1024 AS BIGINT) AS flat_logical_size_bytes FROM ids"""
)
def generated_folders(spark, d):
    return G.generated_folders(spark, 10_000, 37)


@query("SELECT CAST(1000 AS BIGINT) AS files_total, CAST(1000 AS BIGINT) AS files_same, CAST(0 AS BIGINT) AS bytes_planned")
def generated_self_diff(spark, d):
    rows = G.generated_files(spark, 1000, 20)
    return D.diff_summary(D.diff(rows, rows)).select("files_total", "files_same", "bytes_planned")


BUFFERS_SQL = f"""WITH b0 AS (SELECT unnest(range(0, 16)) AS id), {H.splitmix64('own', 'b0', 'id', 'xor(id::UBIGINT, 1::UBIGINT)')},
    w0 AS (SELECT id, z AS own, unnest(range(0, 2048)) AS j FROM own), {H.splitmix64('w', 'w0', 'id, j', H.add('own', 'j'))},
    l AS (SELECT id, j, {' || '.join(f"substr('{G.ALPHABET.decode()}', CAST(1 + ((z >> {8 * k}) & 63) AS BIGINT), 1)" for k in range(8))} AS s FROM w)
    SELECT id, CAST(65536 AS BIGINT) AS size, md5(unhex(hex(encode(string_agg(s, '' ORDER BY j))) || repeat('00', 49152))) AS digest FROM l GROUP BY id"""


@query(BUFFERS_SQL)
def generated_buffers(spark, d):
    rows = G.generated_buffers(spark, 16, 65536, "fast_text", ratio=4.0)
    return rows.select("id", F.octet_length("data").cast("long").alias("size"), F.md5("data").alias("digest"))


# --- Controls ---


@query(
    """SELECT ram, disk, ram >= 70 AS soft_throttle, ram > 85 AS spill_to_disk, ram > 95 OR disk > 95 AS hard_stop, disk < 20 AS prefetch_to_ram, disk > 80 AS pause_reader,
    ram >= 85 AS reader_pauses, ram <= 70 AS reader_resumes, ram >= 85 AS cache_spills, ram <= 70 AS cache_drains, ram < 50 AS receiver_refills
    FROM (SELECT unnest(range(0, 101)) AS ram), (SELECT unnest(range(0, 101, 5)) AS disk)"""
)
def watermarks(spark, d):
    rows = spark.range(101).select(F.col("id").alias("ram"), F.explode(F.sequence(F.lit(0), F.lit(100), F.lit(5)).cast("array<long>")).alias("disk"))
    return rows.withColumns(controls.watermarks(F.col("ram"), F.col("disk")) | controls.throttles(F.col("ram")))


def _moves_sql(table: dict, states: tuple[str, ...]) -> str:
    pairs = ", ".join(f"('{r}', '{a}', '{b}')" for r, by in table.items() for a, to in by.items() for b in to)
    names = ", ".join(f"('{s}')" for s in states)
    return f"""WITH m(role, a, b) AS (VALUES {pairs}), n(s) AS (VALUES {names}), r(role) AS (VALUES ('sender'), ('receiver'))
    SELECT r.role, x.s AS from_state, y.s AS to_state, x.s = y.s OR EXISTS (SELECT 1 FROM m WHERE m.role = r.role AND m.a = x.s AND m.b = y.s) AS allowed FROM r, n x, n y"""


def _all_moves(spark: SparkSession, table: dict, states: tuple[str, ...]) -> DataFrame:
    names, roles = F.array(*map(F.lit, states)), F.array(F.lit("sender"), F.lit("receiver"))
    rows = spark.range(1).select(F.explode(roles).alias("role")).withColumn("from_state", F.explode(names)).withColumn("to_state", F.explode(names))
    return rows.withColumn("allowed", controls.allowed(F.col("role"), F.col("from_state"), F.col("to_state"), table))


def _register_moves() -> None:
    from grovespark.schemas import FILE_STATES, FOLDER_STATES

    @query(_moves_sql(controls.FILE_MOVES, FILE_STATES))
    def file_state_moves(spark, d):
        return _all_moves(spark, controls.FILE_MOVES, FILE_STATES)

    @query(_moves_sql(controls.FOLDER_MOVES, FOLDER_STATES))
    def folder_state_moves(spark, d):
        return _all_moves(spark, controls.FOLDER_MOVES, FOLDER_STATES)


_register_moves()


@query(
    """SELECT o_orderkey, lower(lpad(to_hex(o_orderkey), 16, '0')[1:2] || '/' || lpad(to_hex(o_orderkey), 16, '0')[3:4] || '/' || lpad(to_hex(o_orderkey), 16, '0')) AS path FROM orders"""
)
def cache_paths(spark, d):
    return V.read(spark, d, "orders", "o_orderkey").select("o_orderkey", controls.cache_path(F.col("o_orderkey")).alias("path"))


@query(
    """SELECT conv_id, turn, CASE WHEN text SIMILAR TO '(?s).*[,"\\r\\n].*' THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS csv,
    '"' || replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"' AS line, '''' || replace(text, '''', '''''') || '''' AS sql FROM conversations"""
)
def quoted_text(spark, d):
    t = F.col("text")
    return V.read(spark, d, "conversations", "conv_id", "turn", "text").select(
        "conv_id", "turn", controls.csv_quoted(t).alias("csv"), controls.text_quoted(t).alias("line"), controls.sql_quoted(t).alias("sql")
    )


# --- Incremental and streaming ---


@query(f"WITH {V.ORDERS_SQL} SELECT s.rel_path, s.size FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.rel_path = s.rel_path AND t.size = s.size AND t.mtime = s.mtime)")
def incremental_scan(spark, d):
    return incremental.changed_since(V.source_orders(spark, d), V.target_orders(spark, d)).select("rel_path", "size")


FILE_STATE_SQL = f"""WITH m(role, a, b) AS (VALUES {", ".join(f"('{r}', '{a}', '{b}')" for r, by in controls.FILE_MOVES.items() for a, to in by.items() for b in to)}),
    e AS (SELECT user_id, event_id, ['checking', 'reading', 'transferring', 'failed', 'done'][CAST(event_id * 7 % 5 AS INTEGER) + 1] AS state FROM events),
    w AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY event_id), 'pending') AS before FROM e)
    SELECT 'user_' || user_id AS rel_path, arg_max(state, event_id) AS state, count(*) AS moves,
           count(*) FILTER (before <> state AND NOT EXISTS (SELECT 1 FROM m WHERE role = 'sender' AND a = before AND b = w.state)) AS invalid FROM w GROUP BY user_id"""


@query(FILE_STATE_SQL)
def file_lifecycles(spark, d):
    names = F.array(*map(F.lit, ("checking", "reading", "transferring", "failed", "done")))
    rows = V.read(spark, d, "events", "user_id", "event_id").select(
        F.format_string("user_%d", "user_id").alias("rel_path"), F.col("event_id").alias("sequence"),
        F.get(names, (F.col("event_id") * 7 % 5).cast("int")).alias("state"),
    )
    return incremental.file_states(rows)


def _side_batches(spark: SparkSession, d: str) -> DataFrame:
    """Both sides of the orders as parts of folders: three for each, the last one final and, on one side, missing for some."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        file = F.struct(F.col("rel_path").alias("name"), "size", "mtime")
        per = rows.groupBy("customer").agg(
            *[F.collect_list(F.when(F.col("id") % 3 == i, file)).alias(f"part_{i}") for i in range(3)]
        )
        listed = [F.struct(F.lit(i).cast("long").alias("sequence"), F.lit(i == 2).alias("final"), F.col(f"part_{i}").alias("files")) for i in range(3)]
        out = per.select("customer", F.format_string("cust_%d", "customer").alias("folder"), F.lit(name).alias("side"), F.inline(F.array(*listed)))
        return out.where(~((F.col("side") == "T") & (F.col("customer") % 10 == 0) & (F.col("sequence") == 1)))

    both = side(V.source_orders(spark, d), "S").unionByName(side(V.target_orders(spark, d), "T"))
    return both.drop("customer")


# A target folder whose part 1 has not come is not whole: what that part holds is not known, nor what the target lacks.
RENDEZVOUS_SQL = f"""WITH {V.diff_sql('time').replace('FROM order_files AS target_files', 'FROM order_files WHERE NOT (customer % 10 = 0 AND id % 3 = 1)')},
    whole AS (SELECT folder FROM s INTERSECT SELECT folder FROM t WHERE customer % 10 <> 0)
    SELECT folder, rel_path AS name, kind, source_size, target_size FROM dd WHERE kind IN ('skip', 'changed') OR folder IN (SELECT folder FROM whole)"""


@query(RENDEZVOUS_SQL)
def rendezvous_diff(spark, d):
    return rendezvous.rendezvous_batch(_side_batches(spark, d))


@query(RENDEZVOUS_SQL)
def rendezvous_diff_stream(spark, d):
    """The same, by a stream with state: parts come from files in no order."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", rendezvous.STORE)
    own.conf.set("spark.sql.shuffle.partitions", "4")
    top = new_path(spark, "rendezvous")
    _side_batches(spark, d).repartition(4).write.parquet(f"{top}/in")
    stream = own.readStream.schema(rendezvous.BATCH_SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{top}/in")
    run = (
        rendezvous.rendezvous(stream)
        .writeStream.format("parquet")
        .option("path", f"{top}/out")
        .option("checkpointLocation", f"{top}/state")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(rendezvous.OUT_SCHEMA).parquet(f"{top}/out")
