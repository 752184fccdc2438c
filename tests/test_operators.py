"""Diff, checker, inventories, chunks, generator: small cases with known answers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from grovespark.operators import chunks as C
from grovespark.operators import diff as D
from grovespark.operators import inventory as I
from grovespark.operators.sync import SyncConfig
from grovespark.schemas import FOLDER_DIFF, INVENTORY
from grovespark.sources import generate as G

FILE = "rel_path string, size long, mtime long, data_hash long"


def table(spark, rows, schema=FILE):
    return spark.createDataFrame(rows, schema)


def kinds(frame):
    return {r["rel_path"]: r["kind"] for r in frame.collect()}


def test_diff_of_scans_by_content(spark):
    source = table(spark, [("same", 4, 10, 1), ("changed", 5, 20, 2), ("new", 3, 30, 3)])
    target = table(spark, [("same", 4, 10, 1), ("changed", 5, 20, 9), ("dir/extra.txt", 5, 40, 4)])
    rows = D.diff(source, target, "content")
    assert kinds(rows) == {"same": "skip", "changed": "changed", "new": "new", "dir/extra.txt": "target_only"}
    assert D.diff_summary(rows).first().asDict() == {
        "files_total": 4, "files_same": 1, "files_changed": 1, "files_new": 1, "files_target_only": 1, "files_failed": 0, "bytes_planned": 8,
    }
    assert kinds(D.diff(source, target, "time"))["changed"] == "skip"
    csv = [tuple(r) for r in D.diff_csv(rows).collect()]
    assert csv[1][:4] == ("dir/extra.txt", "target_only", 0, 0) and [r[0] for r in csv] == sorted(r[0] for r in csv)


@pytest.mark.parametrize(
    ("mode", "kind"), [("size", "skip"), ("time", "changed"), ("content", "changed")]
)
def test_modes(spark, mode, kind):
    got = D.diff(table(spark, [("a", 4, 10, 0)]), table(spark, [("a", 4, 11, 5)]), mode)
    assert kinds(got) == {"a": kind}


def test_mode_names_and_times_to_the_microsecond(spark):
    a, b = table(spark, [("a", 4, 10_100, 0)]), table(spark, [("a", 4, 10_900, 0)])
    assert kinds(D.diff(a, b, "time")) == {"a": "changed"}
    assert kinds(D.diff(a, b, "time", microseconds=True)) == {"a": "skip"}
    with pytest.raises(ValueError):
        D.diff(a, b, "fast")


def test_incomplete_source_and_null_paths(spark):
    source = table(spark, [("a", 1, 1, 0), (None, 1, 1, 0)])
    target = table(spark, [("b", 1, 1, 0), (None, 2, 2, 0)])
    assert kinds(D.diff(source, target)) == {"a": "new", "b": "target_only"}
    assert kinds(D.diff(source, target, source_complete=False)) == {"a": "new"}
    empty = table(spark, [])
    assert D.diff(empty, empty).count() == 0 and D.diff_summary(D.diff(empty, empty)).first()["bytes_planned"] == 0


def test_folder_rows(spark):
    source = table(spark, [("d/a", 4, 1, 0), ("d/b", 5, 1, 0), ("r", 2, 1, 0), ("e/x", 1, 1, 0)])
    target = table(spark, [("d/a", 4, 1, 0), ("d/c", 7, 1, 0), ("r", 2, 1, 0), ("e/x", 2, 1, 0)])
    scans = spark.createDataFrame([("e", "cut off", 5)], "rel_path string, error string, source_folder_count long")
    rows = {r["rel_path"]: r.asDict() for r in D.folder_diff(D.diff(source, target), scans).collect()}
    assert list(rows["d"]) == FOLDER_DIFF.names and set(rows) == {"", "d", "e"}
    d = rows["d"]
    assert (d["files_same"], d["files_new"], d["files_target_only"], d["source_file_count"], d["target_file_count"]) == (1, 1, 1, 2, 2)
    assert (d["bytes_planned"], d["target_only_logical_size_bytes"], d["status"]) == (5, 7, 1)
    assert rows[""]["status"] == 0 and rows["e"]["status"] == 2 and rows["e"]["source_folder_count"] == 5


def test_checker(spark):
    schema = "rel_path string, size long, mtime long, file_hash long, data_hash long, need_check boolean"
    recs = spark.createDataFrame(
        [("meta", 1, 1, 5, 0, True), ("nocheck", 1, 1, 5, 0, False), ("none", 1, 1, 5, 0, True), ("hash", 9, 9, 5, 0, True), ("diff", 2, 2, 5, 0, True)], schema
    )
    scan = "rel_path string, size long, mtime long, file_hash long, data_hash long"
    target = spark.createDataFrame([("meta", 1, 1, 5, 77), ("nocheck", 1, 1, 5, 0), ("hash", 3, 3, 5, 4), ("diff", 2, 3, 5, 0)], scan)
    source = spark.createDataFrame([("hash", 3, 3, 5, 4), ("diff", 2, 3, 5, 1), ("meta", 0, 0, 0, 0)], scan)
    got = {r["rel_path"]: r["skip"] for r in D.checker(recs, target, source).collect()}
    assert got == {"meta": True, "nocheck": False, "none": False, "hash": True, "diff": False}
    assert {r["rel_path"] for r in D.checker(recs, target).where("skip").collect()} == {"meta"}
    assert {r["rel_path"] for r in D.to_transfer(recs, target, "time").collect()} == {"none", "hash", "diff"}


def test_last_wins_and_children(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 3), ("a", 3, 2), ("b", None, 0)], "rel_path string, size long, o long")
    assert sorted(map(tuple, I.last_wins(rows, "o").collect())) == [("a", 2, 3), ("b", None, 0)]
    some = spark.createDataFrame([("x/y/z",), ("z",)], "rel_path string")
    assert sorted(map(tuple, I.children(some).collect())) == [("", "z"), ("x/y", "z")]
    assert sorted(r[0] for r in I.rebuilt(I.children(some)).collect()) == ["x/y/z", "z"]


TREE = [("alpha.txt", 5), ("nested/beta.txt", 4), ("nested/child/gamma.md", 5)]


def test_folder_totals_and_statistics(spark):
    files = spark.createDataFrame(TREE, "rel_path string, size long")
    folders = spark.createDataFrame([("nested",), ("nested/child",), ("empty",), ("empty/child",)], "rel_path string")
    got = {r[0]: (r[1], r[2]) for r in I.folder_totals(files, folders).collect()}
    assert got == {"nested": (1, 4), "nested/child": (1, 5), "empty": (0, 0), "empty/child": (0, 0)}
    assert {r[0] for r in I.folders_of(files).collect()} == {"nested", "nested/child"}
    rows = files.withColumn("record_type", F.lit("file")).unionByName(folders.withColumns({"record_type": F.lit("folder"), "size": F.lit(None).cast("long")}))
    assert tuple(I.scan_statistics(rows).first()) == (7, 3, 7, 14)
    assert tuple(I.scan_statistics(rows, True, 2.0).first()) == (7, 3, 5, 14, 2.0, 3.5)
    assert tuple(I.scan_statistics(rows.where("false")).first()) == (0, 0, 0, 0)


def test_inventory_rows(spark):
    files = spark.createDataFrame([("//a//b", 1, 2, 420, 1, 1)], "rel_path string, size long, mtime long, mode int, uid int, gid int")
    folders = spark.createDataFrame([("a", 2, 493, 1, 1, 1, 1)], "rel_path string, mtime long, mode int, uid int, gid int, flat_file_count long, flat_logical_size_bytes long")
    rows = {r["record_type"]: r for r in I.inventory(files, folders).collect()}
    assert I.inventory(files, folders).schema.names == INVENTORY.names
    assert rows["file"]["rel_path"] == "a/b" and rows["file"]["content_hash"] == "" and rows["file"]["flat_file_count"] is None
    assert rows["folder"]["size"] is None and rows["folder"]["content_hash"] is None and rows["folder"]["scan_run_id"] is None
    run = I.ScanRun("r", "2024", 5, "/x")
    assert I.inventory(files, None, run).first()["run_started_unix_ns"] == 5
    with pytest.raises(ValueError):
        I.selected(I.inventory(files), False, False)


def test_records_and_snapshots(spark):
    files = spark.createDataFrame(
        [("/d/x", bytearray(b"hello"), 0, 7, 420, 1, 2, True), ("y", None, 9, 7, 420, 1, 2, False), ("z", None, 0, 7, 420, 1, 2, True), (None, None, 0, 7, 1, 1, 1, True)],
        "rel_path string, content binary, declared_size long, mtime long, mode int, uid int, gid int, need_check boolean",
    )
    recs = I.records(files)
    assert {r["rel_path"]: (r["name"], r["size"]) for r in recs.collect()} == {"d/x": ("x", 5), "y": ("y", 9), "z": ("z", 0)}
    snap = I.snapshots(recs, F.lit(3).cast("long"), "T").where("rel_path = 'd/x'").first()
    assert (snap["data_hash"], snap["hash_ts"], snap["scan_side"]) == (3, 7, "T")
    with pytest.raises(ValueError):
        I.snapshots(recs, F.lit(0), "ST")


@pytest.mark.parametrize(("size", "n"), [(0, 1), (4, 1), (5, 1), (8, 1), (9, 2), (16, 2), (17, 3)])
def test_chunks(spark, size, n):
    files = spark.createDataFrame([(1, bytearray(bytes(range(size))))], "file_id long, content binary")
    rows = C.chunks(files, threshold=4, chunk=8)
    got = rows.orderBy("chunk_index").collect()
    assert len(got) == n and [r["is_last"] for r in got] == [False] * (n - 1) + [True]
    assert b"".join(bytes(r["data"]) for r in got) == bytes(range(size)) and all(r["is_small"] == (size <= 4) for r in got)
    assert bytes(C.reassembled(rows.orderBy(F.rand(1))).first()["content"]) == bytes(range(size))
    assert tuple(C.completion(rows).first()) == (1, n, size, True)
    if n > 1:
        assert not C.completion(rows.where("chunk_index > 0")).first()["complete"]
        assert not C.completion(rows.where("not is_last")).first()["complete"]


def test_chunk_sizes_must_be_positive(spark):
    with pytest.raises(ValueError):
        C.chunks(spark.createDataFrame([], "file_id long, content binary"), threshold=0)
    for bad in ({"small_file_threshold": 0}, {"large_chunk_bytes": -1}, {"max_retries": -1}):
        with pytest.raises(ValueError):
            SyncConfig(**bad)


def test_packs(spark):
    rng = random.Random(1)
    rows = [(f"d/f{i}", bytearray(rng.randbytes(rng.randint(0, 300)))) for i in range(64)] + [("empty", None)]
    files = spark.createDataFrame(rows, "rel_path string, content binary").repartition(2)
    packed = C.packs(files, capacity=2048)
    got = packed.collect()
    assert 1 < len(got) < 64 and all(r["bytes_used"] <= 2048 and r["n_files"] == len(r["entries"]) for r in got)
    assert {r["rel_path"]: bytes(r["data"]) for r in C.unpacked(packed).collect()} == {p: bytes(d or b"") for p, d in rows}
    with pytest.raises(Exception, match="does not fit"):
        C.packs(files, capacity=128).collect()
    with pytest.raises(Exception, match="malformed"):
        C.unpacked(packed.withColumn("n_files", F.lit(0))).collect()


def test_generator(spark):
    files, folders = G.generated_files(spark, 10, 3, 1024, 123), G.generated_folders(spark, 10, 3, 1024)
    rows = files.collect()
    assert rows[4]["rel_path"] == "synthetic/dir_00000001/file_000000000004.dat" and rows[4]["uid"] == 1004 and rows[4]["mode"] == 0o644
    assert all(1 <= r["size"] < 2048 for r in rows) and len({r["size"] for r in rows}) > 5
    assert [r["flat_file_count"] for r in folders.collect()] == [4, 3, 3] and folders.first()["flat_logical_size_bytes"] == 4096
    assert {r["size"] for r in G.generated_files(spark, 5, 1, 0).collect()} == {0}
    assert rows == G.generated_files(spark, 10, 3, 1024, 123).repartition(3).orderBy("mtime").collect()


def test_generated_buffers(spark):
    for kind in ("zero", "fast_text", "random_text", "xoshiro256", "pseudo_random"):
        got = [bytes(r["data"]) for r in G.generated_buffers(spark, 3, 1000, kind, ratio=4).collect()]
        assert all(len(b) == 1000 and b[250:] == bytes(750) for b in got)
        assert (len(set(got)) == 1) == (kind == "zero")
        if kind == "fast_text":
            assert set(got[0][:250]) <= set(G.ALPHABET)
    with pytest.raises(ValueError):
        G.generated_buffers(spark, 1, 1, "noise")


def test_rolling_rate(spark):
    rows = spark.createDataFrame([(1, 0), (1, 0), (1, 59), (1, 60), (2, 5)], "k int, second long")
    got = {(r["k"], r["second"]): r["rate"] * 60 for r in I.rolling_rate(rows, "k", "second").collect()}
    assert got == {(1, 0): 2, (1, 59): 3, (1, 60): 2, (2, 5): 1}
