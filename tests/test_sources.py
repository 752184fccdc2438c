"""File trees, scan files, sync, streams and commands, over temporary folders."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from grovespark import cli
from grovespark.operators import sync as Y
from grovespark.operators.inventory import ScanRun, inventory
from grovespark.sources import filetree, scanfiles
from grovespark.streaming import incremental, rendezvous


def tree(top, files):
    for name, content in files.items():
        path = top / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
        os.utime(path, ns=(1700100000111111111, 1700100000111111111))
    return str(top)


FILES = {"alpha.txt": b"alpha", "nested/beta.txt": b"beta", "nested/child/gamma.md": b"gamma"}


@pytest.fixture
def root(tmp_path):
    (tmp_path / "t/empty/child").mkdir(parents=True)
    return tree(tmp_path / "t", FILES)


@pytest.mark.parametrize("partitions", [1, 2, 64])
def test_file_tree(spark, root, partitions):
    os.symlink(f"{root}/alpha.txt", f"{root}/link")
    os.symlink(f"{root}/nowhere", f"{root}/broken")
    os.symlink(root, f"{root}/nested/loop")
    rows = {r["rel_path"]: r for r in filetree.file_tree(spark, root, partitions=partitions).collect()}
    broken = rows.pop("broken")
    assert broken["failed"] and broken["size"] is None and "nowhere" in os.readlink(f"{root}/broken") and broken["error"]
    assert set(rows) == {*FILES, "link", "nested", "nested/child", "nested/loop", "empty", "empty/child"}
    r = rows["nested/beta.txt"]
    assert (r["record_type"], r["parent_path"], r["size"], r["mtime"], r["failed"]) == ("file", "nested", 4, 1700100000111111111, False)
    assert r["mode"] == os.stat(f"{root}/nested/beta.txt").st_mode & 0o777 and rows["empty"]["size"] is None


def test_file_tree_filters_and_flat_listing(spark, root):
    rows = filetree.file_tree(spark, root)
    assert {r["rel_path"] for r in rows.where("parent_path = 'nested'").collect()} == {"nested/beta.txt", "nested/child"}
    assert {r["rel_path"] for r in rows.where("record_type = 'file' and size <= 4").collect()} == {"nested/beta.txt"}
    assert {r["rel_path"] for r in filetree.file_tree(spark, root, recursive=False).collect()} == {"alpha.txt", "nested", "empty"}
    bad = rows.where("parent_path = 'missing'")
    assert bad.count() == 0 or bad.first()["failed"]
    with pytest.raises(Exception, match="not a folder"):
        filetree.file_tree(spark, f"{root}/alpha.txt").collect()


def test_a_folder_that_cannot_be_listed_is_a_row(root):
    reader = filetree.TreeReader({"root": root})
    ((row, below),) = reader.listed("gone")
    assert row[1] == "gone" and row[9] is True and row[10] and below is None


def test_a_listing_that_breaks_off_and_entries_that_are_gone_are_rows(root, monkeypatch):
    class Breaking:
        def __init__(self, path):
            self.found = real(path)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.found.close()

        def __iter__(self):
            yield next(self.found)
            raise OSError("stale handle")

    real = os.scandir
    reader = filetree.TreeReader({"root": root})
    monkeypatch.setattr(os, "scandir", Breaking)
    rows = [r for r, _ in reader.listed("")]
    assert len(rows) == 2 and not rows[0][9] and rows[1][1] == "" and rows[1][9] and "stale" in rows[1][10]
    monkeypatch.setattr(os, "scandir", real)
    monkeypatch.setattr(filetree.TreeReader, "names", lambda self, folder: iter(["alpha.txt", "gone"]))
    (good, _), (bad, _) = reader.listed("")
    assert good[1] == "alpha.txt" and bad[1] == "gone" and bad[9] and bad[10]


def test_a_stream_goes_on_behind_its_last_folder(tmp_path):
    for name in ("a/b", "a/c", "d", "e/f"):
        (tmp_path / name).mkdir(parents=True)
    stream = filetree.TreeStream({"root": str(tmp_path), "folders_per_batch": "3"})
    assert list(stream.walk(None)) == ["", "a", "a/b", "a/c", "d", "e", "e/f"]
    end = stream.latestOffset()
    first = [p for part in stream.partitions(stream.initialOffset(), end) for p in part.paths]
    assert end == {"folder": "a/b"} and sorted(first) == ["", "a", "a/b"]
    # Folders that come before the offset, or go, shift nothing.
    (tmp_path / "a/a").mkdir()
    (tmp_path / "0").mkdir()
    (tmp_path / "a/b").rmdir()
    later = filetree.TreeStream({"root": str(tmp_path), "folders_per_batch": "3"})
    assert later.partitions(stream.initialOffset(), end) and later.at == "a/b"
    next_end = later.latestOffset()
    assert next_end == {"folder": "e"} and sorted(p for part in later.partitions(end, next_end) for p in part.paths) == ["a/c", "d", "e"]
    assert later.latestOffset() == {"folder": "e/f"} == later.latestOffset()
    assert later.partitions({"folder": "e/f"}, {"folder": "e/f"}) == []


def test_contents(spark, root):
    tree_with_odd_names = {"a b%20+c.txt": b"x"}
    for name, content in tree_with_odd_names.items():
        with open(f"{root}/{name}", "wb") as f:
            f.write(content)
    got = {r["rel_path"]: bytes(r["content"]) for r in filetree.file_contents(spark, root).collect()}
    assert got == FILES | tree_with_odd_names


SHORT = "folder_hash,file_hash,rel_path,size,mtime,mode,uid,gid,data_hash,hash_ts,scan_side"
LONG = (
    "record_type,rel_path,size,mtime,mode,uid,gid,flat_file_count,flat_logical_size_bytes,hash_algorithm,content_hash,hash_block_size,"
    "hash_block_count,block_hash_algorithm,block_hashes,scan_run_id,run_started_at_utc,run_started_unix_ns,source_root,run_settings"
)


def read(spark, tmp_path, text):
    (tmp_path / "scan.csv").write_text(text, newline="")
    return scanfiles.read_scan_csv(spark, str(tmp_path / "scan.csv"))


def test_scan_csv(spark, tmp_path):
    big = (1 << 64) - 1
    rows = read(spark, tmp_path, f'{SHORT}\r\n{big},2,"/d/a ""x"",1",5,6,420,0,0,7,8,T\r\n\r\n1,1,b,1,1,1,1,1,1,1,S\n1,1,/b/,2,1,1,1,1,1,1,S\n').collect()
    got = {r["rel_path"]: r for r in rows}
    assert got['d/a "x",1']["folder_hash"] == -1 and got['d/a "x",1']["scan_side"] == "T" and got["b"]["size"] == 2


def test_long_scan_csv(spark, tmp_path):
    rows = read(spark, tmp_path, f'{LONG}\nfile,d/a,5,6,420,0,0,,,sha256,abc,0,0,"","",,,,,\nfolder,d,,6,493,0,0,1,5,,,,,,,,,,,\nfile,b,1,2,420,0,0,,,"","",0,0,"","",r,x,99,/,"{{}}"\n')
    got = {r["rel_path"]: r for r in rows.collect()}
    assert set(got) == {"d/a", "b"} and got["d/a"]["data_hash"] == 0 and got["d/a"]["hash_ts"] == 0 and got["b"]["hash_ts"] == 99
    from grovespark.functions.hashing import with_identity

    want = with_identity(spark.createDataFrame([("d/a",)], "rel_path string")).first()
    assert got["d/a"]["file_hash"] == want["file_hash"]


@pytest.mark.parametrize("text", ["", "a,b\n1,2\n", f"{SHORT}\n1,2,a,5,6,420,0,0,7,8\n", f"{SHORT}\n1,2,a,5,6,420,0,0,7,8,ST\n", f"{SHORT}\n1,x,a,5,6,420,0,0,7,8,S\n", f"{SHORT}\n1,-2,a,5,6,420,0,0,7,8,S\n", f"{SHORT}\n{1 << 64},2,a,5,6,420,0,0,7,8,S\n"])
def test_bad_scan_csv(spark, tmp_path, text):
    with pytest.raises(Exception):  # noqa: B017
        read(spark, tmp_path, text).collect()


def test_scan_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(-1, 2, 'a,"b"', 5, 6, 420, 0, 0, -7, 8, "T"), (1, 2, "a", 5, 6, 420, 0, 0, 7, 8, "S")], scanfiles.SNAPSHOT)
    scanfiles.write_scan_csv(rows, str(tmp_path / "out"))
    back = scanfiles.read_scan_csv(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_formats():
    assert [scanfiles.infer_format(p) for p in ("a.CSV", "a.parquet", "a.txt", "a")] == ["csv", "parquet", "text", "text"]
    assert scanfiles.parse_format("txt") == "text"
    with pytest.raises(ValueError):
        scanfiles.parse_format("json")


@pytest.fixture
def rows(spark):
    files = spark.createDataFrame([("folder/a.txt", 7, 123, 420, 10, 20, "sha256", "abc123", 4, 2, "md5", "block1;block2")],
        "rel_path string, size long, mtime long, mode int, uid int, gid int, hash_algorithm string, content_hash string, hash_block_size long, hash_block_count long, block_hash_algorithm string, block_hashes string")
    folders = spark.createDataFrame([("folder", 456, 493, 11, 21, 1, 7)], "rel_path string, mtime long, mode int, uid int, gid int, flat_file_count long, flat_logical_size_bytes long")
    return lambda run=None: inventory(files, folders, run)


def test_inventory_files(spark, tmp_path, rows):
    lines = [r[0] for r in scanfiles.csv_lines(rows()).collect()]
    assert lines[0].startswith("file,folder/a.txt,7,123,420,10,20,,,sha256,abc123,4,2,md5,block1;block2")
    assert lines[1].startswith("folder,folder,,456,493,11,21,1,7")
    text = [r[0] for r in scanfiles.text_lines(rows()).collect()]
    assert text[0].startswith('file rel_path="folder/a.txt" size=7 mtime=123 mode=420 uid=10 gid=20 hash_algorithm="sha256" content_hash="abc123"')
    assert text[1] == 'folder rel_path="folder" mtime=456 mode=493 uid=11 gid=21 flat_file_count=1 flat_logical_size_bytes=7'
    scanfiles.write_inventory(rows(), str(tmp_path / "o.csv"))
    header, *body = [r[0] for r in spark.read.text(str(tmp_path / "o.csv")).orderBy(F.desc(F.startswith("value", F.lit("record")))).collect()]
    assert header == LONG and lines[0] in body
    assert scanfiles.read_scan_csv(spark, str(tmp_path / "o.csv")).first()["rel_path"] == "folder/a.txt"
    scanfiles.write_inventory(rows(), str(tmp_path / "o.txt"), folders=False, partitions=1)
    assert [r[0] for r in spark.read.text(str(tmp_path / "o.txt")).collect()] == text[:1]
    with pytest.raises(ValueError):
        scanfiles.write_inventory(rows(), str(tmp_path / "o.csv"), append=True)


def test_parquet_holds_several_runs(spark, tmp_path, rows):
    path = str(tmp_path / "runs.parquet")
    for name in ("one", "two"):
        scanfiles.write_inventory(rows(ScanRun(name, "2024", 1, "/")), path, append=True)
    assert {r[0]: r[1] for r in scanfiles.read_inventory(spark, path).groupBy("scan_run_id").count().collect()} == {"one": 2, "two": 2}


def test_sync(spark, root, tmp_path):
    target = str(tmp_path / "copy")
    plan = Y.sync(spark, root, target, dry_run=True)
    assert (plan["files_new"], plan["bytes_planned"], plan["files_transferred"]) == (3, 14, 0) and not os.path.exists(target)
    config = Y.SyncConfig(small_file_threshold=4, large_chunk_bytes=8)
    done = Y.sync(spark, root, target, config)
    assert (done["files_transferred"], done["bytes_transferred"], done["retries"]) == (3, 14, 0)
    assert os.path.isdir(f"{target}/empty/child")
    for name, content in FILES.items():
        with open(f"{target}/{name}", "rb") as f:
            assert f.read() == content
        assert os.stat(f"{target}/{name}").st_mtime_ns == 1700100000111111111
    for name in ("nested", "nested/child", "empty/child"):
        assert os.stat(f"{target}/{name}").st_mtime_ns == os.stat(f"{root}/{name}").st_mtime_ns
        assert os.stat(f"{target}/{name}").st_mode == os.stat(f"{root}/{name}").st_mode
    again = Y.sync(spark, root, target)
    assert (again["files_skipped"], again["bytes_planned"], again["files_transferred"]) == (3, 0, 0)
    with open(f"{root}/alpha.txt", "w") as f:
        f.write("newer")
    assert Y.sync(spark, root, target)["files_changed"] == 1


@pytest.mark.parametrize(("failures", "outcome", "attempts"), [(1, "done", 2), (2, "done", 3), (4, "failed", 3)])
def test_retries(spark, root, tmp_path, failures, outcome, attempts):
    marks = str(tmp_path / "marks")

    def flaky(source, target, attributes, config):
        with open(marks, "a") as f:
            f.write("x")
        if os.path.getsize(marks) <= failures:
            return 1, 0, "forced"
        return Y.copy_file(source, target, attributes, config)

    files = filetree.file_tree(spark, root).where("rel_path = 'alpha.txt'")
    rows = Y.transfer(files, root, str(tmp_path / "copy"), Y.SyncConfig(max_retries=2), flaky).collect()
    assert [(r["outcome"], r["attempts"]) for r in rows] == [(outcome, attempts)]


def test_short_reads_and_missing_files_fail(root, tmp_path):
    row = {"size": 99, "mtime": 1, "mode": 420, "uid": 0, "gid": 0}
    assert "read 5 of 99" in Y.copy_file(f"{root}/alpha.txt", str(tmp_path / "x/y"), row, Y.SyncConfig())[2]
    assert Y.copy_file(f"{root}/none", str(tmp_path / "x/y"), row, Y.SyncConfig())[2] and not os.listdir(tmp_path / "x")


def parts():
    out = []
    for f in range(6):
        s = [[(f"n{i}", 10 + i, 5) for i in range(8) if i % 2 == q] for q in range(2)]
        t = [[(f"n{i}", 10 + i + (i == 3), 5 + (i == 4)) for i in range(2, 10) if i % 2 == q] for q in range(2)]
        rows = [(f"f{f}", side, q, q == 2, files) for side, all_ in (("S", s), ("T", t)) for q, files in enumerate([*all_, []])]
        out += [r for r in rows if not (f == 5 and r[1] == "T" and r[2] == 1)] + rows[:1]
    return out


def test_rendezvous_stream_equals_join(spark, tmp_path):
    frame = spark.createDataFrame(parts(), rendezvous.BATCH_SCHEMA)
    want = sorted(map(str, rendezvous.rendezvous_batch(frame).collect()))
    frame.orderBy(F.xxhash64("side", "sequence", "folder")).repartition(5, F.rand(3)).write.parquet(str(tmp_path / "in"))
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", rendezvous.STORE)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    stream = own.readStream.schema(rendezvous.BATCH_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = rendezvous.rendezvous(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    run.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(rendezvous.OUT_SCHEMA).parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.collect())) == want
    kinds = {(r["folder"], r["kind"]): r["count"] for r in got.groupBy("folder", "kind").count().collect()}
    assert kinds["f0", "new"] == 2 and kinds["f0", "target_only"] == 2 and kinds["f0", "changed"] == 2 and ("f5", "new") not in kinds


def test_incremental(spark, tmp_path):
    schema = "rel_path string, size long, mtime long"
    previous = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], schema)
    scan = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", None, None)], schema)
    assert {r[0] for r in incremental.changed_since(scan, previous).collect()} == {"b", "c"}
    scan.write.parquet(str(tmp_path / "in"))
    stream = incremental.changed_since(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), previous)
    for _ in range(2):
        incremental.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert {r["rel_path"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"b", "c"}


def run(spark, capsys, *args):
    code = cli.main(list(args), spark)
    return code, dict(p.split("=", 1) for p in capsys.readouterr().out.split()[1:])


def test_commands(spark, root, tmp_path, capsys):
    out = str(tmp_path / "scan.csv")
    code, said = run(spark, capsys, "scan", root, "--output", out)
    assert code == 0 and said["files_found"] == "3" and said["logical_size_bytes"] == "14"
    code, _ = run(spark, capsys, "hash", root, "--output", str(tmp_path / "h.parquet"), "--mode", "both", "--algorithm", "md5", "--block-size", "4")
    got = {r["rel_path"]: r for r in spark.read.parquet(str(tmp_path / "h.parquet")).where("record_type = 'file'").collect()}
    import hashlib

    assert code == 0 and got["alpha.txt"]["content_hash"] == hashlib.md5(b"alpha").hexdigest() and got["alpha.txt"]["hash_block_count"] == 2
    copy = str(tmp_path / "copy")
    assert run(spark, capsys, "dry-run", root, copy)[1]["files_new"] == "3"
    code, said = run(spark, capsys, "sync", root, copy)
    assert code == 0 and said["files_transferred"] == "3"
    os.remove(f"{copy}/alpha.txt")
    report = str(tmp_path / "folders")
    code, said = run(spark, capsys, "diff", "--source", root, "--target", copy, "--folder-report", report, "--output", str(tmp_path / "d"))
    assert code == 0 and said["files_new"] == "1" and said["files_same"] == "2"
    assert spark.read.csv(report, header=True).where("files_new = '1'").count() == 1
    code, said = run(spark, capsys, "diff", "--source-scan", out, "--target-scan", out)
    assert said["files_total"] == said["files_same"] == "3"
    code, _ = run(spark, capsys, "incremental", root, "--previous", str(tmp_path / "h.parquet"), "--output", str(tmp_path / "i.parquet"))
    assert spark.read.parquet(str(tmp_path / "i.parquet")).count() == 0
    code, said = run(spark, capsys, "generate", str(tmp_path / "g.parquet"), "--files", "20", "--folders", "4")
    assert said["records"] == "24" and spark.read.parquet(str(tmp_path / "g.parquet")).count() == 24
    assert run(spark, capsys, "benchmark-meta", root)[1]["files_found"] == "3"
    assert run(spark, capsys, "benchmark-data", root)[1]["bytes_read"] == "14"
    assert run(spark, capsys, "benchmark-data-hash", root, "--max-file-size", "4")[1]["files_read"] == "1"
    assert run(spark, capsys, "benchmark-open", root)[1]["files_opened"] == "3"
    assert run(spark, capsys, "benchmark-fake-diff", "--files", "1000", "--folders", "20")[1]["files_same"] == "1000"
    assert "gb_per_second" in run(spark, capsys, "benchmark-transport", "--buffers", "2", "--bytes", "1000")[1]
    settings = tmp_path / "c.json"
    settings.write_text('{"defaults": {"folders": 3}, "benchmark-fake-diff": {"files": 30}}')
    assert run(spark, capsys, "--config", str(settings), "benchmark-fake-diff")[1]["files_total"] == "30"
    assert run(spark, capsys, "--config", str(settings), "benchmark-fake-diff", "--files", "7")[1]["files_total"] == "7"
    assert cli.main(["benchmark-hash", "--buffers", "2", "--bytes", "1000", "--minimum-gb-per-second", "1e9"], spark) == 2
    for bad in (["diff", "--source", root], ["diff", "--source", root, "--target", copy, "--source-scan", out], ["diff", "--source", root, "--target", copy, "--summary-only", "--output", "x"]):
        with pytest.raises(SystemExit):
            cli.main(bad, spark)


def test_config(tmp_path):
    from grovespark.config import Config

    one, two = tmp_path / "one.json", tmp_path / "two.json"
    one.write_text('{"defaults": {"depth": 1, "x": {"a": 1, "b": 2}}, "job": {"depth": 5}}')
    two.write_text('{"defaults": {"x": {"b": 3}}}')
    config = Config.load([str(one), str(two)], {"job": {"depth": 9}})
    assert config.section("defaults", "job") == {"depth": 9, "x": {"a": 1, "b": 3}}
    assert config.section("none") == {} and config.section("defaults.x") == {"a": 1, "b": 3}
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(ValueError):
        Config.load([str(tmp_path / "bad.json")])


def test_watched_totals_and_probe(spark, root):
    from grovespark.operators.inventory import watched

    rows, seen = watched(filetree.file_tree(spark, root))
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"accepted": 7, "files": 3, "logical_size_bytes": 14}
    some = spark.createDataFrame([("alpha.txt",), ("gone",)], "rel_path string")
    got = {r["rel_path"]: r for r in filetree.open_probe(some, root).collect()}
    assert got["alpha.txt"]["opened"] and not got["gone"]["opened"] and got["gone"]["error"]


def test_a_stream_that_is_stopped(spark, tmp_path):
    spark.range(10).withColumnRenamed("id", "n").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n long").parquet(str(tmp_path / "in"))
    query = incremental.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "state")).start()
    incremental.stop_after(query, 1)
    assert not query.isActive and spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_file_tree_as_a_stream(spark, root, tmp_path):
    def scan():
        stream = filetree.file_tree_stream(spark, root, 2).select("rel_path", "record_type", "size")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        query = query.option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        batches = len([p for p in query.recentProgress if p["numInputRows"]])
        query.stop()
        return batches

    assert scan() > 1
    want = sorted(r["rel_path"] for r in filetree.file_tree(spark, root).collect())
    assert sorted(r["rel_path"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
    assert scan() == 0
    assert sorted(r["rel_path"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_two_sites_chunks_and_status(spark, root, tmp_path, capsys):
    target, exchange, status = tree(tmp_path / "other", {"alpha.txt": b"ALPHA", "extra": b"x"}), str(tmp_path / "x"), str(tmp_path / "s/status.json")
    said = lambda: dict(p.split("=", 1) for p in capsys.readouterr().out.split()[1:])
    assert cli.main(["diff-source", root, "--exchange", exchange], spark) == 0 and said()["sent"].startswith(exchange)
    assert cli.main(["diff-target", target, "--exchange", exchange], spark) == 0
    assert said()["files_same"] == "1"
    report = str(tmp_path / "report")
    assert cli.main(["--status", status, "diff-source", root, "--exchange", exchange, "--folder-report", report], spark) == 0
    assert said() == {"folders_total": "3", "folders_differing": "3", "files_same": "1", "files_changed": "0", "files_new": "2", "files_target_only": "1", "files_failed": "0", "bytes_planned": "9"}
    assert spark.read.option("header", True).csv(report).count() == 3
    assert cli.main(["status", status]) == 0
    out = said()
    assert (out["command"], out["state"], out["exit_code"]) == ("diff-source", "done", "0")
    with pytest.raises(Exception, match="folder"):
        cli.main(["--status", status, "scan", f"{root}/alpha.txt"], spark)
    assert cli.main(["status", status]) == 0 and " state=failed " in capsys.readouterr().out
    sent = str(tmp_path / "sent")
    assert cli.main(["send", root, "unused", "--chunks", sent], spark) == 0 and said()
    assert cli.main(["receive", sent, str(tmp_path / "got")], spark) == 0 and said() == {"files_written": "3", "files_failed": "0", "files_incomplete": "0"}
    for name, content in FILES.items():
        assert (tmp_path / "got" / name).read_bytes() == content and os.stat(tmp_path / "got" / name).st_mtime_ns == 1700100000111111111


def test_streams_report_their_progress(spark, tmp_path):
    from grovespark.status import read_status, watch_streams

    spark.range(10).withColumnRenamed("id", "n").write.parquet(str(tmp_path / "in"))
    listener = watch_streams(spark, str(tmp_path / "status.json"))
    try:
        stream = spark.readStream.schema("n long").parquet(str(tmp_path / "in"))
        run = incremental.write_batches(stream, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
        for _ in range(100):
            if os.path.exists(tmp_path / "status.json") and read_status(str(tmp_path / "status.json"))["state"] == "done":
                break
            time.sleep(0.1)
        assert read_status(str(tmp_path / "status.json"))["state"] == "done"
    finally:
        spark.streams.removeListener(listener)


def test_roots():
    mounts = {"filer:/vol": "/mnt/vol", "filer:/vol/home": "/mnt/home"}
    assert filetree.local_root("nfs://filer/vol/a/b?uid=0", mounts) == "/mnt/vol/a/b"
    assert filetree.local_root("nfs://filer/vol/home/x", mounts) == "/mnt/home/x" and filetree.local_root("nfs://filer/vol", mounts) == "/mnt/vol"
    assert filetree.local_root("file:///a/b/", {}) == filetree.local_root("/a//b", {}) == filetree.local_root("file:/a/b", {}) == "/a/b"
    for root in ("nfs://other/vol", "nfs://filer/volume", "s3a://bucket/x"):
        with pytest.raises(ValueError):
            filetree.local_root(root, mounts)
