"""Commands: ``python -m grovespark.cli scan | hash | diff | diff-source | diff-target | dry-run | sync | receive | status | generate |
incremental | benchmark-... | --version``.

``--config FILE`` (JSON or YAML, any number) gives defaults for a command's options
in a section named after it; what stands on the command line wins. With ``--status FILE``
a run tells there what it does, which ``status FILE`` prints.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.config import Config
from grovespark.functions.hashing import ALGORITHMS, block_count, block_hashes, content_hash, parse_algorithm
from grovespark.operators.chunks import acknowledged
from grovespark.operators.diff import answer_summary, compact, diff, diff_csv, diff_summary, folder_answer, folder_diff
from grovespark.operators.inventory import ScanRun, folder_totals, inventory, read_totals, scan_statistics, size_capped, subtree
from grovespark.operators.sync import SyncConfig, receive_chunks, send_chunks, sync
from grovespark.shared import cut_lineage
from grovespark.sources.filetree import file_contents, file_tree, open_probe
from grovespark.sources.generate import generated_buffers, generated_files, generated_folders
from grovespark.sources.scanfiles import read_scan_csv, summary_line, write_inventory
from grovespark.status import Running, read_status
from grovespark.streaming.incremental import changed_since

VERSION = "0.1.0"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="grovespark")
    top.add_argument("--version", action="version", version=VERSION)
    top.add_argument("--config", action="append", default=[])
    top.add_argument("--status")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *aliases: str) -> argparse.ArgumentParser:
        return commands.add_parser(name, aliases=list(aliases))

    for name in ("scan", "hash"):
        p = command(name)
        p.add_argument("root")
        p.add_argument("--output")
        p.add_argument("--format")
        p.add_argument("--non-recursive", action="store_true")
        p.add_argument("--files-only", action="store_true")
        p.add_argument("--folders-only", action="store_true")
        p.add_argument("--partitions", type=int)
        p.add_argument("--append", action="store_true")
        if name == "hash":
            p.add_argument("--algorithm", default="sha256")
            p.add_argument("--mode", choices=("file", "block", "both"), default="file")
            p.add_argument("--block-size", type=int, default=1024 * 1024)
            p.add_argument("--block-algorithm", default="md5")
            p.add_argument("--max-file-size", type=int, default=0)
    p = command("diff")
    for side in ("source", "target"):
        p.add_argument(f"--{side}")
        p.add_argument(f"--{side}-scan")
    p.add_argument("--mode", choices=("size", "time", "content"), default="time")
    p.add_argument("--output")
    p.add_argument("--folder-report")
    p.add_argument("--summary-only", action="store_true")
    for name, aliases in (("dry-run", ()), ("sync", ("send", "copy"))):
        p = command(name, *aliases)
        p.add_argument("source")
        p.add_argument("target")
        p.add_argument("--mode", choices=("size", "time", "content"), default="time")
        p.add_argument("--max-retries", type=int, default=3)
        p.add_argument("--skip-verify", action="store_true")
        p.add_argument("--chunks", help="write a table of chunks here for receive, instead of files at the target")
    for name in ("diff-source", "diff-target"):
        p = command(name)
        p.add_argument("root")
        p.add_argument("--exchange", required=True, help="a folder that both sites can reach")
        p.add_argument("--mode", choices=("size", "time", "content"), default="size")
        if name == "diff-source":
            p.add_argument("--folder-report")
            p.add_argument("--wait-seconds", type=float, default=0.0)
    p = command("receive")
    p.add_argument("chunks")
    p.add_argument("root")
    command("status").add_argument("file")
    p = command("generate", "benchmark-metadata-writer")
    p.add_argument("output")
    p.add_argument("--files", type=int, default=1000)
    p.add_argument("--folders", type=int, default=10)
    p.add_argument("--average-size", type=int, default=1024)
    p.add_argument("--seed", type=int, default=123)
    p.add_argument("--root", default="synthetic")
    p.add_argument("--partitions", type=int)
    p.add_argument("--format")
    p = command("incremental")
    p.add_argument("root")
    p.add_argument("--previous", required=True)
    p.add_argument("--output", required=True)
    p = command("benchmark-hash", "hash-speed")
    p.add_argument("--algorithm", choices=sorted(ALGORITHMS), default="xxh64")
    p.add_argument("--minimum-gb-per-second", type=float, default=0.0)
    buffers = [p, command("benchmark-transport", "transport-speed")]
    for p in buffers:
        p.add_argument("--buffers", type=int, default=64)
        p.add_argument("--bytes", type=int, default=1024 * 1024)
        p.add_argument("--kind", default="zero")
        p.add_argument("--compression-ratio", type=float, default=1.0)
    p = command("benchmark-fake-diff")
    p.add_argument("--files", type=int, default=1000)
    p.add_argument("--folders", type=int, default=20)
    for name in ("benchmark-meta", "benchmark-data", "benchmark-open", "benchmark-data-hash"):
        p = command(name)
        p.add_argument("root")
        p.add_argument("--max-file-size", type=int, default=0)
        p.add_argument("--algorithm", default="xxh64")
    return top


def scan_run(root: str, settings: dict) -> ScanRun:
    now = time.time_ns()
    stamp = datetime.fromtimestamp(now / 1e9, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return ScanRun(uuid.uuid4().hex, stamp, now, root, json.dumps(settings, sort_keys=True))


def scanned(spark: SparkSession, root: str, recursive: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, folders with totals, failed folders)."""
    rows = file_tree(spark, root, recursive)
    good = rows.where(~F.col("failed"))
    files = good.where(F.col("record_type") == "file")
    return files, folder_totals(files, good.where(F.col("record_type") == "folder")), rows.where("failed").select("record_type", "rel_path")


def do_scan(spark: SparkSession, args: argparse.Namespace) -> int:
    files, folders, failed = scanned(spark, args.root, not args.non_recursive)
    bad, bad_files = failed.agg(F.count_if(F.col("record_type") == "folder"), F.count_if(F.col("record_type") == "file")).first()
    if args.command == "hash":
        if args.max_file_size:
            files = files.where(F.col("size") <= args.max_file_size)
        contents = file_contents(spark, args.root)
        if args.mode in ("file", "both"):
            name = parse_algorithm(args.algorithm)
            contents = contents.withColumns({"hash_algorithm": F.lit(name), "content_hash": content_hash(F.col("content"), name)})
        if args.mode in ("block", "both"):
            name = parse_algorithm(args.block_algorithm)
            blocks = block_hashes(F.col("content"), args.block_size, name)
            contents = contents.withColumns(
                {
                    "hash_block_size": F.lit(args.block_size),
                    "hash_block_count": block_count(F.col("length"), args.block_size),
                    "block_hash_algorithm": F.lit(name),
                    "block_hashes": blocks,
                }
            )
        files = files.join(contents.drop("content", "length"), "rel_path", "left")
    rows = inventory(files, folders, scan_run(args.root, {"command": args.command, "recursive": not args.non_recursive}))
    if args.output:
        write_inventory(rows, args.output, args.format, not args.folders_only, not args.files_only, args.partitions, append=args.append)
    print(summary_line(scan_statistics(rows, unique_folders=True).withColumns({"folders_failed": F.lit(bad), "files_failed": F.lit(bad_files)}).first(), args.command))
    return 2 if bad or bad_files else 0


def side(spark: SparkSession, root: str | None, scan: str | None) -> DataFrame:
    if root:
        rows = file_tree(spark, root).where(F.col("record_type") == "file")
        return rows.withColumn("data_hash", F.lit(0).cast("long"))
    return read_scan_csv(spark, scan)


def do_diff(spark: SparkSession, args: argparse.Namespace) -> int:
    live, scans = (args.source, args.target), (args.source_scan, args.target_scan)
    if any(live) == any(scans) or not (all(live) or all(scans)):
        raise SystemExit("give either --source and --target or --source-scan and --target-scan")
    if args.summary_only and args.output:
        raise SystemExit("--summary-only excludes --output")
    source = side(spark, args.source, args.source_scan)
    # A folder that could not be listed says nothing of what is only at the target.
    unread = args.source and file_tree(spark, args.source).where("record_type = 'folder' and failed").count()
    rows = diff(source, side(spark, args.target, args.target_scan), args.mode, source_complete=not unread)
    if args.output:
        diff_csv(rows).coalesce(1).write.mode("overwrite").options(header=True, escape='"').csv(args.output)
    if args.folder_report:
        folder_diff(rows).orderBy("rel_path").coalesce(1).write.mode("overwrite").options(header=True, escape='"').csv(args.folder_report)
    print(summary_line(diff_summary(rows).first(), "diff"))
    return 0


def do_sites(spark: SparkSession, args: argparse.Namespace) -> int:
    """A diff over two sites: one sends its rows as a table, the other answers with a row a folder."""
    sent, answer = f"{args.exchange}/sent", f"{args.exchange}/answer"
    files = side(spark, args.root, None)
    if args.command == "diff-target":
        folder_answer(spark.read.parquet(sent), files, args.mode).write.mode("overwrite").parquet(answer)
        print(summary_line(answer_summary(spark.read.parquet(answer)).first(), args.command))
        return 0
    compact(files).write.mode("overwrite").parquet(sent)
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{answer}/_SUCCESS")
    store = done.getFileSystem(spark._jsc.hadoopConfiguration())
    until = time.time() + args.wait_seconds
    while not store.exists(done):
        if time.time() >= until:
            print(f"{args.command} sent={sent}")
            return 0
        time.sleep(0.5)
    folders = spark.read.parquet(answer)
    if args.folder_report:
        folders.orderBy("rel_path").coalesce(1).write.mode("overwrite").options(header=True, escape='"').csv(args.folder_report)
    row = answer_summary(folders).first()
    print(summary_line(row, args.command))
    return 2 if row["files_failed"] else 0


def do_sync(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.chunks:
        files = file_tree(spark, args.source).where((F.col("record_type") == "file") & ~F.col("failed"))
        files = files.join(file_contents(spark, args.source).select("rel_path", "content"), "rel_path")
        send_chunks(files.withColumn("file_id", F.xxhash64("rel_path")), args.chunks)
        print(f"{args.command} chunks={args.chunks}")
        return 0
    config = SyncConfig(max_retries=args.max_retries, skip_verify=args.skip_verify, compare_mode=args.mode)
    totals = sync(spark, args.source, args.target, config, dry_run=args.command == "dry-run")
    print(" ".join([args.command, *(f"{k}={v}" for k, v in totals.items())]))
    return 2 if totals["files_failed"] or totals["folders_failed"] else 0


def do_receive(spark: SparkSession, args: argparse.Namespace) -> int:
    answers = cut_lineage(receive_chunks(spark, args.chunks, args.root))
    states = acknowledged(spark.read.parquet(f"{args.chunks}/files"), answers)
    row = states.agg(
        *[F.count_if(F.col("state") == s).alias(n) for s, n in (("done", "files_written"), ("failed", "files_failed"), ("awaiting_ack", "files_incomplete"))]
    ).first()
    print(summary_line(row, args.command))
    return 2 if row["files_failed"] or row["files_incomplete"] else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    if args.config:
        given = Config.load(args.config).section("defaults", args.command)
        chosen = next(a for a in top._actions if isinstance(a, argparse._SubParsersAction)).choices[args.command]
        chosen.set_defaults(**{k.replace("-", "_"): v for k, v in given.items()})
        args = top.parse_args(argv)
    if args.command == "status":
        told = {k: json.dumps(v) if isinstance(v, str) and not v.isprintable() or " " in str(v) else v for k, v in read_status(args.file).items()}
        print(" ".join(["status", *(f"{k}={v}" for k, v in told.items())]))
        return 0
    spark = spark or SparkSession.builder.appName("grovespark").getOrCreate()
    with Running(args.status, args.command) as run:
        code = do_command(spark, args)
        run.tell(exit_code=code)
    return code


def do_command(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command in ("scan", "hash"):
        return do_scan(spark, args)
    if args.command == "diff":
        return do_diff(spark, args)
    if args.command in ("dry-run", "sync", "send", "copy"):
        return do_sync(spark, args)
    if args.command == "receive":
        return do_receive(spark, args)
    if args.command in ("diff-source", "diff-target"):
        return do_sites(spark, args)
    if args.command in ("generate", "benchmark-metadata-writer"):
        files = generated_files(spark, args.files, args.folders, args.average_size, args.seed, args.root)
        folders = generated_folders(spark, args.files, args.folders, args.average_size, args.root)
        began = time.time()
        write_inventory(inventory(files, folders), args.output, args.format, partitions=args.partitions)
        n, seconds = args.files + args.folders, time.time() - began
        print(f"{args.command} records={n} seconds={seconds:.3f} records_per_second={n / max(seconds, 1e-9):.0f}")
        return 0
    if args.command == "incremental":
        rows = subtree(file_tree(spark, args.root), "").where(F.col("record_type") == "file")
        changed = changed_since(rows, spark.read.parquet(args.previous).where(F.col("record_type") == "file"))
        write_inventory(inventory(changed, run=scan_run(args.root, {"command": "incremental"})), args.output)
        return 0
    return do_benchmark(spark, args)


def noop(rows: DataFrame) -> None:
    rows.write.format("noop").mode("overwrite").save()


def do_benchmark(spark: SparkSession, args: argparse.Namespace) -> int:
    """Rates of one step each, with what it makes thrown away."""
    began = time.time()
    if args.command in ("benchmark-hash", "hash-speed", "benchmark-transport", "transport-speed"):
        data = generated_buffers(spark, args.buffers, args.bytes, args.kind, ratio=args.compression_ratio)
        hashing = args.command in ("benchmark-hash", "hash-speed")
        noop(data.select(content_hash(F.col("data"), args.algorithm)) if hashing else data.repartition("id"))
        rate = args.buffers * args.bytes / 1e9 / max(1e-9, time.time() - began)
        print(f"{args.command} buffers={args.buffers} gb_per_second={rate:.3f}")
        return 2 if hashing and rate < args.minimum_gb_per_second else 0
    if args.command == "benchmark-fake-diff":
        rows = generated_files(spark, args.files, args.folders)
        said = diff_summary(diff(rows, rows))
    else:
        files = size_capped(scanned(spark, args.root, True)[0], args.max_file_size)
        if args.command == "benchmark-meta":
            said = scan_statistics(files, unique_folders=True)
        elif args.command == "benchmark-open":
            said = open_probe(files, args.root).agg(
                F.count_if("opened").alias("files_opened"), F.count_if(~F.col("opened")).alias("files_failed"), F.max("latency_ns").alias("max_latency_ns")
            )
        else:
            contents = file_contents(spark, args.root)
            if args.command == "benchmark-data-hash":
                noop(contents.select(content_hash(F.col("content"), args.algorithm)))
            # Asks for the bytes, not only for their number.
            read = contents.select("rel_path", F.octet_length("content").alias("length"))
            said = read_totals(files, read)
    row = said.first()
    print(f"{summary_line(row, args.command)} seconds={time.time() - began:.3f}")
    return 2 if row.asDict().get("files_failed") else 0


if __name__ == "__main__":
    sys.exit(main())
