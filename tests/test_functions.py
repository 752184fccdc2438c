"""Paths, unsigned arithmetic, hashes and controls."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from grovespark.functions import controls, hashing, paths, u64

M = (1 << 64) - 1


def mix(seed, value):
    return seed ^ ((value + 0x9E3779B97F4A7C15 + (seed << 6 & M) + (seed >> 2)) & M)


def xxh(data):
    import xxhash

    return xxhash.xxh64_intdigest(data)


@pytest.mark.parametrize(
    ("path", "normal", "parent", "name"),
    [
        ("//root//a.txt/", "root/a.txt", "root", "a.txt"),
        ("a", "a", "", "a"),
        ("", "", "", ""),
        ("/", "", "", ""),
        ("a/b/../c", "a/b/../c", "a/b/..", "c"),
        ("é/ü.txt", "é/ü.txt", "é", "ü.txt"),
    ],
)
def test_paths(spark, path, normal, parent, name):
    p = paths.normalize_path(F.lit(path))
    row = spark.range(1).select(p, paths.parent_path(p), paths.base_name(p), paths.join_path(paths.parent_path(p), paths.base_name(p))).first()
    assert tuple(row) == (normal, parent, name, normal)


def test_unsigned_arithmetic(spark):
    rng = random.Random(1)
    special = [0, 1, 2, M, M - 1, 1 << 63, (1 << 63) - 1, 1 << 32, (1 << 32) - 1]
    pairs = [(a, b) for a in special for b in special] + [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(500)]
    rows = [(i, u64.signed(a), u64.signed(b)) for i, (a, b) in enumerate(pairs)]
    a, b = F.col("a"), F.col("b")
    prime = hashing.METADATA_PRIME
    got = spark.createDataFrame(rows, "i int, a long, b long").select(
        "i", u64.add64(a, b), u64.mul64(a, prime), u64.mix64(a, b), u64.splitmix64(a), u64.umod(a, 2048), u64.unsigned(a), u64.from_unsigned(u64.unsigned(a))
    )

    def split(x):
        z = (x + 0x9E3779B97F4A7C15) & M
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & M
        z = (z ^ z >> 27) * 0x94D049BB133111EB & M
        return z ^ z >> 31

    for i, *values in got.collect():
        x, y = pairs[i]
        want = [u64.signed(v) for v in (x + y, x * prime, mix(x, y), split(x))] + [x % 2048, x, u64.signed(x)]
        assert [int(v) for v in values] == want
    frame = spark.createDataFrame(rows, "i int, a long, b long")
    assert [r["i"] for r in frame.orderBy(u64.unsigned_key(a), "i").collect()] == sorted(range(len(pairs)), key=lambda i: (pairs[i][0], i))
    assert frame.agg(u64.sum64(a)).first()[0] == u64.signed(sum(x for x, _ in pairs))
    assert frame.where("false").agg(u64.sum64(a)).first()[0] == 0


VECTORS = {
    "xxh64": [(b"", "ef46db3751d8e999"), (b"hello", "26c7827d889f6da3"), (b"abcdefghijklmnopqrstuvwxyz", "cfe1f278fa89835c"), (b"x" * 1_000_000, "16c7c43f6b9adc14")],
    "md5": [(b"abc", "900150983cd24fb0d6963f7d28e17f72")],
    "sha256": [(b"abc", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")],
    "xxh3_64": [(b"abc", "78af5f94892f3950")],
    "xxh3_128": [(b"abc", "06b05ab6733a618578af5f94892f3950")],
}


@pytest.mark.parametrize("algorithm", sorted(VECTORS))
def test_digests(spark, algorithm):
    rows = [(bytearray(data), digest) for data, digest in VECTORS[algorithm]] + [(None, None)]
    got = spark.createDataFrame(rows, "data binary, want string").select(hashing.content_hash(F.col("data"), algorithm), "want").collect()
    assert all(a == b for a, b in got)


def test_block_hashes(spark):
    md5 = lambda b: hashlib.md5(b).hexdigest()
    frame = spark.createDataFrame([(bytearray(b"alpha"),), (bytearray(b""),), (bytearray(b"abcd"),), (None,)], "data binary")
    for algorithm in ("md5", "sha256", "xxh64"):
        got = [r[0] for r in frame.select(hashing.block_hashes(F.col("data"), 4, algorithm)).collect()]
        assert got[1] == "" and got[0].count(";") == 1 and got[2].count(";") == 0 and got[3] is None
    got = [tuple(r) for r in frame.select(hashing.block_hashes(F.col("data"), 4), hashing.block_count(F.octet_length("data"), 4)).collect()]
    assert got[:3] == [(f"{md5(b'alph')};{md5(b'a')}", 2), ("", 0), (md5(b"abcd"), 1)]


def test_algorithm_names():
    assert [hashing.parse_algorithm(n) for n in ("sha-256", "xxh3", "xxh128", "MD5", "xxhsum")] == ["sha256", "xxh3_64", "xxh3_128", "md5", "xxh64"]
    with pytest.raises(ValueError):
        hashing.parse_algorithm("crc32")


def test_identities(spark):
    def folder(path):
        out = 0
        for part in [p for p in path.split("/") if p]:
            out = mix(xxh(part.encode()), out)
        return out

    names = ["a.txt", "x/a.txt", "x/y/é.txt", "//x//y/z/"]
    got = hashing.with_identity(spark.createDataFrame([(n,) for n in names], "rel_path string")).collect()
    for r in got:
        normal = "/".join(p for p in r["rel_path"].split("/") if p)
        parent, _, name = normal.rpartition("/")
        assert r["folder_hash"] == u64.signed(folder(parent))
        assert r["file_hash"] == u64.signed(mix(xxh(name.encode()), folder(parent))) == u64.signed(folder(normal))
    assert spark.range(1).select(hashing.folder_hash(F.lit("/"))).first()[0] == 0


def test_folder_hashes(spark):
    rng = random.Random(3)
    rows = [(f"f{i % 3}", u64.signed(rng.getrandbits(64)), u64.signed(rng.getrandbits(64)), i) for i in range(200)] + [("f0", 5, 6, 7), ("f0", 5, 6, 7)]
    frame = spark.createDataFrame(rows, "folder string, file_hash long, data_hash long, size long").repartition(3)
    data = {r[0]: r[1] for r in hashing.folder_data_hash(frame, "folder").collect()}
    meta = {
        r[0]: r[1]
        for r in hashing.folder_metadata_hash(frame.withColumns({"child_hash": F.col("file_hash"), "is_file": F.col("size") % 2 == 0}), "folder").collect()
    }
    for name in ("f0", "f1", "f2"):
        own = [r for r in rows if r[0] == name]
        out = hashing.DATA_SEED
        for f, d in sorted((r[1] & M, r[2] & M) for r in own):
            out = mix(mix(out, f), d)
        assert data[name] == u64.signed(out)
        files = [r for r in own if r[3] % 2 == 0]
        x = s = 0
        for r in own:
            x, s = x ^ (r[1] & M), (s + (r[1] & M) * hashing.METADATA_PRIME) & M
        out = hashing.METADATA_SEED
        for v in (len(files), len(own) - len(files), sum(r[3] for r in files), x, s):
            out = mix(out, v)
        assert meta[name] == u64.signed(out)


def test_child_hash(spark):
    args = [F.lit(u64.signed(xxh(b"n"))), F.lit(True), F.lit(5), F.lit(7), F.lit(420), F.lit(1), F.lit(2)]
    out = {}
    for mode in ("size", "time", "content", "metadata"):
        want = mix(mix(xxh(b"n"), 1), 5)
        for v in {"size": (), "metadata": (7, 420, 1, 2)}.get(mode, (7,)):
            want = mix(want, v)
        out[mode] = spark.range(1).select(hashing.child_hash(*args, mode)).first()[0]
        assert out[mode] == u64.signed(want)
    assert out["time"] == out["content"] and len(set(out.values())) == 3


def test_chunk_hash32(spark):
    h = xxh(b"hello")
    assert spark.range(1).select(hashing.chunk_hash32(F.lit("hello"))).first()[0] == (h ^ h >> 32) & 0xFFFFFFFF


@pytest.mark.parametrize(
    ("ram", "disk", "on"),
    [
        (10.0, 10.0, {"prefetch_to_ram"}),
        (75.0, 50.0, {"soft_throttle"}),
        (90.0, 85.0, {"soft_throttle", "spill_to_disk", "pause_reader"}),
        (96.0, 96.0, {"soft_throttle", "spill_to_disk", "pause_reader", "hard_stop"}),
        (85.0, 20.0, {"soft_throttle"}),
    ],
)
def test_watermarks(spark, ram, disk, on):
    row = spark.range(1).select(*[v.alias(k) for k, v in controls.watermarks(F.lit(ram), F.lit(disk)).items()]).first().asDict()
    assert {k for k, v in row.items() if v} == on


@pytest.mark.parametrize(("ram", "disk"), [(-1.0, 0.0), (0.0, 101.0)])
def test_watermarks_out_of_range(spark, ram, disk):
    frame = spark.createDataFrame([(ram, disk)], "r double, d double")
    with pytest.raises(Exception, match="percentages lie"):
        frame.select(*controls.watermarks(F.col("r"), F.col("d")).values()).collect()


def test_throttles(spark):
    rows = {v: spark.range(1).select(*[c.alias(k) for k, c in controls.throttles(F.lit(v)).items()]).first().asDict() for v in (49, 50, 70, 85)}
    assert rows[49]["receiver_refills"] and not rows[50]["receiver_refills"] and rows[70]["cache_drains"] and rows[70]["reader_resumes"]
    assert rows[85]["cache_spills"] and rows[85]["reader_pauses"] and not rows[85]["reader_resumes"]


def test_moves(spark):
    assert controls.checked_move("sender", "pending", "reading") == "reading"
    assert controls.checked_move("receiver", "done", "done") == "done"
    for role, a, b in (("sender", "done", "reading"), ("receiver", "pending", "reading"), ("sender", "pending", "done")):
        with pytest.raises(ValueError):
            controls.checked_move(role, a, b)
    with pytest.raises(ValueError):
        controls.checked_move("sender", "transferring", "done", controls.FOLDER_MOVES)
    assert controls.moves(spark).count() == sum(len(t) for by in controls.FILE_MOVES.values() for t in by.values())


def bucket(total, done, rate, workers, most, total_bytes=0, done_bytes=0, bytes_rate=0.0):
    return controls.Bucket(total, done, rate, workers, most, total_bytes, done_bytes, bytes_rate)


def test_balance():
    d = controls.balance(bucket(10_000_000, 1_000_000, 30_000, 96, 128), bucket(200_000, 100_000, 2000, 64, 64, 20 * 10**9, 10**10, 2e8))
    assert d.small_eta > d.large_eta and d.small_workers > 96 and d.large_workers < 64 and d.borrow_percent > 0
    d = controls.balance(bucket(1_100_000, 1_000_000, 50_000, 120, 128), bucket(10**7, 10**6, 500, 40, 64, 10**13, 10**12, 5e8))
    assert d.large_eta > d.small_eta and d.large_workers > 40 and d.small_workers < 120 and d.borrow_percent == 0
    d = controls.balance(bucket(5_000_000, 1_000_000, 20_000, 96, 128), bucket(10**6, 10**6, 1000, 64, 64, 10**12, 10**12, 1e9))
    assert (d.large_workers, d.borrow_percent) == (1, 100) and d.small_workers > 96


def test_scanner_split():
    assert [controls.scanner_split(*x) for x in ((96, 16, 8, 0), (96, 16, 8, 1), (96, 6, 8, 75))] == [(96, 16), (104, 8), (96, 6)]


def test_servers():
    assert controls.expand_nfs_url("nfs://172.27.255.2-172.27.255.4/volumes/x") == [f"nfs://172.27.255.{i}/volumes/x" for i in (2, 3, 4)]
    assert controls.expand_nfs_url("nfs://10.0.0.8-10/export") == [f"nfs://10.0.0.{i}/export" for i in (8, 9, 10)]
    assert controls.expand_nfs_url("nfs://172.27.255.2,172.27.255.9-172.27.255.10/e") == [f"nfs://172.27.255.{i}/e" for i in (2, 9, 10)]
    assert controls.expand_nfs_url("nfs://nfs-prod-a/export") == ["nfs://nfs-prod-a/export"]
    assert controls.endpoint_of(5, ["a", "b", "c"]) == "c" and not controls.is_nfs_url("/data")
    for bad in ("10.0.0.9-10.0.0.2", "10.0.0.0-10.1.0.0"):
        with pytest.raises(ValueError):
            controls.expand_servers(bad)


def test_quoting_and_names(spark):
    text = F.col("t")
    frame = spark.createDataFrame([("plain",), ("",), ('a"b',), ("a,b",), ("it's \\ x",)], "t string")
    got = [tuple(r) for r in frame.select(controls.csv_quoted(text), controls.csv_quoted(text, True), controls.text_quoted(text), controls.sql_quoted(text)).collect()]
    assert got[0] == ("plain", "plain", '"plain"', "'plain'")
    assert got[1] == ("", '""', '""', "''")
    assert got[2][:3] == ('"a""b"', '"a""b"', '"a\\"b"') and got[3][0] == '"a,b"'
    assert got[4] == ("it's \\ x", "it's \\ x", '"it\'s \\\\ x"', "'it''s \\ x'")
    row = spark.range(1).select(controls.cache_path(F.lit(0xAB12)), controls.dispatch_connection(F.lit(-1).cast("long"), 7), controls.dispatch_connection(F.lit(5), 0)).first()
    assert tuple(row) == ("00/00/000000000000ab12", M % 7, 0)


def test_splitmix_as_steps_and_unsigned_remainders(spark):
    from grovespark.functions.u64 import signed, splitmix64, umod, with_splitmix64

    values = [0, 1, 123, (1 << 63) - 1, 1 << 63, (1 << 64) - 1, 0x9E3779B97F4A7C15]
    frame = spark.createDataFrame([(signed(v),) for v in values], "x long")
    rows = with_splitmix64(frame, "z", "x").withColumn("w", splitmix64(F.col("x"))).collect()
    assert all(r["z"] == r["w"] for r in rows)
    for by in (1, 7, 2048, (1 << 31) - 1, 1 << 31, (1 << 62) + 5):
        assert [r[0] for r in frame.select(umod(F.col("x"), by)).collect()] == [v % by for v in values]
