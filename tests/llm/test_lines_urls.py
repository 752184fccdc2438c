"""Line dedup and url filter against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from grovespark.llm.linededup import dedup_lines
from grovespark.llm.urlcascade import ADDED, RULES, Bloom, Cascade, filter_urls, rule_frame

BLANKS = " \t\n\x0b\f\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def line_key(line):
    return line.strip(BLANKS).translate(LOWER)


def brute_lines(rows, min_docs=2):
    owners = {}
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key := line_key(line)) >= 10:
                owners.setdefault(key, set()).add(doc)
    out = []
    for doc, text, *_ in rows:
        kept = []
        lines = (text or "").split("\n")
        for line in lines:
            who = owners.get(line_key(line), ())
            first = min((d for d in who if d is not None), default=None)
            if len(who) < min_docs or doc == first:
                kept.append(line)
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def test_lines_as_brute_force(docs, rows):
    got = [tuple(r) for r in dedup_lines(docs).select("doc_id", "text", "dedup_n_lines", "dedup_n_dropped").collect()]
    assert sorted(got, key=key) == sorted(brute_lines(rows), key=key)
    assert sum(r[3] for r in got) >= 4


def test_lines_with_other_bounds_and_clashing_names(docs, rows):
    odd = docs.withColumns({"id": F.lit(1), "k1": F.lit("x"), "pos": F.lit(2), "gone": F.lit(3), "first": F.lit(4), "t1": F.lit(5), "lines": F.lit(6), "T2": F.lit(7), "d1": F.lit(8)})
    got = dedup_lines(odd, min_docs=3)
    assert got.columns == [*odd.columns, "dedup_n_lines", "dedup_n_dropped"]
    found = [tuple(r) for r in got.select("doc_id", "text", "dedup_n_lines", "dedup_n_dropped").collect()]
    assert sorted(found, key=key) == sorted(brute_lines(rows, 3), key=key)


def test_no_lines(no_docs):
    assert dedup_lines(no_docs).count() == 0


def brute_url(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:cut].translate(LOWER), rest[cut:]
        path = rest[: min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


URLS = [
    None, "", "no host", "://", "http://net", "http://net/", "http://NET/x?y", "https://a.b.example.net/en/1", "https://example.net/en",
    "https://example.net/de/1", "http://org/fr/", "http://x.org/fr?", "http://org.fr/fr/", "http://notnet/", "http://a.net#x/", "x://EXAMPLE.com/de/#",
    "http://u:p@www.example.com:80/de/", "http://example.com/DE/", "http://..net/", "http://é.org/fr/é",
]


def test_urls_as_brute_force(spark):
    urls = URLS * 3
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"key": F.lit(1), "host": F.lit("h")})
    got = {r["page_id"]: (r["url_host"], r["url_path"], r["url_rule"], r["url_verdict"]) for r in filter_urls(pages).collect()}
    assert got == {i: brute_url(u, RULES) for i, u in enumerate(urls)}


@pytest.mark.parametrize("shard_bytes", [1 << 20, 40])
def test_many_rules_in_one_shard_and_in_several(spark, shard_bytes):
    rng = random.Random(5)
    hosts = [f"h{i}.example.{t}" for i in range(40) for t in ("com", "net", "org")]
    rules = [(rng.choice(("block", "allow")), h, rng.choice(("/", "/a/", "/ab"))) for h in rng.sample(hosts, 60)]
    urls = [f"http://{rng.choice(('', 'www.', 'x.y.'))}{rng.choice(hosts)}{rng.choice(('', '/', '/a/b', '/abc', '/c?d'))}" for _ in range(600)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = {i: brute_url(u, rules) for i, u in enumerate(urls)}
    judged = filter_urls(pages, rules, shard_bytes=shard_bytes)
    got = {r["page_id"]: (r["url_host"], r["url_path"], r["url_rule"], r["url_verdict"]) for r in judged.collect()}
    assert got == want


def test_a_filter_is_put_together_in_tasks(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    level = Bloom.build(keys, 3000, 0.01, 0)
    bits, hashes = Bloom.size(3000, 0.01)
    data = bytes(level.table.first()["data"])
    assert hashes == 7 and len(data) == bits // 7 + 1 and max(data) < 128
    assert level.attach(keys).where(~level.holds(F.col("key"))).count() == 0
    others = spark.range(10_000, 30_000).select(F.concat(F.lit("k"), "id").alias("key"))
    assert level.attach(others).where(level.holds(F.col("key"))).count() < 0.03 * 20_000


def outputs(plan):
    """Names of the columns of each node of a plan."""
    yield from (plan.output().apply(i).name() for i in range(plan.output().size()))
    for i in range(plan.children().size()):
        yield from outputs(plan.children().apply(i))


@pytest.mark.parametrize(("shard_bytes", "made"), [(1 << 20, False), (1 << 20, True), (4, True)])
def test_no_row_carries_a_filter(spark, shard_bytes, made):
    pages = spark.createDataFrame([(i, f"http://www.h{i}.net/x") for i in range(40)], "page_id long, url string")
    if made:
        pages = spark.range(40).select(F.col("id").alias("page_id"), F.concat(F.lit("http://www.h"), F.col("id").cast("string"), F.lit(".net/x")).alias("url"))
    rules = [("block" if i % 2 else "allow", f"h{3 * i}.net", "/") for i in range(30)]
    judged = filter_urls(pages, rules, shard_bytes=shard_bytes)
    for frame in (judged, judged.where("url_verdict = 'block'").select("page_id"), judged.groupBy("url_rule").count()):
        plan = frame._jdf.queryExecution().optimizedPlan()
        assert not [n for n in outputs(plan) if n.startswith("filter_") or n == "data"]
        assert len(plan.toString()) < 100_000


def test_clashing_columns_and_awkward_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    odd = pages.withColumns({"URL_host": F.lit("mine"), "best": F.lit(1), "h": F.lit(2), "hit": F.lit(3), "key": F.lit(4)})
    got = filter_urls(odd)
    assert got.columns == ["page_id", "url", "best", "h", "hit", "key", *ADDED]
    rows = {r["page_id"]: r for r in got.collect()}
    assert tuple(rows[1])[2:] == (1, 2, 3, 4, "a.net", "/x", "net/", "block") and tuple(rows[2])[6:] == ("", "", None, "allow")
    assert [r["url_verdict"] for r in filter_urls(pages, rule_frame(spark, [("block", "a.net", "/")]).where("false")).collect()] == ["allow"] * 2
    nulls = spark.createDataFrame([("block", None, "/"), ("block", None, "/"), ("block", "net", "/")], "action string, host string, path string")
    assert {r["page_id"]: r["url_rule"] for r in filter_urls(pages, nulls).collect()} == {1: "net/", 2: None}


def test_cascade_is_exact(spark):
    listed = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    others = spark.range(500, 20000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = Cascade.build(listed, others)
    assert len(cascade.levels) > 1
    assert cascade.attach(listed).where(~cascade.holds(F.col("key"))).count() == 0
    assert cascade.attach(others).where(cascade.holds(F.col("key"))).count() == 0


def test_rules_listed_twice_and_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(none).count() == 0
    with pytest.raises(ValueError):
        filter_urls(none, [("block", "a", "/"), ("allow", "a", "/")])


def test_hash_of_kept_text(docs):
    row = dedup_lines(docs).where("doc_id = 3").first()
    assert (row["text"], row["dedup_n_lines"], row["dedup_n_dropped"]) == ("", 1, 0)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
