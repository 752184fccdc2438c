"""URL filter: a cascade of Bloom filters that is exact on the corpus's own keys.

A rule is a host and a path prefix. A url's candidate keys are every suffix of
its host at a label boundary joined with every prefix of its path that is as
long as some rule's path. The cascade tells for each candidate whether it is
listed: level 0 holds the listed keys, level 1 the corpus's candidates that
level 0 lets through by mistake, level 2 the listed keys that level 1 holds by
mistake, and so on until a level makes no mistake. As the universe of candidates
is known in full, the answer is exact, and the pages are not joined to the list.

A long list is cut into shards by a hash of the key, each with a cascade of its
own over its part of the universe, so that no filter outgrows a task.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.llm.common import ascii_lower, cut_lineage, free_names, table, without

#: The rules of the production query: (action, host, path prefix).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: A byte of a filter holds seven bits, so that it is a character of one byte that ``ascii`` can read.
BITS = 7
#: Bytes of a filter that make one row on their way to the driver.
SLICE = 4096
#: Bytes of a first level that one shard's cascade has at most, about; later levels hold fewer.
SHARD_BYTES = 8 << 20
#: What a level lets through by mistake at most: with a half a list of 10^7 keys takes 24 levels, with this 8.
RATE = 1 / 8
#: Salts of the hashes that deal keys out to shards, and of the cascade that tells blocking from allowing rules.
SHARD_SALT, BLOCKING = 77, 1000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host in lower case, path). Both empty for null, or where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def candidates(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """All keys that a rule fitting this url can have, longest first; of equal length, the longer host first."""
    labels = F.split(host, r"\.", -1)
    hosts = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    fits = F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(lengths))])
    fits = F.filter(fits, lambda p: p.isNotNull())
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(fits, lambda p: F.struct(
        (-(F.char_length(h) + F.char_length(p))).alias("a"), (-F.char_length(h)).alias("b"), key_of(h, p).alias("key")))))
    return F.transform(F.array_sort(pairs), lambda x: x["key"])


def key_of(host: Column, path: Column) -> Column:
    """A host has no slash, and a rule's path is empty or begins with one: the text tells both."""
    return F.concat(host, path)


class Bloom:
    """One level: a table of one row with the filter's bytes, tested with built-in functions.

    The bytes come into an expression as a scalar subquery: they are read once for
    a query, and stand in no plan, of which Spark keeps texts. ``attach`` names the
    subquery as a column and ``holds`` uses that column once, so that Catalyst puts
    one in place of the other, and no row carries a filter.
    """

    def __init__(self, table: DataFrame, n_bits: int, hashes: int, level: int):
        self.table, self.n_bits, self.hashes, self.level = table, n_bits, hashes, level
        self.name = f"filter_{uuid.uuid4().hex}"

    @staticmethod
    def places(key: Column, n_bits: int, hashes: int, level: int) -> Column:
        return F.array(*[F.pmod(F.xxhash64(F.lit(1000 * level + i), key), F.lit(n_bits)) for i in range(hashes)])

    @staticmethod
    def size(n: int, rate: float) -> tuple[int, int]:
        """(bits, hashes) of a level of so many keys."""
        hashes = max(1, round(-math.log2(rate)))
        return max(64, math.ceil(1.1 * n * hashes / math.log(2))), hashes

    @classmethod
    def build(cls, keys: DataFrame, n: int, rate: float, level: int) -> Bloom:
        """``keys`` has one column, key. Tasks put bits together to bytes, bytes to slices, and one the slices to a filter."""
        n_bits, hashes = cls.size(n, rate)
        n_bytes = n_bits // BITS + 1
        place = keys.select(F.explode(cls.places(F.col("key"), n_bits, hashes, level)).alias("p"))
        bit = F.call_function("shiftleft", F.lit(1), F.pmod("p", F.lit(BITS)).cast("int"))
        set_bits = place.select(F.floor(F.col("p") / BITS).cast("int").alias("byte"), bit.alias("bits"))
        every = keys.sparkSession.range(n_bytes).select(F.col("id").cast("int").alias("byte"), F.lit(0).alias("bits"))
        filled = set_bits.union(every).groupBy("byte").agg(F.bit_or("bits").alias("bits"))
        slices = filled.groupBy(F.floor(F.col("byte") / SLICE).alias("slice")).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("byte", "bits"))), lambda x: F.char(x["bits"])), "").alias("text")
        )
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slice", "text"))), lambda x: x["text"]), "")
        table = cut_lineage(slices.agg(whole.cast("binary").alias("data")))
        if table.select(F.octet_length("data")).first()[0] != n_bytes:
            raise RuntimeError("slices of a filter are missing")
        return cls(table, n_bits, hashes, level)

    def attach(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.name, self.table.scalar())

    def holds(self, key: Column) -> Column:
        """Of a frame that this level is attached to."""

        def bit(p: Column) -> Column:
            byte = F.ascii(F.substring(F.col(self.name), F.floor(p / BITS).cast("int") + 1, F.lit(1)).cast("string"))
            return F.getbit(byte, F.pmod(p, F.lit(BITS)).cast("int")) == 1

        return F.forall(self.places(key, self.n_bits, self.hashes, self.level), bit)


class Cascade:
    """Exact membership for the keys of one universe."""

    def __init__(self, levels: list[Bloom], first: int = 0):
        self.levels, self.first = levels, first

    @staticmethod
    def rate(n_in: int, n_out: int) -> float:
        """Of the first level: so that it lets through about as many of the others as there are listed keys."""
        return min(RATE, max(1e-9, math.sqrt(0.5) * n_in / max(1, n_out)))

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, most: int = 60, first: int = 0) -> Cascade:
        """``listed`` and ``universe`` have one column, key, of distinct keys; listed keys may be in both.

        Each level after the first leaves an eighth. Levels are numbered from ``first`` on, an
        even number, so that cascades have hashes of their own.
        """
        inside, outside = listed, universe
        n_in, n_out = listed.count(), universe.count()
        levels: list[Bloom] = []
        while n_in and len(levels) < most:
            level = Bloom.build(inside, n_in, RATE if levels else cls.rate(n_in, n_out), first + len(levels))
            passed = level.attach(outside).where(level.holds(F.col("key"))).select("key")
            # Of the universe, only what the first level lets through has to be told from the listed keys.
            wrong = cut_lineage(passed if levels else passed.join(listed, "key", "left_anti"))
            levels.append(level)
            inside, outside = wrong, inside
            n_in = wrong.count()
        if n_in:
            raise RuntimeError("the cascade did not end")
        return cls(levels, first)

    def attach(self, df: DataFrame) -> DataFrame:
        return df.withColumns({level.name: level.table.scalar() for level in self.levels}) if self.levels else df

    def holds(self, key: Column) -> Column:
        """Of a frame that the cascade is attached to. The first level that lacks the key decides: an even one says no, an odd one yes."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(~level.holds(key), F.lit((level.level - self.first) % 2 == 1)).otherwise(out)
        return out


ADDED = ("url_host", "url_path", "url_rule", "url_verdict")


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] | DataFrame = RULES,
    url_col: str = "url",
    default: str = "allow",
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Judge every url; returns ``pages`` with ``url_host``, ``url_path``, ``url_rule`` and ``url_verdict``.

    A rule fits its host and all hosts below, where the path starts with the
    rule's; the longest key wins, and of equal ones that with the longer host.
    A url that no rule fits gets a null rule and ``default``: it is not listed.
    Two rules with one host and path are refused; one without either fits nothing.

    One cascade tells which candidates are listed, a second one, over the listed
    keys alone, which of them block. A list whose first level would take more
    than ``shard_bytes`` is cut into shards; each has two cascades, and pages go
    through one shard after the other, with the best rule so far, so a task holds
    one shard's filters.

    Null urls and urls without ``://`` have empty host and path. Very long urls
    are judged whole. Repeated rows are judged one by one; an empty table gives
    an empty result, an empty list lists nothing; other columns pass through, but
    input columns with the added columns' names, other than ``url_col``, are replaced.
    """
    if not isinstance(rules, DataFrame):
        rules = rule_frame(pages.sparkSession, rules)
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    rules = cut_lineage(rules.select("action", key_of(F.col("host"), F.col("path")).alias("key"), F.char_length("path").alias("n")))
    n_rules, n_keys = rules.agg(F.count(F.lit(1)), F.count_distinct("key")).first()
    if n_rules != n_keys:
        raise ValueError("a host and path is listed twice")
    lengths = [n for (n,) in rules.select("n").distinct().collect()] or [0]
    best, one = free_names(pages, "best", "one")
    host, path = split_url(F.col(url_col))
    # Bound once, and not as columns: a column that is named twice would keep the filters' columns below it.
    split = F.array(F.struct(host.alias("host"), path.alias("path")))
    cands = F.flatten(F.transform(split, lambda s: candidates(s["host"], s["path"], lengths)))

    keys = pages.select(host.alias("host"), path.alias("path")).distinct()
    keys = keys.select(F.explode(candidates(F.col("host"), F.col("path"), lengths)).alias("key")).distinct()
    universe = cut_lineage(keys)
    bits, _ = Bloom.size(n_keys, Cascade.rate(max(1, n_keys), universe.count()))
    shards = max(1, -(-(bits // BITS) // shard_bytes))

    def shard(key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(SHARD_SALT), key), F.lit(shards))

    kind = "struct<pos:int,key:string,blocks:boolean>"
    judged = pages.withColumn(best, F.lit(None).cast(kind))
    for number in range(shards):
        own, others = (df.where(shard(F.col("key")) == number) if shards > 1 else df for df in (rules, universe))
        member = Cascade.build(own.select("key"), others)
        blocking = Cascade.build(
            own.where(F.col("action") == "block").select("key"), own.where(F.col("action") != "block").select("key"), first=BLOCKING
        )

        places = F.transform(cands, lambda key, i: F.struct(i.alias("pos"), key.alias("key")))
        in_shard = F.filter(places, lambda x: shard(x["key"]) == number) if shards > 1 else places  # noqa: B023
        hits = F.slice(F.filter(in_shard, lambda x: member.holds(x["key"])), 1, 1)  # noqa: B023
        # One expression names each filter once: see ``Bloom``.
        hits = F.transform(hits, lambda x: F.struct(x["pos"], x["key"], blocking.holds(x["key"]).alias("blocks")))  # noqa: B023
        new = F.get(hits, F.lit(0)).cast(kind)
        filters = [level.name for level in (*member.levels, *blocking.levels)]
        # The smaller place is that of the longer key; null is passed over.
        # A generator of one row, so that the input's own expressions do not mix with the filters' columns.
        judged = blocking.attach(member.attach(judged.select("*", F.explode(F.array(F.lit(True))).alias(one))))
        judged = judged.withColumn(best, F.least(best, new) if number else new).drop(*filters, one)
        if number + 1 < shards:
            judged = cut_lineage(judged)

    verdict = F.when(F.col(best).isNull(), F.lit(default)).when(F.col(best)["blocks"], F.lit("block")).otherwise(F.lit("allow"))
    added = dict(zip(ADDED, (host, path, F.col(best)["key"], verdict), strict=True))
    passed = [c for c in without(pages, *(a for a in ADDED if a != url_col.lower())).columns]
    return judged.select(*[F.col(f"`{c}`") for c in passed], *[c.alias(n) for n, c in added.items() if n != url_col.lower()])


def rule_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(a).alias("action"), F.lit(h).alias("host"), F.lit(p).alias("path")) for a, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select(
        "page_id",
        F.col("url_host").alias("host"),
        F.col("url_path").alias("path"),
        F.col("url_rule").alias("rule"),
        F.col("url_verdict").alias("verdict"),
    )


OP10_SQL = r"""
WITH r(action, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
         ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), a AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM a
)
SELECT page_id, host, path,
       (SELECT rhost || rpath FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        ORDER BY length(rhost || rpath) DESC, length(rhost) DESC LIMIT 1) AS rule,
       coalesce((SELECT action FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        ORDER BY length(rhost || rpath) DESC, length(rhost) DESC LIMIT 1), 'allow') AS verdict
FROM p
"""
