"""URL rules by a cascade of Bloom filters, in DataFrame expressions only.

The listed keys (host + path prefix) are held by level 1; level 2 holds those unlisted keys of the corpus that level 1
takes for listed ones; level 3 those listed keys that level 2 takes, and so on until a level has no false positive left.
For every key of the corpus the first level that does not hold it tells membership exactly, so no join is needed.

Level 1 is sized for about as many false positives as there are listed keys, from the counted key universe, and each later level has
some bits per key. Filters travel as binary literals of at most MAX_BITS bits or so: a longer list is taken in blocks, each with a cascade
of its own and a pass over the urls, in the same way at every size.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import LOWER, UPPER, lower_ascii, saved, table

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MAX_BITS, MOST_RULES = 1 << 26, 200_000  # 8 MB
LATER_BITS = 3.0


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; '' for null or without `://`."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; '' for null or without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: bit p is bit p % 8 of byte p // 8."""

    bits: bytes
    size: int
    hashes: int
    seed: int

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed), F.lit(i)), F.lit(self.size)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        data = F.lit(bytearray(self.bits))
        one = lambda p: F.getbit(F.conv(F.hex(F.substring(data, (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long"), (p % 8).cast("int")) == 1
        return functools.reduce(lambda a, b: a & b, map(one, self.places(key)))


def build_level(keys: DataFrame, count: int, bits_per_key: float, seed: int) -> Level:
    """A filter over the column `key` of `keys`. Its bits are gathered by bit_or over 64-bit words: size / 64 rows at most come to the driver."""
    size = max(64, math.ceil(count * bits_per_key / 64) * 64)
    level = Level(b"", size, max(1, round(math.log(2) * size / max(count, 1))) if count * 12 < size else max(1, round(math.log(2) * bits_per_key)), seed)
    level = Level(b"", size, min(level.hashes, 16), seed)
    spots = keys.select(F.explode(F.array(*level.places(F.col("key")))).alias("p"))
    words = spots.groupBy(F.floor(F.col("p") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(p % 64))")).alias("bits"))
    held = bytearray(size // 8)
    for word, bits in words.toLocalIterator():
        held[word * 8 : word * 8 + 8] = (bits & (2**64 - 1)).to_bytes(8, "little")
    return Level(bytes(held), size, level.hashes, seed)


def build_cascade(listed: DataFrame, universe: DataFrame, seed: int = 0) -> list[Level]:
    """Levels that tell members of `listed` (column key) from all other keys of `universe` (column key) exactly."""
    listed = listed.where(F.col("key").isNotNull()).distinct()
    members = listed.count()
    if not members:
        return []
    others = universe.where(F.col("key").isNotNull()).distinct().join(listed, "key", "left_anti")
    total = others.count()
    sides, counts, levels = [listed, others], [members, total], []
    while counts[0]:
        per_key = LATER_BITS + len(levels) / 8 if levels else bits_per_key(members, total)  # more and more, so that it ends
        levels.append(build_level(sides[0], counts[0], per_key, seed * 1000 + len(levels)))
        taken = sides[1].where(levels[-1].holds(F.col("key")))
        sides, counts = [taken, sides[0]], [taken.count(), counts[0]]
    return levels


def bits_per_key(members: int, others: int) -> float:
    """For about as many false positives as there are members."""
    return max(LATER_BITS, math.log2(max(2.0, others / members)) / math.log(2))


def member(levels: list[Level], key: Column) -> Column:
    """Whether `key`, one of the universe, is listed: the first level without it decides."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(~levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def judge_urls(df: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """A verdict for every row of `df`: id, host, path, rule (host + path of the longest rule that fits, else null), verdict.

    A rule fits its host and all subdomains if the url's path starts with the rule's path; of several the longest wins, then the one with the
    longer host. Without a rule a url is not listed, which means allow. Null urls and urls without `://` have an empty host and path and fit no rule.
    Only as many trailing labels of a host and leading characters of a path are looked up as some rule has, so long urls cost
    no more than short ones. Repeated rows and null ids stay; an empty table or no rules are fine; other columns of `df` are not read.
    """
    rules = [(v, h.translate(str.maketrans(UPPER, LOWER)), p) for v, h, p in rules]
    if bad := [r for r in rules if r[0] not in ("block", "allow") or not r[1] or "\x02" in r[1] + r[2]]:
        raise ValueError(f"not a rule: {bad[0]}")
    if len({(h, p) for _, h, p in rules}) < len(rules):
        raise ValueError("two rules for one host and path")
    spark = df.sparkSession
    urls = df.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    if not rules:
        return urls.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    # a key is host, \x01, path: \x01 keeps (a, b/c) and (ab, /c) apart, whatever a rule says
    key = lambda n, m: F.when(F.length("path") >= m, F.concat(F.substring_index("host", ".", -n), F.lit("\x01"), F.substring("path", 1, m)))
    keyed = urls.withColumn("keys", F.array_distinct(F.array_compact(F.array(*[key(n, m) for n in labels for m in lengths]))))
    universe = saved(keyed.select(F.explode("keys").alias("key")).distinct())
    size = max(1, min(MOST_RULES, int(MAX_BITS / bits_per_key(1, universe.count()))))
    lists = {v: [f"{h}\x01{p}" for w, h, p in rules if w == v] for v in ("block", "allow")}
    blocks = max(-(-len(x) // size) for x in lists.values())
    judged = keyed.withColumn("best", F.lit(None).cast("struct<n: int, m: int, key: string, verdict: string>"))
    for b in range(blocks):
        fits = [F.array("best")]
        for i, (verdict, listed) in enumerate(lists.items()):
            if own := listed[b * size : (b + 1) * size]:
                keys = spark.range(1).select(F.explode(F.split(F.lit("\x02".join(own)), "\x02")).alias("key"))
                fits.append(_fits(verdict, build_cascade(keys, universe, 2 * b + i)))
        judged = judged.withColumn("best", F.array_max(F.concat(*fits)))
        judged = saved(judged) if b + 1 < blocks else judged
    return judged.select(F.col("id").alias(id_col), "host", "path", F.replace(F.col("best.key"), F.lit("\x01"), F.lit("")).alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def _fits(verdict: str, levels: list[Level]) -> Column:
    told = lambda k: F.struct(F.length(k).alias("n"), F.length(F.substring_index(k, "\x01", 1)).alias("m"), k.alias("key"), F.lit(verdict).alias("verdict"))
    return F.transform(F.filter("keys", lambda k: member(levels, k)), told)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page."""
    return judge_urls(table(spark, sf_dir, "pages"))


OP7_SQL = r"""
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
SELECT u.page_id, u.host, u.path,
  (SELECT rhost || rpath FROM r WHERE (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath) ORDER BY length(rhost || rpath) DESC LIMIT 1) AS rule,
  coalesce((SELECT r.verdict FROM r WHERE (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath) ORDER BY length(rhost || rpath) DESC LIMIT 1), 'allow') AS verdict
FROM u
"""
