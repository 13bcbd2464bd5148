"""URL filters by a Bloom filter cascade, in DataFrame operations only.

Level 1 is a Bloom filter of the listed keys. Level 2 holds those keys of the corpus that level 1 takes in by
mistake, level 3 the listed keys that level 2 takes in, and so on until a level makes no mistake on the corpus's
complete key universe. For every key of that universe the first level that lacks it tells exactly whether it is
listed, so pages are judged row by row without a join. The filters' size follows the list, not the corpus:
about 1.4 log2(keys/listed) bits a listed key for level 1, and few for the rest; it is checked against a bound.
A filter is one binary literal of the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The base rules (fixed values): key = host + path, and what they say.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
#: Hosts that are blocked, with their subdomains, where no rule fits: the method's own list, a parameter.
LISTED_HOSTS = tuple(f"{name}.example.{top}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
#: Bits in one level at most (some 4.8 MB as a literal, tried in full by a test; some 800,000 keys at the lowest rate); a longer
#: list is refused rather than sent to every task.
MAX_BITS = 1 << 25
#: Bits in a byte of a filter.
PACKED = 7


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null urls and those without ``://``."""
    host = F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column, labels) -> Column:
    """The host's ends of so many labels each, those that it has."""
    n = F.size(F.split(host, r"\."))
    return F.array_compact(F.array(*(F.when(n >= k, F.substring_index(host, ".", -k)) for k in labels)))


def rule_keys(host: Column, path: Column, rules) -> Column:
    """Every host end + path start of the url that has the measures of some rule, longest first."""
    shapes = sorted({(k.split("/", 1)[0].count(".") + 1, len(k) - k.index("/")) for k in rules})
    n = F.size(F.split(host, r"\."))
    made = [F.when((n >= labels) & (F.length(path) >= size), F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, size))) for labels, size in shapes]
    return F.reverse(F.array_sort(F.array_compact(F.array(*made)), lambda a, b: (F.length(a) - F.length(b)).cast("int")))


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    table: bytes

    def has(self, key: Column, number: int) -> Column:
        # one binary literal for all hash functions; a byte of seven bits is an ASCII character
        table, hit = F.lit(self.table), F.lit(True)
        for p in positions(key, number, self.bits, self.hashes):
            byte = F.ascii(F.substring(table, (F.floor(p / PACKED) + 1).cast("int"), F.lit(1)).cast("string"))
            hit = hit & (F.getbit(byte, F.pmod(p, F.lit(PACKED)).cast("int")) == 1)
        return hit


def positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    a = F.pmod(F.xxhash64(F.lit(level), key), F.lit(bits))
    b = F.pmod(F.xxhash64(key, F.lit(level)), F.lit(bits))
    return [F.pmod(a + F.lit(i) * b + F.lit(i * i), F.lit(bits)) for i in range(hashes)]


def build_level(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    if bits > MAX_BITS:
        raise ValueError(f"the list needs a filter of {bits} bits; {MAX_BITS} is the bound")
    hashes = max(1, round(-math.log2(rate)))
    at = keys.select(F.explode(F.array(*positions(F.col("key"), number, bits, hashes))).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1), F.pmod("p", F.lit(PACKED)).cast("int"))
    table = bytearray(bits // PACKED + 1)
    for r in at.groupBy(F.floor(F.col("p") / PACKED).alias("at")).agg(F.bit_or(bit).alias("byte")).toLocalIterator():
        table[r["at"]] = r["byte"]
    return Level(bits, hashes, bytes(table))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def listed(self, key: Column) -> Column:
        """Exact for keys of the universe that the cascade was built over."""
        said = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels), 0, -1):
            said = F.when(self.levels[number - 1].has(key, number), said).otherwise(F.lit(number % 2 == 0))
        return said


def build(universe: DataFrame, listed: DataFrame, rate: float | None = None) -> Cascade:
    """universe (key): all distinct keys of the corpus; listed (key). Null keys count as neither."""
    inside = cut(listed.where("key is not null").distinct())
    outside = universe.where("key is not null").join(inside, "key", "left_anti")
    r, levels = inside.count(), []
    if r == 0:
        return Cascade(())
    if rate is None:
        rate = min(0.5, max(1e-9, r * math.sqrt(0.5) / max(1, universe.count())))
    while True:
        levels.append(build_level(inside, r, rate, len(levels) + 1))
        wrong = cut(outside.where(levels[-1].has(F.col("key"), len(levels))))
        n = wrong.count()
        if not n:
            return Cascade(tuple(levels))
        inside, outside, r, rate = wrong, inside, n, 0.5


def judge(pages: DataFrame, rules: dict[str, str] = RULES, listed_hosts=LISTED_HOSTS) -> DataFrame:
    """pages (page_id, url, ...) -> page_id, host, path, rule, verdict; a row for each row of pages.

    The longest rule whose host the url's host is or lies under, and whose path its path starts with, says
    the verdict; without one, urls under a listed host are blocked and all others allowed. Null urls and
    urls without ``://`` have no host, fit no rule and are allowed. An empty table gives an empty result.
    listed_hosts: names, or a table (host) of them, of whatever length the bound on the filter allows; null hosts
    in it say nothing."""
    spark = pages.sparkSession
    host, path = parts(F.col("url").cast("string"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not isinstance(listed_hosts, DataFrame):
        listed_hosts = spark.createDataFrame([(h,) for h in listed_hosts], "host string")
    named = listed_hosts.select(F.col("host").alias("key")).where("key is not null")
    depths = sorted(r[0] for r in named.select(F.size(F.split("key", r"\."))).distinct().collect()) or [1]
    keyed = urls.withColumn("keys", rule_keys(F.col("host"), F.col("path"), rules)).withColumn("ends", suffixes(F.col("host"), depths))
    universe = cut(keyed.select(F.explode(F.concat("keys", "ends")).alias("key")).distinct())

    def saying(verdict):
        return build(universe, spark.createDataFrame([(k,) for k, v in rules.items() if v == verdict], "key string"))

    block, allow, hosts = saying("block"), saying("allow"), build(universe, named)
    rule = F.get(F.filter("keys", lambda k: block.listed(k) | allow.listed(k)), F.lit(0))
    out = keyed.withColumn("rule", rule)
    listed = F.exists("ends", lambda k: hosts.listed(k))
    verdict = F.when(F.col("rule").isNull(), F.when(listed, "block").otherwise("allow")).when(block.listed(F.col("rule")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def oracle(rules: dict[str, str] = RULES, listed_hosts=LISTED_HOSTS) -> str:
    """DuckDB SQL of the same result."""
    ordered = sorted(rules, key=len, reverse=True)
    under = lambda h: f"(host = '{h}' OR ends_with(host, '.{h}'))"
    fits = {k: f"{under(k.split('/', 1)[0])} AND starts_with(path, '{k[k.index('/') :]}')" for k in ordered}
    rule = "CASE " + " ".join(f"WHEN {fits[k]} THEN '{k}'" for k in ordered) + " END"
    said = "CASE " + " ".join(f"WHEN {fits[k]} THEN '{rules[k]}'" for k in ordered) + " WHEN " + " OR ".join(map(under, listed_hosts)) + " THEN 'block' ELSE 'allow' END"
    return f"""
WITH u AS (SELECT page_id,
  coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, {rule} AS rule, {said} AS verdict FROM u"""
