"""URL filter: path rules and a host list behind a Bloom filter cascade.

A url is judged by the longest rule that fits it; without one it is blocked if
its host or a parent domain is on the list. List membership is exact without a
join: level 1 of the cascade is a Bloom filter of the listed keys, level 2 one
of the corpus keys that level 1 takes for listed, level 3 one of the listed keys
that level 2 takes for such, and so on until a level makes no mistake. Because the
levels are built over all keys of the corpus, every key gets the right answer.

Everything is DataFrame and SQL functions: a filter is one array of 64-bit words,
made by ``bit_or`` per word, and enters the probing plan as a scalar subquery. A
filter has about 1.44 * log2(1 / rate) bits a key; with the first rate chosen by
the ratio of listed to other keys, the filters together take a few bytes per
listed key. ``max_bits`` bounds them; a longer list is joined instead.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is not listed; repeated rows are judged alike; an empty table
or list gives a filter that blocks nothing; a host over 253 characters (the
limit of a name) only matches itself, not its parents. Only page_id and url are
read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.llm.common import staged

#: (verdict, rule); the rule's host runs up to its first slash.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/"))
#: Listed hosts: these sites under each of the three domains.
SITES = ("adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
DOMAINS = ("example.com", "example.net", "example.org")
MAX_BITS = 1 << 28
MAX_NAME = 253
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, slash, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def keys_of(host: Column) -> Column:
    """The host and its parent domains; of a host longer than a name can be, itself and the parents that can be names."""
    def parents(name: Column) -> Column:
        parts = F.split(name, r"\.")
        n = F.size(parts)
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))

    # one character more than a name: what stands before its first dot is a label cut in two, or the dot ends one
    tail = F.regexp_extract(F.right(host, F.lit(MAX_NAME + 1)), r"\.(.*)$", 1)
    return (F.when(host == "", F.array().cast("array<string>"))
            .when((F.length(host) > MAX_NAME) & (tail == ""), F.array(host))
            .when(F.length(host) > MAX_NAME, F.concat(F.array(host), parents(tail))).otherwise(parents(host)))


@dataclass
class Cascade:
    """Levels as (words table, bits, hashes); ``listed`` replaces them beyond the size bound."""

    levels: list[tuple[DataFrame, int, int]] = field(default_factory=list)
    listed: DataFrame | None = None

    def filters(self) -> list[Column]:
        """The words of each level, to be bound to columns before ``holds``."""
        return [words.scalar() for words, _, _ in self.levels]

    def holds(self, key: Column, filters: list[Column]) -> Column:
        """Whether a key of the corpus is listed."""
        inner = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            _, bits, hashes = self.levels[i - 1]
            inner = F.when(_hit(key, i, filters[i - 1], bits, hashes), inner).otherwise(F.lit(i % 2 == 0))
        return inner


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    size = F.lit(bits).cast("long")
    a, b = (F.pmod(F.xxhash64(key, F.lit(2 * level + j)), size) for j in (0, 1))
    return [F.pmod(a + b * F.lit(i), size) for i in range(hashes)]


def _bit(pos: Column) -> Column:
    return F.pmod(pos, F.lit(64).cast("long")).cast("int")


def _hit(key: Column, level: int, words: Column, bits: int, hashes: int) -> Column:
    hit = F.lit(True)
    for pos in _positions(key, level, bits, hashes):
        word = F.get(words, F.floor(pos / 64).cast("int"))
        hit = hit & (F.call_function("getbit", word, _bit(pos)) == 1)
    return hit


def _filter(spark: SparkSession, keys: DataFrame, level: int, n: int, rate: float) -> tuple[DataFrame, int, int]:
    bits = 64 * max(1, math.ceil(n * math.log2(1 / rate) / math.log(2) / 64))
    hashes = max(1, round(bits / n * math.log(2)))
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits, hashes))).alias("p"))
    word = at.select(F.floor(F.col("p") / 64).cast("long").alias("w"),
                     F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("p"))).alias("b"))
    zero = spark.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    filled = word.unionByName(zero).groupBy("w").agg(F.bit_or("b").alias("b"))
    one = filled.agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("x")).select(F.col("x.b").alias("words"))
    return staged(one, "bloom"), bits, hashes


def build(keys: DataFrame, listed: DataFrame, max_bits: int = MAX_BITS) -> Cascade:
    """Cascade for the ``key`` column of ``keys`` (all keys of the corpus) and of ``listed``."""
    spark = keys.sparkSession
    wanted = listed.select("key").where("key is not null").distinct().withColumn("listed", F.lit(True))
    universe = staged(keys.select("key").where("key is not null").distinct().join(wanted, "key", "left")
                      .select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "keys")
    n = {r.listed: r.n for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    ins, outs = universe.where("listed").select("key"), universe.where("not listed").select("key")
    n_in, n_out = n.get(True, 0), n.get(False, 0)
    cascade = Cascade()
    if not n_in:
        return cascade
    rate = min(0.5, n_in * math.sqrt(0.5) / max(1, n_out))
    if n_in * math.log2(1 / rate) / math.log(2) > max_bits:
        return Cascade(listed=wanted.select("key"))
    level, rest, encoded, count = 1, outs, ins, n_in
    while count:
        cascade.levels.append(_filter(spark, encoded, level, count, rate if level == 1 else 0.5))
        words, bits, hashes = cascade.levels[-1]
        wrong = staged(rest.where(_hit(F.col("key"), level, words.scalar(), bits, hashes)), "wrong")
        encoded, rest, count, level = wrong, encoded, wrong.count(), level + 1
    return cascade


def default_list(spark: SparkSession) -> DataFrame:
    names = [f"{s}.{d}" for s in SITES for d in DOMAINS]
    return spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("key"))


def judge(pages: DataFrame, listed: DataFrame, *, rules=RULES, max_bits: int = MAX_BITS,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for every row of ``pages``."""
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                        path_of(F.col(url_col)).alias("path"))
    hosts = base.select("host").distinct()
    cascade = build(hosts.select(F.explode(keys_of(F.col("host"))).alias("key")), listed, max_bits)
    if cascade.listed is None:
        names = [f"_level{i}" for i in range(len(cascade.levels))]
        bound = base.withColumns(dict(zip(names, cascade.filters(), strict=True)))
        out = bound.withColumn("listed", F.exists(keys_of(F.col("host")), lambda key: cascade.holds(
            key, [F.col(n) for n in names])) if names else F.lit(False))
    else:
        bad = (hosts.select("host", F.explode(keys_of(F.col("host"))).alias("key"))
               .join(cascade.listed, "key", "left_semi").select("host").distinct().withColumn("hit", F.lit(True)))
        out = base.join(bad, "host", "left").withColumn("listed", F.coalesce("hit", F.lit(False)))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"),
                      "listed")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, rule, rhost, rpath) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'),
  ('block', 'com/de/', 'com', '/de/')),
j AS (
  SELECT p.*, (SELECT r.rule FROM r WHERE (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost))
                 AND starts_with(p.path, r.rpath) ORDER BY length(r.rule) DESC LIMIT 1) AS rule,
         regexp_matches(p.host, '(^|\\.)(adult-x|casino-win|cheap-pills|free-bets|spam-farm)\\.example\\.(com|net|org)$')
           AS listed
  FROM p)
SELECT j.page_id, j.host, j.path, j.rule,
       coalesce(r.verdict, CASE WHEN j.listed THEN 'block' ELSE 'allow' END) AS verdict, j.listed
FROM j LEFT JOIN r ON j.rule = r.rule
"""
