"""URL filtering: longest-matching rules first, then a Bloom filter cascade over hosts.

The cascade answers whether a host or one of its parent domains is listed. Its first level encodes the listed keys; the second
the other keys of the corpus that the first one passes by mistake; the third the listed keys that the second one passes, and so on
until nothing is passed by mistake. Over the keys it was built for, here every domain suffix of every host in the corpus, it
is exact, and a row is judged by expressions alone, without a join.

Edge cases: a null url or one without ``://`` has an empty host and path and no rule, and is allowed; an empty list allows all;
repeated rows are judged each for itself; letter case counts in paths and not in hosts.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadaspark.sources.scratch import keep

BITS_A_KEY = 12
PROBES = 5
# One level's filter may hold this many bits (8 MB); a longer list is looked up by a join instead.
MOST_BITS = 1 << 26


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, "[.]")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


@dataclass(frozen=True)
class Rule:
    """``host`` with its subdomains and a path prefix."""

    verdict: str
    host: str
    path: str

    def fits(self, host: Column, path: Column) -> Column:
        inside = (host == self.host) | host.endswith(f".{self.host}")
        return inside & path.startswith(self.path)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host + r.path)):
        found = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(r.fits(host, path), found).otherwise(out)
    return out


class Level:
    """One Bloom filter as an expression: words of 64 bits in an array literal."""

    def __init__(self, number: int, bits: int, words: dict[int, int]) -> None:
        self.number, self.bits = number, bits
        filled = ",".join(str(words.get(i, 0)) for i in range(bits // 64))
        self.words = F.split(F.lit(filled), ",").cast("array<bigint>")

    def holds(self, key: Column) -> Column:
        out = F.lit(True)
        for p in places(key, self.number, self.bits):
            word = F.get(self.words, F.shiftright(p, 6).cast("int"))
            out = out & (word.bitwiseAND(bit(p)) != 0)
        return out


def places(key: Column, number: int, bits: int) -> list[Column]:
    """Where a key sets its bits: two hashes of the key and the level, stepped."""
    wide = F.lit(1 << 31).cast("bigint")
    first, second = (F.pmod(F.xxhash64(key, F.lit(2 * number + i)), wide) for i in range(2))
    return [F.pmod(first + second * F.lit(j), F.lit(bits).cast("bigint")) for j in range(PROBES)]


def bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))


class Cascade:
    """Levels built over ``keys`` (key string, listed boolean): the complete universe, each key once."""

    def __init__(self, keys: DataFrame) -> None:
        keys = keep(keys.select("key", "listed"), "url-keys")
        self.levels: list[Level] = []
        self.listed: DataFrame | None = None
        counts = {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count("*").alias("n")).collect()}
        number, mine, others = 0, keys.where("listed"), keys.where("not listed")
        n = counts.get(True, 0)
        while n:
            bits = max(64, 1 << (n * BITS_A_KEY - 1).bit_length())
            if bits > MOST_BITS:
                self.levels, self.listed = [], keys.where("listed").select("key")
                return
            at = mine.select(F.explode(F.array(*places(F.col("key"), number, bits))).alias("p"))
            words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit(F.col("p"))).alias("b"))
            level = Level(number, bits, {r["w"]: r["b"] for r in words.collect()})
            self.levels.append(level)
            mine, others = others.where(level.holds(F.col("key"))), mine
            n = mine.count()
            number += 1

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the first level without it decides."""
        if not self.levels:
            return F.lit(False)
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(level.holds(key), out).otherwise(F.lit(level.number % 2 == 1))
        return out


def domain_keys(urls: DataFrame, url: str = "url") -> DataFrame:
    """Every domain suffix of every host, each once."""
    hosts = urls.select(host_of(F.col(url)).alias("host")).distinct()
    return hosts.select(F.explode(suffixes(F.col("host"))).alias("key")).distinct()


def judge(urls: DataFrame, cascade: Cascade, rules: list[Rule], url: str = "url") -> DataFrame:
    """All columns of ``urls`` in a struct ``row``, and host, path, rule and verdict."""
    parsed = urls.select(F.struct(*[F.col(f"`{c}`") for c in urls.columns]).alias("row"), F.col(url).alias("url"))
    parsed = parsed.select("row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if cascade.listed is not None:
        listed = cascade.listed.select("key", F.lit(True).alias("hit"))
        hosts = parsed.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("key"))
        bad = hosts.join(listed, "key").select("host").distinct().select("host", F.lit(True).alias("listed"))
        parsed = parsed.join(bad, "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    else:
        parsed = parsed.withColumn("listed", F.exists(suffixes(F.col("host")), cascade.holds))
    ruled = parsed.withColumn("found", longest_rule(rules, F.col("host"), F.col("path")))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return ruled.select("row", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))
