"""URL filters: prefix rules, and listed keys in a cascade of Bloom filters.

The first filter of the cascade encodes the listed keys, the second those other keys of the corpus
that the first one lets through by mistake, the third the listed keys that pass the second, and so
on until nothing passes by mistake. For every key of the universe the first filter that
rejects it tells exactly whether it is listed.

Executors build a filter's words by ``bit_or`` of their keys' bits and write them as a table. A lookup reads them as a
scalar subquery, one array, and is arithmetic in the scan's stage: no join, no shuffle, no Python, and nothing in
the plan but the subquery. Spark holds one array of at most ``MOST_BITS`` / 8 bytes per level.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uptake.llm.chunks import written

_PASS = 1 / 32
MOST_BITS = 1 << 28
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host after the first ``://`` (A-Z lower-cased) and the path behind it; empty without one."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def longest_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, NULL where none does.

    ``rules`` are (verdict, host, path); a rule fits its host and all subdomains where the path
    starts with the rule's. Of rules of equal length the first given counts.
    """
    rule = verdict = F.lit(None).cast("string")
    ordered = sorted(enumerate(rules), key=lambda r: (len(r[1][1]) + len(r[1][2]), -r[0]))
    for _, (says, at, below) in ordered:
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(below))
        rule = F.when(fits, F.lit(at + below)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


class Level:
    """One Bloom filter, as a table of 64-bit words and a subquery that makes them an array."""

    def __init__(self, number: int, keys: DataFrame, count: int, rate: float):
        self.number, self.hashes = number, max(1, round(-math.log2(rate)))
        self.bits = 64 * math.ceil((count * self.hashes / math.log(2) + 1) / 64)
        if self.bits > MOST_BITS:
            raise ValueError(f"a filter of {self.bits} bits is more than a task should hold ({MOST_BITS})")
        position = F.explode(F.array(*self._positions(F.col("key")))).alias("p")
        ones = keys.select(position).select(
            F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p % 64 AS int))").alias("bits"))
        zeros = keys.sparkSession.range(self.bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        words = written(ones.unionByName(zeros).groupBy("word").agg(F.bit_or("bits").alias("bits")))
        ordered = F.sort_array(F.collect_list(F.struct("word", "bits")))
        self.words = words.agg(F.transform(ordered, lambda w: w["bits"])).scalar()

    def _positions(self, key: Column):
        one = F.pmod(F.xxhash64(key, F.lit(2 * self.number)), F.lit(self.bits))
        two = F.pmod(F.xxhash64(key, F.lit(2 * self.number + 1)), F.lit(self.bits))
        return [F.pmod(one + F.lit(j) * two, F.lit(self.bits)) for j in range(self.hashes)]

    def lets_through(self, key: Column) -> Column:
        tests = [
            F.getbit(F.get(self.words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1
            for p in self._positions(key)]
        return reduce(lambda a, b: a & b, tests)


class Cascade:
    """Exact membership for every key of ``universe`` (key, listed).

    A key that occurs with both flags is listed; NULL keys are ignored. Other keys than the
    universe's get some answer.
    """

    def __init__(self, universe: DataFrame):
        keys = universe.where("key IS NOT NULL").groupBy("key").agg(F.bool_or(F.coalesce("listed", F.lit(False))).alias("listed"))
        keys = written(keys)
        inside, outside = (keys.where(x).select("key") for x in ("listed", "NOT listed"))
        counts = {r[0]: r[1] for r in keys.groupBy("listed").count().collect()}
        count, others, self.levels = counts.get(True, 0), counts.get(False, 0), []
        while count:
            # The first filter lets about as many others through as there are listed keys.
            rate = _PASS if self.levels else min(_PASS, count / max(others, 1))
            level = Level(len(self.levels), inside, count, rate)
            passed = written(outside.where(level.lets_through(F.col("key"))))
            self.levels.append(level)
            inside, outside, count = passed, inside, passed.count()

    def contains(self, key: Column) -> Column:
        """True where the key is listed; NULL keys are not."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(level.lets_through(key), answer).otherwise(level.number % 2 == 1)
        return F.coalesce(key.isNotNull() & answer, F.lit(False))


def judge_urls(pages: DataFrame, rules, listed: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url).

    The longest fitting rule decides (see ``longest_rule``); elsewhere a url is blocked if its key,
    host and path together, stands in the table ``listed`` (key). The universe of the cascade is all keys of ``pages`` and of
    ``listed``. A NULL url or one without ``://`` has an empty host
    and path; repeated urls are judged alike, repeated listed keys count once and NULL ones not; rows without page_id are judged; other columns are
    ignored; an empty table gives an empty table, an empty list blocks nothing.
    """
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    key = F.concat("host", "path")
    keys = parts.select(key.alias("key"), F.lit(False).alias("listed"))
    cascade = Cascade(keys.unionByName(listed.select(F.col("key").cast("string"), F.lit(True).alias("listed"))))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    method = F.when(cascade.contains(key), "block").otherwise("allow")
    return parts.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))
