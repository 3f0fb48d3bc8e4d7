"""URL filter: allow and block rules first, then exact membership in a blocklist by a cascade of Bloom filters.

The cascade covers the complete universe of keys (all host suffixes of the corpus). Level 1 encodes the listed keys of
the universe; level 2 the unlisted keys that pass level 1; level 3 the listed keys that pass level 2; and so on until no
key is misjudged. A key is listed if the first level that it fails is an even one. Judging a row needs no join: each level is
one array of words in the plan, which is sent to an executor once. The levels hold about
1.44 * |listed| * (log2(|universe| / |listed|) + 3) bits. A list of any size is judged so: keys are dealt by a hash into as many
blocks as keep a block's levels near 2^25 bits (4 MB, about two million listed hosts among a thousand million), each block
has a cascade of its own, and rows pass one block after another, written in between. So neither the driver nor an executor
holds more than one block's levels, and a list that is ten times as long costs ten times as many passes.

A host is judged by those of its suffixes that have no more parts than the longest listed key; longer ones can't be listed.
Null or malformed urls have an empty host and path, fit no rule and are allowed. Urls may be of any length. Repeated rows are
judged alike, and an empty table or list gives no error. Further columns of the input are not looked at.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def first_fit(rules: Sequence[Rule], host: Column, path: Column, value) -> Column:
    """Of the longest rule that fits, ``value(rule)``; null if none does. Equal lengths: in order of the text."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        out = (F if out is None else out).when(fits(rule, host, path), F.lit(value(rule)))
    return F.lit(None).cast("string") if out is None else out


def suffixes(host: Column, most: int) -> Column:
    """The host and its parent domains (a.b.c, b.c, c), those of at most so many parts."""
    parts = F.split(F.substring_index(host, ".", -most), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))


@dataclass
class Level:
    bits: int
    hashes: int
    seed: int
    words: list[int]

    def position(self, key: Column, j: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed * 64 + j), key), F.lit(self.bits))

    def passes(self, key: Column) -> Column:
        words = F.from_json(F.lit(json.dumps([self.words], separators=(",", ":"))), "array<array<bigint>>")  # folded to one constant
        bit = lambda w, at: F.getbit(F.get(w, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1
        return F.exists(words, lambda w: reduce(and_, [bit(w, self.position(key, j)) for j in range(self.hashes)]))


def build_level(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    """A level that encodes the ``count`` keys; the bits are or-ed on the executors, at most bits / 64 rows come back."""
    hashes = max(1, round(-math.log2(rate)))
    level = Level(max(64, math.ceil(count * hashes / math.log(2))), hashes, seed, [])
    at = keys.select(F.explode(F.array(*[level.position(F.col("key"), j) for j in range(hashes)])).alias("p"))
    got = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b"))
    words = [0] * (level.bits // 64 + 1)
    for w, b in got.collect():
        words[w] = b
    level.words = words
    return level


#: About how many bits the levels of a block of keys have at most, 4 MB.
MAX_BITS = 1 << 25


def expected_bits(total: int, listed: int) -> int:
    """Of all levels: the first one, and about three bits a listed key for those after it."""
    return math.ceil(listed * (max(1.0, math.log2(max(1, total - listed) / max(1, listed)) + 0.5) + 3) / math.log(2))


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(blocks))


def counts(keys: DataFrame) -> tuple[int, int]:
    """How many keys, and how many of them listed."""
    return tuple(keys.agg(F.count("*"), F.count(F.when(F.col("listed"), 1))).first())


def build_cascade(keys: DataFrame, scratch: Scratch, max_levels: int = 64) -> list[Level]:
    """Levels for ``keys`` (key string, listed boolean; the complete universe, distinct). The keys that pass a level, about half
    of those before, are written, so that no level is gone through again for the next."""
    total, listed = counts(keys)
    levels: list[Level] = []
    inside, outside = keys.filter("listed"), keys.filter("not listed")
    count, rate = listed, min(0.5, listed / (math.sqrt(2) * max(1, total - listed)))
    while count:
        if len(levels) == max_levels:
            raise RuntimeError("the cascade does not end: keys whose hashes agree under every seed")
        level = build_level(inside, count, rate, len(levels) + 1)
        levels.append(level)
        inside, outside = scratch.save(outside.filter(level.passes(F.col("key")))), inside
        count, rate = inside.count(), 0.5
    return levels


def is_member(levels: list[Level], key: Column) -> Column:
    out = F.lit(len(levels) % 2 == 1)  # a key that passes all levels belongs to what the last one encodes
    for i in reversed(range(len(levels))):
        out = F.when(levels[i].passes(key), out).otherwise(F.lit(i % 2 == 1))
    return out


def listed_in(levels: list[Level], block: int, blocks: int) -> Callable[[Column], Column]:
    """Whether a key is in the block and listed."""
    return lambda key: is_member(levels, key) if blocks == 1 else (block_of(key, blocks) == block) & is_member(levels, key)


def url_filter(spark: SparkSession, pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict, method (``rule`` or ``list``). ``listed`` has a column key: blocked domains."""
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    marked = listed.select(F.translate("key", UPPER, LOWER).alias("key")).distinct().withColumn("hit", F.lit(True))
    parts = marked.agg(F.max(F.regexp_count("key", F.lit(r"\.")))).first()[0]
    most = 1 if parts is None else parts + 1
    seen = pages.select(host_of(url).alias("host")).distinct().select(F.explode(suffixes(host, most)).alias("key")).distinct()
    scratch = Scratch(spark, "urlfilter")
    keys = scratch.save(seen.join(marked, "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("listed")))
    blocks = max(1, math.ceil(expected_bits(*counts(keys)) / max_bits))
    bad = F.lit(False)
    for b in range(blocks):
        levels = build_cascade(keys.filter(block_of(F.col("key"), blocks) == b) if blocks > 1 else keys, scratch)
        bad = bad | F.exists(suffixes(host, most), listed_in(levels, b, blocks))
        if b < blocks - 1:
            before, rows = rows, scratch.save(rows.select("page_id", "host", "path", bad.alias("bad")))
            if b:
                scratch.drop(before)
            bad = F.col("bad")
    scratch.clear() if blocks == 1 else scratch.drop(keys)
    return rows.select(
        "page_id", "host", "path",
        first_fit(rules, host, path, lambda r: r.text).alias("rule"),
        F.coalesce(first_fit(rules, host, path, lambda r: r.action), F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.when(first_fit(rules, host, path, lambda r: r.text).isNull(), "list").otherwise("rule").alias("method"),
    )
