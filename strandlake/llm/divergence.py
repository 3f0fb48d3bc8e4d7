r"""Divergence of sources: which sources of a language write unlike each other, and which terms they use more than the language.

Null text, lang and source read as ''. Terms are runs of ASCII letters and of characters beyond ASCII; A-Z is lower-cased. Each lang keeps the V
terms that ``least_docs`` of its documents have. Every (lang, source), and each lang, gives each kept term p = 1 + floor(10 ** 9 *
(count + 5) / (N + 5 V)), N the count's sum over kept terms. The rest are sums of differences of p, in whole numbers.

1. First pass: each task counts in how many documents a term stands; Spark sums up by (lang, term). So frequencies are exact.
2. Second pass: the kept terms, in blocks of ``BLOCK`` at most by hash, are compiled into automata (one a language) as `` term `` with a
   space at both ends, over texts in which all that is no term is a space. All matches are counted by (lang, source, term). A block is
   what is broadcast; a larger vocabulary makes more blocks, each with a scan of its own, and not larger ones.
3. Postings are the rows (lang, source, term) with a count. For two sources, let f be a difference of p, and 0 the p of a term that
   a source lacks. The sum of f over all kept terms is: over the one's terms against the other's 0, the same the other way, and over terms of
   both what these two sums took amiss, and the rest of the terms by the two 0. The first two need only how many terms of a source have
   each p; the third is made in buckets of ``BUCKET`` postings, a source against all others at a time; so no pair
   of postings is ever a row.

A (lang, source) without terms has rows like others; with V = 0 all its pairs are 0. A source alone in its lang has no pair. Repeated rows count
again. Ties are ranked by the item's UTF-8 bytes. An empty table gives none. Very long texts are scanned whole. Further columns aren't read.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Scratch, kept, rows_of

BLOCK = 200_000
BUCKET = 200_000
CHUNK = 4 << 20
HELD = 1 << 22  # counters, or terms, that a task holds before it hands them on
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 0x20 for b in range(256))


def terms_of(text: str) -> bytes:
    """The terms, with spaces for all else."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE)


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def document_frequencies(docs: DataFrame) -> DataFrame:
    """lang, term, docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found in held.items():
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array([t.decode("utf-8", "surrogatepass") for t in found]), pa.array(list(found.values()), pa.int64())], names=["lang", "term", "docs"])
            held.clear()

        for langs, texts in rows_of(batches, 64):
            for lang, text in zip(langs, texts, strict=True):
                held[lang].update(set(terms_of(text).split()))
            if sum(map(len, held.values())) > HELD // 8:
                yield from out()
        yield from out()

    rows = docs.select(_text("lang"), _text("text")).mapInArrow(run, "lang string, term string, docs bigint")
    return rows.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


class Vocabulary:
    """The automata of one block of terms."""

    def __init__(self, terms: dict[str, list[str]]):
        self.terms = {lang: pa.array(t, pa.string()) for lang, t in terms.items()}
        self.machines = {}
        for lang, found in terms.items():
            machine = self.machines[lang] = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, term in enumerate(found):
                machine.add_word(f" {term} ", i)
            machine.make_automaton()

    def counted(self, lang: str, texts: list[bytes]) -> np.ndarray:
        text = b" ".join([b"", *texts, b""]).decode("utf-8", "surrogatepass")
        return np.bincount(np.fromiter(map(itemgetter(1), self.machines[lang].iter(text)), np.int64), minlength=len(self.terms[lang]))


def occurrences(docs: DataFrame, terms: dict[str, list[str]]) -> DataFrame:
    """lang, source, term, count (1 or more) of one block of terms, by lang."""
    block, name = docs.sparkSession.sparkContext.broadcast(terms), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = kept("vocabulary", name, lambda: Vocabulary(block.value))
        texts: dict[tuple[str, str], list[bytes]] = defaultdict(list)
        sums: dict[tuple[str, str], np.ndarray] = {}

        def scan() -> None:
            for (lang, source), found in texts.items():
                n = vocabulary.counted(lang, found)
                sums[lang, source] = sums[lang, source] + n if (lang, source) in sums else n
            texts.clear()

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), n in sums.items():
                at = np.flatnonzero(n)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array([source] * len(at)), vocabulary.terms[lang].take(pa.array(at)), pa.array(n[at])], names=["lang", "source", "term", "count"])
            sums.clear()

        size = 0
        for langs, sources, bodies in rows_of(batches, 64):
            for lang, source, text in zip(langs, sources, bodies, strict=True):
                if lang in vocabulary.machines:
                    texts[lang, source].append(terms_of(text))
                    size += len(text)
                if size >= CHUNK:
                    scan()
                    size = 0
            if sum(map(len, sums.values())) > HELD:
                yield from out()
        scan()
        yield from out()

    rows = docs.select(_text("lang"), _text("source"), _text("text")).mapInArrow(run, "lang string, source string, term string, count bigint")
    return rows.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"))


def recounted(docs: DataFrame, vocabulary: DataFrame, scratch: Scratch, most: int = BLOCK) -> DataFrame:
    """lang, source, term, count of all terms of ``vocabulary`` (lang, term), a block at a time."""
    blocks = vocabulary.count() // most + 1
    dealt = vocabulary.withColumn("block", F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        terms: dict[str, list[str]] = defaultdict(list)
        for lang, term in dealt.filter(F.col("block") == block).select("lang", "term").collect():  # about ``most`` rows
            terms[lang].append(term)
        if terms:
            found = scratch.save(occurrences(docs, dict(terms)))
            out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "lang string, source string, term string, count bigint")


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10 ** 9 * (count + 5) / (n + 5 v)), exactly; null if there is nothing to divide by."""
    whole = lambda c: c.cast("decimal(18,0)")
    return F.when(n + v > 0, 1 + F.call_function("div", F.lit(10**9).cast("decimal(10,0)") * whole(count + 5), whole(n + 5 * v)))


OVERLAPS = "lang string, source string, item string, value bigint"


def _overlaps(table: pa.Table) -> pa.Table:
    """Of one bucket of a lang's postings: for each ordered pair of sources, what their common terms add."""
    codes = lambda c: np.unique(np.array(table.column(c).to_pylist(), object), return_inverse=True)
    (sources, s), (terms, t) = codes("source"), codes("term")
    order = np.argsort(s, kind="stable")
    s, t, p = s[order], t[order], table.column("p").to_numpy()[order]
    starts = np.searchsorted(s, np.arange(len(sources) + 1))
    rest = table.column("p0").to_numpy()[order][starts[:-1]]
    own = np.zeros(len(terms), np.int64)
    one, other, value = [], [], []
    for g in range(len(sources)):
        mine = slice(starts[g], starts[g + 1])
        own[t[mine]] = p[mine]
        both = np.flatnonzero((own[t] > 0) & (s != g))
        if len(both):
            a, b, h = own[t[both]], p[both], s[both]
            f = np.abs(a - b) - np.abs(a - rest[h]) - np.abs(b - rest[g]) + np.abs(rest[g] - rest[h])
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            one += [sources[g]] * len(first)
            other += sources[h[first]].tolist()
            value += np.add.reduceat(f, first).tolist()
        own[t[mine]] = 0
    lang = table.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(one), pa.string()), "source": pa.array(one, pa.string()), "item": pa.array(other, pa.string()), "value": pa.array(value, pa.int64())})


def audit(spark: SparkSession, docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: item is each other source of the lang, value the sum of differences.
    Part ``term``: the ``top`` kept terms that the source has and gives more than its lang does."""
    scratch = Scratch(spark, "divergence")
    vocabulary = scratch.save(document_frequencies(docs).filter(F.col("docs") >= least_docs).select("lang", "term"))
    counts = scratch.save(recounted(docs, vocabulary, scratch))
    groups = docs.select(_text("lang"), _text("source")).distinct()
    by_lang = vocabulary.groupBy("lang").agg(F.count("*").alias("v"))
    by_group = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("terms"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = groups.join(by_lang, "lang", "left").join(by_group, ["lang", "source"], "left").select("lang", "source", zero("v"), zero("n"), zero("terms"))
    groups = scratch.save(groups.withColumn("p0", share(F.lit(0), F.col("n"), F.col("v"))))
    posts = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", share(F.col("count"), F.col("n"), F.col("v")).alias("p"), "p0")
    posts = scratch.save(posts)

    others = groups.select("lang", F.col("source").alias("item"), F.col("terms").alias("terms_"), F.col("p0").alias("p0_"))
    apart = F.coalesce((F.col("v") - F.col("terms") - F.col("terms_")) * F.abs(F.col("p0") - F.col("p0_")), F.lit(0))
    rest = groups.join(others, "lang").filter("source != item").select("lang", "source", "item", apart.alias("value"))
    values = posts.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    against = values.join(others, "lang").filter("source != item").groupBy("lang", "source", "item").agg(F.sum(F.col("m") * F.abs(F.col("p") - F.col("p0_"))).alias("value"))
    against = scratch.save(against)
    buckets = posts.count() // BUCKET + 1
    dealt = posts.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
    common = dealt.groupBy("lang", "bucket").applyInArrow(_overlaps, OVERLAPS)
    parts = rest.union(against).union(against.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).union(common)
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    of_lang = counts.groupBy("lang", "term").agg(F.sum("count").alias("c")).join(groups.groupBy("lang").agg(F.sum("n").alias("n"), F.max("v").alias("v")), "lang")
    q = of_lang.select("lang", "term", share(F.col("c"), F.col("n"), F.col("v")).alias("q"))
    above = posts.join(q, ["lang", "term"]).filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return scratch.finish(ranked(pairs, "pair").union(ranked(above, "term").filter(F.col("rank") <= top)))


def oracle(least_docs: int = 30, top: int = 50) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share = "1 + (1000000000::HUGEINT * (c + 5)) // (n + 5 * v)"
    return f"""
    WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t FROM documents),
    df AS (SELECT lang, unnest(list_distinct(t)) AS term FROM d),
    kept AS (SELECT lang, term FROM df GROUP BY ALL HAVING count(*) >= {least_docs}),
    occ AS (SELECT lang, source, unnest(t) AS term FROM d),
    cnt AS (SELECT lang, source, term, count(*) AS c FROM occ JOIN kept USING (lang, term) GROUP BY ALL),
    grp AS (SELECT DISTINCT lang, source FROM d),
    vs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    ns AS (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY ALL),
    dense AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, coalesce(n, 0) AS n, v
              FROM grp g JOIN kept k ON k.lang = g.lang JOIN vs ON vs.lang = g.lang
              LEFT JOIN ns ON ns.lang = g.lang AND ns.source = g.source LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = k.term),
    p AS (SELECT lang, source, term, c, {share} AS p FROM dense),
    diff AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
    pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
             FROM grp a JOIN grp b ON a.lang = b.lang AND a.source != b.source LEFT JOIN diff ON diff.lang = a.lang AND diff.source = a.source AND diff.item = b.source),
    whole AS (SELECT lang, term, sum(c) AS c FROM cnt GROUP BY ALL),
    total AS (SELECT lang, sum(c) AS n FROM cnt GROUP BY lang),
    q AS (SELECT lang, term, {share} AS q FROM whole JOIN total USING (lang) JOIN vs USING (lang)),
    above AS (SELECT p.lang, p.source, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q),
    parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM above),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
