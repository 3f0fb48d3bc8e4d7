r"""Collocations: phrases whose words meet more often than apart, by language, from exact counts.

Texts (null: empty) are lower-cased (A-Z), cut at ``[.,;:!?\x0A-\x0D]`` into pieces, and those at spaces and tabs into words. f is the
number of contiguous occurrences of a phrase within pieces, overlaps included. A candidate has 2 to ``longest`` words and
f >= ``least``. Cut after its first k words, its score is floor(10 ** 6 * f * f / (f(first part) * f(rest))); the cut that scores
lowest counts. A candidate is dropped if a longer one, that holds its words contiguously, has at least ``inside`` percent of its f.

1. Sketch: each task adds up the occurrences of all phrases of 1 to ``longest`` words in one row of 2 ** ``cells`` counters of a
   byte, by a hash of language and words. Counters that aren't zero go out in blocks and are added up by block, up to ``least``. A
   counter is an upper bound of f, so what is left of the sketch is a bit a counter: ``least`` or more. These bits (8 MB, whatever
   the data) are broadcast. Where a corpus fills the counters, the bound only keeps more phrases; counts stay exact.
2. Each task goes through its texts in chunks of ``CHUNK`` bytes, a language at a time. The chunk's phrases whose bounds, and those
   of their parts, reach ``least`` are found in it by automata over the words' numbers, with a number that no phrase holds between
   pieces: one for each ``STRETCH`` words, of the phrases that begin there. All overlapping matches are counted, added up over the chunk,
   and over chunks by Spark. So also where every phrase is kept, an automaton never holds more than the phrases of one stretch, rows
   go out a few thousand at a time, and nothing grows with the corpus or its vocabulary.
3. Exact sums replace the bounds: candidates, scores in decimals of 38 digits, containment and ranks are joins and aggregates.

Rows with a null lang count as ``und``. Null and empty texts have no words. Repeated rows count again. A text longer than a chunk is cut between
pieces. Ties of score and f are ranked by the phrase's UTF-8 bytes. An empty table gives none. Further columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Scratch, partitions, rows_of
from .neardup import _STEP, _mixed

CHUNK = 6 << 20
STRETCH = 1 << 17  # words
ROWS = 1 << 13  # at once to Spark
BLOCK = 1 << 12  # so that a batch of many blocks stays small
_TABLE = bytes(0x21 if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_WALL = b"!"
_END = re.compile(r"[.,;:!?\n\x0b\x0c\r]")


def pieces_of(text: str) -> bytes:
    """The text's bytes in lower case, with ``!`` as a word for what parts pieces."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).replace(_WALL, b" ! ")


def parts_of(text: str, most: int) -> Iterator[str]:
    """The text whole, or cut at the first end of a piece beyond each ``most`` characters."""
    at = 0
    while at < len(text):
        end = _END.search(text, at + most)
        yield text[at : (at := end.end() if end else len(text))]


def chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, words) of about ``most`` bytes of text, from columns lang and text. Only one language's words are held at once."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size = 0

    def given() -> Iterator[tuple[str, list[bytes]]]:
        while held:
            lang, parts = held.popitem()
            yield lang, b" ! ".join(parts).split()

    for langs, texts in rows_of(batches, 64):
        for lang, text in zip(langs, texts, strict=True):
            for part in parts_of(text, most):
                held[lang].append(pieces_of(part))
                size += len(held[lang][-1])
                if size >= most:
                    yield from given()
                    size = 0
    yield from given()


class Phrases:
    """A chunk's words as numbers, and each place's phrases of 1 to ``longest`` words as hashes."""

    def __init__(self, lang: str, words: list[bytes], longest: int):
        index: dict[bytes, int] = defaultdict()
        index.default_factory = index.__len__
        index[_WALL]
        self.ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        self.words, seed = list(index), xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
        hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.words], np.uint64)[self.ids]
        inside = self.ids > 0
        self.hashes, self.inside = [hashes], [inside]
        for n in range(1, longest):
            if len(words) <= n:
                break
            self.hashes.append(_mixed(self.hashes[-1][:-1] * _STEP + hashes[n:]))
            self.inside.append(self.inside[-1][:-1] & inside[n:])

    def candidates(self, bits: np.ndarray, cells: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length: the word numbers of the distinct phrases whose bound, and those of the phrases within them, are high
        enough, a row a phrase; and at each place the row of the phrase that begins there, or -1."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        good = None
        for n, (hashes, inside) in enumerate(zip(self.hashes, self.inside, strict=True)):
            cell = (hashes >> np.uint64(64 - cells)).astype(np.int64)
            fits = inside & ((bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).astype(bool)
            if n:
                fits &= good[:-1] & good[1:]
            last = self.ids[n:]
            pairs = out[-1][1][:-1][fits].astype(np.int64) * len(self.words) + last[fits] if n else last[fits]
            found, first, number = np.unique(pairs, return_index=True, return_inverse=True)
            if not len(found):
                break
            codes = np.full(len(fits), -1, np.int32)
            codes[fits] = number
            at = np.flatnonzero(fits)[first]
            out.append((self.ids[at[:, None] + np.arange(n + 1)].astype(np.int32), codes))
            good = fits
        return out


def spelt(ids: np.ndarray, base: int, digits: int) -> str:
    """Word numbers by ``digits`` characters each, of an alphabet of its own for each place, so that no match begins within a word."""
    place = np.arange(digits)
    return (ids[..., None] // base ** place[::-1] % base + base * place + 1).astype("<u4").tobytes().decode("utf-32-le")


def counted(ids: np.ndarray, words: int, found: Sequence[tuple[np.ndarray, np.ndarray]], stretch: int = STRETCH) -> list[np.ndarray]:
    """How often each phrase occurs among the numbers of words (below ``words``), for each length: an automaton a stretch, of the
    phrases that begin in it. It reads on for the rest of the last phrases, and leaves out matches that begin there."""
    digits = 2 if words <= 1 << 16 else 3
    base = int(np.ceil(words ** (1 / digits))) + 1
    totals = [np.zeros(len(rows), np.int64) for rows, _ in found]
    for start in range(0, len(ids), stretch):
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        here = [np.unique(codes[start : start + stretch]) for _, codes in found]
        here = [numbers[numbers >= 0] for numbers in here]
        ends = np.cumsum([0, *map(len, here)])
        if not ends[-1]:
            continue
        for n, ((rows, _), numbers) in enumerate(zip(found, here, strict=True)):
            text, width = spelt(rows[numbers], base, digits), (n + 1) * digits
            for i in range(len(numbers)):
                machine.add_word(text[i * width : (i + 1) * width], int(ends[n]) + i)
        machine.make_automaton()
        text = spelt(ids[start : start + stretch + len(found) - 1], base, digits)
        at, hit = np.fromiter(chain.from_iterable(machine.iter(text)), np.int64).reshape(-1, 2).T
        begin = at // digits - np.repeat(np.arange(len(here)), np.diff(ends))[hit]
        f = np.bincount(hit[begin < stretch], minlength=ends[-1])
        for n, numbers in enumerate(here):
            totals[n][numbers] += f[ends[n] : ends[n + 1]]
    return totals


def phrase_rows(lang: str, p: Phrases, found: Sequence[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """lang, phrase, f of a chunk, and under a null phrase all its words."""
    names = ["lang", "phrase", "f"]
    words = pa.array(p.words, pa.binary()).cast(pa.string())
    for (rows, _), f in zip(found, counted(p.ids, len(p.words), found), strict=True):
        for at in range(0, len(rows), ROWS):
            some = rows[at : at + ROWS]
            phrases = pc.binary_join_element_wise(*[words.take(pa.array(some[:, k])) for k in range(some.shape[1])], " ")
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(some)), phrases, pa.array(f[at : at + ROWS])], names=names)
    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.nulls(1, pa.string()), pa.array([int(p.inside[0].sum())])], names=names)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def sketch(docs: DataFrame, least: int, longest: int, cells: int) -> bytes:
    """A bit for each counter: the sum over the corpus is ``least`` or more (at most 255). Sums end there, so full counters pack well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << cells, np.uint8)
        for lang, words in chunks(batches):
            p = Phrases(lang, words, longest)
            for hashes, inside in zip(p.hashes, p.inside, strict=True):
                cell, n = np.unique((hashes[inside] >> np.uint64(64 - cells)).astype(np.uint32), return_counts=True)
                counters[cell] = np.minimum(counters[cell] + n, least).astype(np.uint8)
        for block in range(max(1, len(counters) // BLOCK)):
            part = counters[block * BLOCK : (block + 1) * BLOCK]
            at = np.flatnonzero(part)
            if len(at):
                gaps = np.diff(at, prepend=0).astype(np.uint16)
                yield pa.RecordBatch.from_pylist([{"block": block, "gaps": zlib.compress(gaps.tobytes(), 1), "counts": zlib.compress(part[at].tobytes(), 1)}])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for blocks, gaps, counts in rows_of(batches, 64):
            for block, g, n in zip(blocks, gaps, counts, strict=True):
                at = np.cumsum(np.frombuffer(zlib.decompress(g), np.uint16), dtype=np.int64)
                total = sums.setdefault(block, np.zeros(min(BLOCK, 1 << cells), np.uint8))
                total[at] = np.minimum(total[at].astype(np.int64) + np.frombuffer(zlib.decompress(n), np.uint8), least)
        if sums:
            yield pa.RecordBatch.from_pylist([{"block": b, "bits": np.packbits(x >= least, bitorder="little").tobytes()} for b, x in sums.items()])

    parts = _source(docs).mapInArrow(run, "block bigint, gaps binary, counts binary").repartition(partitions(docs.sparkSession), "block")
    size = min(BLOCK, 1 << cells) // 8
    out = bytearray((1 << cells) // 8)
    for block, bits in parts.mapInArrow(add, "block bigint, bits binary").collect():  # 2 ** cells bits in all
        out[block * size : (block + 1) * size] = bits
    return bytes(out)


def counts(docs: DataFrame, least: int = 10, longest: int = 3, cells: int = 26) -> DataFrame:
    """lang, phrase, f of all phrases of 1 to ``longest`` words with f >= least; and, under a null phrase, all words of each lang."""
    if not 1 <= least <= 255:
        raise ValueError("counters of a byte bound 1 to 255 occurrences")
    bits = docs.sparkSession.sparkContext.broadcast(sketch(docs, least, longest, cells))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = np.frombuffer(bits.value, np.uint8)
        for lang, words in chunks(batches):
            p = Phrases(lang, words, longest)
            yield from phrase_rows(lang, p, p.candidates(high, cells))

    got = _source(docs).mapInArrow(run, "lang string, phrase string, f bigint").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return got.filter((F.col("f") >= least) | F.col("phrase").isNull())


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, a, score, k, l, r of each phrase of two words or more, at its lowest cut."""
    f = found.filter("phrase is not null")
    long = f.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("w") - 1))).filter("k > 0")
    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cut = long.select("lang", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    left = cut.join(f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    both = left.join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    both = both.select("lang", "phrase", "a", "k", "l", "r", *[F.col(c).cast("decimal(15,0)").alias(f"{c}_") for c in ("a", "l", "r")])
    score = F.expr("(cast(1000000 as decimal(7,0)) * a_ * a_) div (l_ * r_)")
    return both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.*")


def outnumbered(found: DataFrame, inside: int) -> DataFrame:
    """lang, phrase of those within a longer one that has ``inside`` percent of their f."""
    long = found.filter("phrase is not null").withColumn("w", F.split("phrase", " ")).withColumn("n", F.size("w")).filter("n > 1")
    parts = long.filter("n > 2").select("lang", "w", "n", "f", F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("m"))
    parts = parts.select("lang", "w", "m", "f", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("m") + 1)).alias("i"))
    most = parts.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("f").alias("most"))
    return long.join(most, ["lang", "phrase"]).filter(100 * F.col("most") >= inside * F.col("f")).select("lang", "phrase")


def collocations(spark: SparkSession, docs: DataFrame, least: int = 10, longest: int = 3, inside: int = 50, top: int | None = 2000, cells: int = 26) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's first ``top`` (None: all) by score, a (descending) and phrase."""
    scratch = Scratch(spark, "collocations")
    found = scratch.save(counts(docs, least, longest, cells))
    kept = scored(found).join(outnumbered(found, inside), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)  # Spark drops what is beyond before it deals by lang
    n = found.filter("phrase is null").select("lang", F.col("f").alias("n"))
    return scratch.finish(ranked.join(n, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def oracle(least: int = 10, inside: int = 50, top: int = 2000) -> str:
    """The same for phrases of two and three words, in SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
    g AS (SELECT lang, unnest(flatten(list_transform([1, 2, 3], lambda n: list_transform(range(1, len(w) - n + 2), lambda i: [n::VARCHAR, array_to_string(w[i:i + n - 1], ' ')])))) AS g FROM w),
    f AS (SELECT lang, g[1]::INT AS n, g[2] AS phrase, count(*) AS f FROM g GROUP BY ALL),
    total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE n = 1 GROUP BY lang),
    c AS (SELECT lang, n AS words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE n > 1 AND f >= {least}),
    cut AS (SELECT *, 1 AS k FROM c UNION ALL SELECT *, 2 FROM c WHERE words = 3),
    s AS (SELECT cut.lang, words, cut.phrase, a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
          FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(w[k + 1:words], ' ')),
    low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inner_parts AS (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE words = 3),
    longer AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL),
    kept AS (SELECT low.* FROM low LEFT JOIN longer ON low.words = 2 AND longer.lang = low.lang AND longer.phrase = low.phrase WHERE most IS NULL OR 100 * most < {inside} * a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= {top}"""
