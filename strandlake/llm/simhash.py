r"""Near-duplicate documents by SimHash fingerprints that meet at the anchors of a covering code.

A fingerprint has 64 bits: bit i is 1 if over half of the document's w-word shingles (repeats included, A-Z lower-cased,
words parted by ASCII white space, joined by one space) have it in their XXH64 of seed 42. With fewer words the whole
sequence is the only shingle; without words the fingerprint is zero and linked like any other. Fingerprints that differ
in ``THRESHOLD`` bits or fewer are linked; the result is the connected components.

1. Rows of one fingerprint are one node, so exact copies cost nothing more.
2. The anchors are the words of a perfect code in each of four blocks of the 64 bits: two of 23 bits (radius 3), one of 15
   and one of 3 (radius 1 each). Every fingerprint lies within the covering radius 8 of one of 2 ** 36 anchors, its home.
3. If x and y are linked, y is at most radius plus threshold from x's home: the bits that differ add to the distances of
   their blocks. So each fingerprint is sent to every anchor whose distance, block by block, is over the radius by no more
   than the threshold in all. Of two homes the greater is enough, so anchors less than the own home are left out: about
   85 rows a fingerprint, whatever the data.
4. Per anchor, those at home are compared with all others. A fingerprint that has ``CROWD`` others at its home, as in a large group of
   edited copies, would make that a square: what such an anchor has is dealt anew to the code of radius 0, all words, at distance 1
   or less (any two linked fingerprints have such a word in common), and each is linked with the least at that word. Links
   are the same components, 65 rows a fingerprint.

A row with a null doc_id gets a component like others; a null is the component's id only if it has no other. Repeated rows
stay. An empty table gives none. Texts are hashed whole, a few thousand shingles at once. Further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, rows_of, values_of
from .neardup import components, with_names

THRESHOLD = 2
CROWD = 1024
AT_ONCE = 1 << 15
#: (bits, radius, generator polynomial) of the four perfect cyclic codes, from the lowest bit up. Fixed values.
BLOCKS = ((23, 3, 0xAE3), (23, 3, 0xAE3), (15, 1, 0x13), (3, 1, 0x7))


def fingerprint(text: str | None, width: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only
    if not words:
        return 0
    digest, width = xxhash.xxh64_intdigest, min(width, len(words))
    n = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, AT_ONCE):
        part = words[at : at + AT_ONCE + width - 1]
        joined, ends = b" ".join(part), np.cumsum([len(w) + 1 for w in part]).tolist()
        starts = [0, *ends]
        hashes = np.array([digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[width - 1 :], strict=False)], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, node: the fingerprint as a signed integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches):
            got = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(got)], names=["doc_id", "node"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, node bigint")


def remainder(word: int, generator: int) -> int:
    top = generator.bit_length()
    while word.bit_length() >= top:
        word ^= generator << (word.bit_length() - top)
    return word


@lru_cache(maxsize=8)
def reaches(bits: int, radius: int, generator: int, threshold: int) -> list[list[list[int]]]:
    """For each remainder and each excess from 0 to threshold: the patterns that lead from a word to an anchor at radius + excess."""
    out: list[list[list[int]]] = [[[] for _ in range(threshold + 1)] for _ in range(1 << (generator.bit_length() - 1))]
    single = [remainder(1 << i, generator) for i in range(bits)]
    for weight in range(min(bits, radius + threshold) + 1):
        for places in combinations(range(bits), weight):
            left = pattern = 0
            for i in places:
                left, pattern = left ^ single[i], pattern | 1 << i
            out[left][max(0, weight - radius)].append(pattern)
    return out


class Anchors:
    """The anchors that a fingerprint is sent to."""

    def __init__(self, threshold: int):
        self.blocks, at = [], 0
        for bits, radius, generator in BLOCKS:
            moves = [[np.array(p, np.uint64) << np.uint64(at) for p in row] for row in reaches(bits, radius, generator, threshold)]
            self.blocks.append((at, (1 << bits) - 1, generator, moves))
            at += bits
        self.spent = [x for x in product(range(threshold + 1), repeat=len(BLOCKS)) if sum(x) <= threshold]

    def of(self, word: int) -> tuple[np.ndarray, int]:
        """All anchors within reach, and the home among them."""
        moves = [m[remainder(word >> at & mask, g)] for at, mask, g, m in self.blocks]
        found = []
        for spent in self.spent:
            got = np.array([word], np.uint64)
            for m, excess in zip(moves, spent, strict=True):
                got = np.bitwise_xor.outer(got, m[excess]).ravel()
            found.append(got)
        out = np.concatenate(found)
        return out, int(out[0])  # nothing spent in any block comes first


def replicated(nodes: DataFrame) -> DataFrame:
    """anchor, node, home: a row for each anchor that a node is sent to, of which its home is the least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(THRESHOLD)
        for batch in batches:
            for words in values_of(batch.column(0)):
                if not words:
                    continue
                sent = [anchors.of(w & (1 << 64) - 1) for w in words]
                kept = [a[a >= np.uint64(h)] for a, h in sent]
                to, n = np.concatenate(kept), [len(a) for a in kept]
                home = to == np.repeat(np.array([h for _, h in sent], np.uint64), n)
                yield pa.RecordBatch.from_arrays([pa.array(to.view(np.int64)), pa.array(np.repeat(np.array(words, np.int64), n)), pa.array(home)], names=["anchor", "node", "home"])

    return nodes.select("node").mapInArrow(run, "anchor bigint, node bigint, home boolean")


def stars(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect all nodes which share a word at distance 1 or less, that is, differ in two bits or fewer."""
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)])
    words = nodes.select("node", F.explode(F.transform(flips, lambda f: F.col("node").bitwiseXOR(f))).alias("word"))
    least = words.groupBy("word").agg(F.min("node").alias("b"), F.max("node").alias("m")).filter("b != m").select("word", "b")
    return words.join(least, "word").filter("node != b").select(F.col("node").alias("a"), "b").distinct()


def links_between(nodes: DataFrame, scratch: Scratch, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of nodes that differ in THRESHOLD bits or fewer."""
    sent = scratch.save(replicated(nodes))
    home = sent.filter("home")
    crowded = scratch.save(home.groupBy("anchor").count().filter(F.col("count") > crowd).select("anchor"))
    of_crowds = None
    if crowded.limit(1).count():
        of_crowds = stars(sent.join(crowded, "anchor", "left_semi").select("node").distinct())
        sent, home = sent.join(crowded, "anchor", "left_anti"), home.join(crowded, "anchor", "left_anti")
    here = home.select("anchor", F.col("node").alias("a"))
    there = sent.select(F.col("anchor").alias("to"), F.col("node").alias("b"), "home")
    alike = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD
    pairs = here.join(there, (F.col("anchor") == F.col("to")) & (~F.col("home") | (F.col("b") < F.col("a"))) & alike).select("a", "b")
    return scratch.save(pairs if of_crowds is None else pairs.union(of_crowds))


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 3, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id of the component), n_links (links verified with its
    fingerprint; others within a component may exist)."""
    scratch = Scratch(spark, "simhash")
    rows = scratch.save(fingerprints(docs, width))
    nodes = scratch.save(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    links = links_between(nodes, scratch, crowd)
    roots = scratch.save(components(links, scratch))
    placed = scratch.save(nodes.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root")))
    least = scratch.save(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = with_names(placed.select("node", "root"), least, "root", scratch)
    named = scratch.save(named.join(degrees, "node", "left").select("node", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    out = with_names(rows, named, "node", scratch)
    return scratch.finish(out.select("doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id", "n_links"))
