r"""Near-duplicate documents by bottom-k sketches.

A document is the set of its w-word shingles (A-Z lower-cased, words parted by ASCII white space; with fewer than w
words, the whole sequence as one shingle; without words, the empty set, which is linked with nothing). Documents are
linked if 100 * |A and B| >= percent * |A or B|; the result is the connected components.

1. One 64-bit hash per shingle; the k least are the sketch. Documents with the same set form one class, which is handled
   once, so exact copies cost nothing more.
2. Inverted lists of retained values generate overlaps. Two linked classes share at least ``ceil(0.4 * s)`` retained
   values (s: the larger sketch), but for a chance of 2e-7 at the threshold itself with k = 32 and far less above it.
   So it is enough to list each class under its s - ceil(0.4 * s) + 1 rarest values: a passage that many documents share
   gives frequent values, which are not listed unless a class has little else.
3. Every list first compares all its members with one of them, the pivot: the one with the fewest values of its own, as
   the origin of a group of edited copies has. The sketch of the union, the k least of both, estimates the likeness: pairs
   with fewer than 0.4 of it in common are dropped (the same chance as in 2). The rest are verified on the exact sets of
   the whole texts. Members that are connected by then need no further comparison among themselves.
4. What is left are pairs in different components of a list. For the classes of such lists the full sets are joined by an
   exact prefix filter: a pair that is alike enough shares an element among the rarest few of both, at places that leave
   room for the overlap it needs. An edited copy with too many words of its own meets nothing that way. These lists, too,
   are first compared with a pivot each, and again with another, and pairs are made only of what is in different components
   after that. So components are exact without all pairs of a large group. Candidates are verified as above.
5. Components by alternating large-star and small-star steps, joins and minima of (node, node) rows. Links found later
   are taken between the components known by then.

6. Names go back to the rows by node. A node, or root, with over a ``LARGE``-th of the rows is looked up by a broadcast of such
   nodes, of which there are ``LARGE`` at most, and the others by a join, so that no group of copies lands in one task.

Nodes are 64-bit digests of the set. Rows with null text or doc_id get a row like others; a null doc_id is never the
least of a component that has another. Repeated rows are in one class. Texts of any length are taken whole. An empty table gives
none. Nothing of the documents is collected. Further columns of the input are not looked at, and ``keep_one`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, kept, rows_of, unused

K = 32
SHARED = 0.4
#: Turns in which lists of the prefix filter meet with a pivot each, before pairs are made of what is still apart.
PIVOT_TURNS = 2
#: A key with more than this share of the rows is joined apart from the others, or by so many parts.
LARGE, HOT_PARTS = 10_000, 64
EDGES_A_TASK = 1_000_000  # 16 bytes each: so the tables of a star step have as many files as they need
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))  # multipliers of a public 64-bit finaliser
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX[0]
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX[1]
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, width: int, remembered: int = 150_000):
        self.width, self.remembered = width, remembered
        self.words: dict[bytes, int] = {}

    def _ids(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.words, xxhash.xxh3_64_intdigest
        if len(known) > self.remembered:
            known.clear()
        try:
            ids = [known[w] for w in words]
        except KeyError:
            ids = []
            for w in words:
                if (x := known.get(w)) is None:
                    x = known[w] = digest(w)
                ids.append(x)
        return np.array(ids, np.uint64)

    def hashes(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only
        if not words:
            return np.empty(0, np.uint64)
        ids = self._ids(words)
        n = max(1, len(words) - self.width + 1)
        if len(words) < self.width:
            h = np.array([len(words)], np.uint64)
            for x in ids:
                h = _mixed(h * _STEP + x)
            return h
        h = np.zeros(n, np.uint64)
        for i in range(self.width):
            h = _mixed(h * _STEP + ids[i : i + n])
        return np.unique(h)


SKETCHES = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("sketch", pa.list_(pa.int64()))])


def sketches(docs: DataFrame, width: int, k: int = K) -> DataFrame:
    """doc_id, text_hash, n (size of the set), node (digest of the set; null if empty), sketch (the k least, ascending).
    Hashes are shifted by 2 ** 63, so that signed order is theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = kept("shingler", width, lambda: Shingler(width))
        for ids, texts, text_hashes in rows_of(batches):
            out = []
            for doc_id, text, text_hash in zip(ids, texts, text_hashes, strict=True):
                h = shingler.hashes(text)
                node = xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63) if len(h) else None
                out.append((doc_id, text_hash, len(h), node, (h[:k] ^ np.uint64(1 << 63)).view(np.int64).tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), SKETCHES, strict=True)], schema=SKETCHES)

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return source.mapInArrow(run, "doc_id bigint, text_hash bigint, n bigint, node bigint, sketch array<bigint>")


def listed(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """value, node, n, own (retained values that no other class has): each class under its rarest values that another has too."""
    values = classes.select("node", "n", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    often = scratch.save(values.groupBy("value").count().filter("count > 1"))  # a table: both sides of the join are then dealt anew, and a frequent value is split
    common = values.join(often, "value").groupBy("node", "n", "s").agg(F.sort_array(F.collect_list(F.struct("count", "value"))).alias("found"))  # at most k each
    rare = F.col("s") - F.size("found")  # values of its own take the first places
    places = F.col("s") - F.ceil(SHARED * F.col("s")) + 1 - rare
    out = common.filter(places > 0).select("node", "n", rare.alias("own"), F.explode(F.slice("found", 1, places.cast("int"))).alias("f"))
    kept = scratch.save(out.select(F.col("f.value").alias("value"), "node", "n", "own"))
    scratch.drop(often)
    return kept


def alike_sizes(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _with_ends(pairs: DataFrame, nodes: DataFrame, field: str, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) with ``field`` of both nodes as field_a and field_b. A pivot can stand in most pairs: an end of more than a
    ``LARGE``-th of them is dealt by the pair's other end over ``HOT_PARTS`` parts, and its row of ``nodes`` goes to each."""
    most = pairs.count() // LARGE
    out = pairs
    for c, other in (("a", "b"), ("b", "a")):
        hot = scratch.save(pairs.groupBy(c).count().filter(F.col("count") > most + HOT_PARTS).select(c, F.lit(True).alias("hot")))  # fewer than LARGE rows
        dealt = out.join(F.broadcast(hot), c, "left").withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64(other), F.lit(HOT_PARTS))).otherwise(0)).drop("hot")
        side = nodes.select(F.col("node").alias(c), F.col(field).alias(f"{field}_{c}")).join(F.broadcast(hot), c, "left")
        parts = F.sequence(F.lit(0).cast("bigint"), F.when(F.col("hot"), HOT_PARTS - 1).otherwise(0).cast("bigint"))
        out = dealt.join(side.withColumn("part", F.explode(parts)).drop("hot"), [c, "part"]).drop("part")
    return out


def estimated(pairs: DataFrame, classes: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """Of pairs (a, b), those whose union sketch has enough in common."""
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    shared = F.size(F.array_intersect(union, F.array_intersect("sketch_a", "sketch_b")))
    return _with_ends(pairs, classes, "sketch", scratch).filter(shared >= F.ceil(SHARED * F.size(union))).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """Of pairs (a, b), those linked on the full sets. ``texts``: node, text of a representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sets = kept("shingler", width, lambda: Shingler(width)), {}
        for lefts, rights, left_texts, right_texts in rows_of(batches, 64):
            keep: list[tuple[int, int]] = []
            for a, b, ta, tb in zip(lefts, rights, left_texts, right_texts, strict=True):
                x, y = (sets[n] if n in sets else sets.setdefault(n, shingler.hashes(t)) for n, t in ((a, ta), (b, tb)))
                inter = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * inter >= percent * (len(x) + len(y) - inter):
                    keep.append((a, b))
            sets = {n: sets[n] for n in (lefts[-1], rights[-1])}  # a pivot stands in many rows
            if keep:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*keep, strict=True)], names=["a", "b"])

    return _with_ends(pairs, texts, "text", scratch).select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the least node that it reaches) for all nodes of ``links`` (a, b)."""

    def stars(edges: DataFrame, large: bool, parts: int) -> DataFrame:
        both = edges.union(edges.select("v", "u")) if large else edges
        low = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), parts)
        near = both.join(low, "u")
        if large:
            out = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        turned = scratch.save(out.filter("u != v").distinct(), parts)
        scratch.drop(low)
        return turned

    def unsettled(edges: DataFrame) -> int:
        """Nodes that point to two others, or that point to one and are pointed to. Without any, each edge leads to its root."""
        end = lambda c, out: F.struct(F.col(c).alias("node"), F.lit(out).alias("out"), F.lit(1 - out).alias("in"))
        ends = edges.select(F.inline(F.array(end("u", 1), end("v", 0))))
        at = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
        return at.filter("out + in > 1 and out > 0").count()

    edges = scratch.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    parts = max(scratch.spark.sparkContext.defaultParallelism, edges.count() // EDGES_A_TASK + 1)
    while unsettled(edges):
        wide = stars(edges, True, parts)
        turned = stars(wide, False, parts)
        scratch.drop(edges, wide)
        edges = turned
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def joined_up(roots: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``roots`` (node, root) after further ``links`` (a, b): only what these join is gone through again."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).filter("a != b")
    moved = scratch.save(components(between, scratch))
    known = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return scratch.save(known.union(moved.join(roots.select("node"), "node", "left_anti").select("node", "root")))


def prefixes(parts: DataFrame, texts: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """hash, place, node, n: the rarest hashes of each full set that others share, up to the last place that can be the
    first in common with a set alike enough. Places count from 1 in order of (how many sets have it, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = kept("shingler", width, lambda: Shingler(width))
        for nodes, bodies in rows_of(batches, 64):
            if nodes:
                sets = [shingler.hashes(t).view(np.int64) for t in bodies]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "hashes"])

    inside = parts.distinct()
    sets = scratch.save(texts.join(inside, "node").select("node", "text").mapInArrow(run, "node bigint, hashes array<bigint>"))
    rows = sets.select("node", F.size("hashes").alias("n"), F.explode("hashes").alias("hash"))
    often = scratch.save(rows.groupBy("hash").count().filter("count > 1"))
    found = rows.join(often, "hash").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("count", "hash"))).alias("found"))  # a set's own size
    own = F.col("n") - F.size("found")
    last = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    out = found.filter(last > own).select("node", "n", own.alias("own"), F.posexplode(F.slice("found", 1, (last - own).cast("int"))).alias("i", "f"))
    out = scratch.save(out.select(F.col("f.hash").alias("hash"), (F.col("own") + F.col("i") + 1).alias("place"), "node", "n"))
    scratch.drop(sets, often)
    return out


def with_names(rows: DataFrame, names: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """Rows joined with names, one for each key. Keys of many rows are broadcast with their names: at most ``LARGE``."""
    most = rows.count() // LARGE
    large = scratch.save(rows.groupBy(key).count().filter(F.col("count") > most).select(key))
    keyed = names.join(F.broadcast(large), key, "left_semi")
    hot = rows.join(F.broadcast(keyed), key)
    return hot.unionByName(rows.join(F.broadcast(large), key, "left_anti").join(names, key))


def near_duplicates(spark: SparkSession, docs: DataFrame, width: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id of the component), kept (doc_id = component_id), n_links (pairs
    verified with its class; further links within a component may exist)."""
    scratch = Scratch(spark, "neardup")
    rows = scratch.save(sketches(docs, width, k))
    least_id = F.lit(-(1 << 63)).cast("bigint")  # stands for a null doc_id in joins
    heads = rows.filter("n > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n", "sketch")).alias("h"))
    classes = scratch.save(heads.select("node", "h.doc_id", "h.text_hash", "h.n", "h.sketch"))
    lists = listed(classes, scratch)

    def pairs_of(met: DataFrame, a: str, b: str) -> DataFrame:
        return met.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()

    # every list's members with its pivot
    order = F.struct("own", F.xxhash64("node").alias("o"), "node", "n")
    pivots = scratch.save(lists.groupBy("value").agg(F.min(order).alias("p"), F.count("*").alias("members")).filter("members > 1").select("value", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn")))
    met = lists.join(pivots, "value").filter((F.col("node") != F.col("pivot")) & alike_sizes(F.col("n"), F.col("pn"), percent))
    candidates = scratch.save(pairs_of(met, "node", "pivot"))
    members = lists.select("node").distinct()
    reps = classes.join(members, "node").select("node", F.coalesce("doc_id", least_id).alias("rep"), "text_hash")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), least_id).alias("rep"), F.xxhash64("text").alias("text_hash"), "text")
    scope = scratch.save(texts.join(reps, ["rep", "text_hash"]).dropDuplicates(["rep", "text_hash"]).select("node", "text"))
    tested = scratch.save(estimated(candidates, classes, k, scratch))  # what is dropped here may still come up below
    links = scratch.save(verified(tested, scope, width, percent, scratch))
    roots = scratch.save(components(links, scratch))

    # what lists hold of several components: the prefixes of their full sets, first with pivots, then all
    placed = scratch.save(lists.join(roots, "node", "left").select("value", "node", F.coalesce("root", "node").alias("root")))
    mixed = scratch.save(placed.groupBy("value").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 != r1").select("value"))
    parts = scratch.save(placed.join(mixed, "value").select("node"))
    front = prefixes(parts, scope, width, percent, scratch)
    need = lambda n, m: F.ceil(F.lit(percent) * (n + m) / (100 + percent))
    for turn in range(PIVOT_TURNS + 1):
        known = scratch.save(front.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
        best = F.min(F.struct("place", F.xxhash64("node", F.lit(turn)).alias("o"), "node", "n", "root"))
        heads = scratch.save(known.groupBy("hash").agg(best.alias("p"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 != r1").select("hash", "p"))
        if turn < PIVOT_TURNS:
            p = lambda c: F.col(f"p.{c}")
            room = (F.col("place") <= F.col("n") - need(F.col("n"), p("n")) + 1) & (p("place") <= p("n") - need(F.col("n"), p("n")) + 1)
            met = known.join(heads, "hash").filter((F.col("root") != p("root")) & alike_sizes(F.col("n"), p("n"), percent) & room)
            pairs = pairs_of(met, "node", "p.node")
        else:
            left = scratch.save(known.join(heads.select("hash"), "hash"))
            side = lambda c: left.select("hash", *[F.col(x).alias(f"{x}_{c}") for x in ("place", "node", "n", "root")])  # noqa: B023, E731
            least_shared = need(F.col("n_x"), F.col("n_y"))
            room = (F.col("place_x") <= F.col("n_x") - least_shared + 1) & (F.col("place_y") <= F.col("n_y") - least_shared + 1)
            met = side("x").join(side("y"), "hash").filter((F.col("node_x") > F.col("node_y")) & (F.col("root_x") != F.col("root_y")) & alike_sizes(F.col("n_x"), F.col("n_y"), percent) & room)
            pairs = pairs_of(met, "node_x", "node_y")
        fresh = scratch.save(pairs.join(tested, ["a", "b"], "left_anti"))
        further = scratch.save(verified(fresh, scope, width, percent, scratch))
        links, tested = links.union(further), tested.union(fresh)
        roots = joined_up(roots, further, scratch)
    placed = scratch.save(classes.select("node", "doc_id").join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root")))
    least = scratch.save(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = with_names(placed.select("node", "root"), least, "root", scratch)
    named = scratch.save(named.join(degrees, "node", "left").select("node", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    out = with_names(rows.filter("n > 0").select("doc_id", F.col("n").alias("n_shingles"), "node"), named, "node", scratch).select("doc_id", "n_shingles", "component_id", "n_links")
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links"))
    return scratch.finish(out.union(alone).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "n_links"))


def keep_one(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The documents that are kept, all columns as they were; of rows that share a kept doc_id, all stay."""
    gone = unused("gone", docs)
    dropped = near_duplicates(spark, docs, **options).filter("not kept").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, F.col("doc_id") == F.col(gone), "left_anti")
