"""Benchmark decontamination by spaced seeds.

Texts are lower-cased and cut into runs of letters and digits. A mask (such as 1101) is laid on every position of a document
and of a benchmark item; only the tokens under its ones are hashed, so a substituted token under a zero does no harm, and
several masks cover for one another. Equal hashes are hits. For each hit the item is aligned with the document at that
offset and all its tokens are compared. A pair is reported if

* at least ``share`` of the item's tokens stand at their places at one offset, or
* of some 13 tokens in a row of the item, at least 11 (80 %) do, however long the item is, or
* at least ``share`` of them stand in the item's order at offsets up to 8 apart, two of which have hits: words were inserted
  or left out.

``matched`` counts the tokens at the best single offset, and in the last case those of all offsets joined.

Masks are chosen by the lengths of the items so that no pair of the first two kinds is lost: a set of masks has all ways to place its weight
of ones within a span, and is taken for a length only if that many tokens in place can't be spread without that weight of
them falling within the span. That many tokens in place can't but give several hits at their offset, and the fewest they can
give are worked out for each length (``hits_needed``); a document's text is compared only for pairs with so many hits at one
offset, or with hits at two offsets to be joined. What lies in place is in the document, so short documents lose nothing either. Null or empty
texts have no tokens and match nothing. Texts may be of any length, and empty tables give no rows. Repeated rows are reported
once per (doc_id, item_id). Further columns of either table are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import cache
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, unused

#: A stretch of an item: so many tokens in a row, of which at least so many are in place (80 %).
STRETCH, STRETCH_LEAST = 13, 11
#: Offsets of one item are joined if they are no further apart.
JOINED = 8
#: Masks of one set at most, while a lower weight needs fewer; and their weight at most.
MOST_MASKS, MOST_WEIGHT = 10, 7
#: Hashes of the benchmark that are broadcast at most (24 bytes each); beyond, both sides are shuffled.
BROADCAST_HASHES = 200_000
#: Ids of documents with hits that are broadcast at most (8 bytes each), and salts of a larger benchmark's hashes.
BROADCAST_IDS, SALTS = 1_000_000, 16


def masks_within(weight: int, span: int) -> list[str]:
    """All masks of that weight and at most that span that begin and end with a one."""
    if weight == 1:
        return ["1"]
    ones = [{0, *c} for c in combinations(range(1, span), weight - 1)]
    return ["".join("1" if i in o else "0" for i in range(max(o) + 1)) for o in ones]


def surely_hit(n: int, least: int, weight: int, span: int) -> bool:
    """Whether any ``least`` of n places have ``weight`` within ``span``: most that avoid it stand weight - 1 in a span."""
    return least > (weight - 1) * (n // span) + min(weight - 1, n % span)


def least_in_place(n: int, share: float) -> int:
    """How many of n tokens make a leak, one at least; compared as the rows are."""
    return next((m for m in range(1, n) if m >= share * n), n)


#: The fewest hits are worked out within so many places at most; one of the equal stretches of a longer item has its share of them.
PLACES, MOST_SPAN = 64, 12


@cache
def fewest_hits(n: int, least: int, weight: int, span: int) -> int:
    """How often ``weight`` of any ``least`` of n places, however they are spread, fall within ``span``: a lower bound."""
    if span > MOST_SPAN:
        return int(surely_hit(n, least, weight, span))
    if n > PLACES:
        stretches = -(-n // PLACES)
        return fewest_hits(-(-n // stretches), -(-least // stretches), weight, span)
    # Place by place: which of the last span - 1 are taken, and for each number of places taken the fewest hits.
    states = {0: {0: 0}}
    for i in range(n):
        after: dict[int, dict[int, int]] = {}
        for taken, best in states.items():
            more = comb(taken.bit_count(), weight - 1)
            for k, hits in best.items():
                for bit in (0, 1):
                    if k + bit <= least <= k + bit + n - 1 - i:
                        to = after.setdefault((taken << 1 | bit) & ((1 << span - 1) - 1), {})
                        to[k + bit] = min(to.get(k + bit, hits + bit * more), hits + bit * more)
        states = after
    return min(best[least] for best in states.values())


def hits_needed(n: int, share: float) -> int:
    """Hits at one offset that an item of n tokens with ``share`` of them, or a stretch, in place has at least."""
    masks = masks_for(n, share)
    weight, span = masks[0].count("1"), max(map(len, masks))
    wanted = [(n, least_in_place(n, share))] + [(STRETCH, STRETCH_LEAST)] * (n >= STRETCH)
    return max(1, min(fewest_hits(k, m, weight, span) for k, m in wanted))


def masks_for(n: int, share: float) -> list[str]:
    """Masks that hit any item of n tokens with ``share`` of them, or a stretch, in place: the greatest weight that few masks serve."""
    least = least_in_place(n, share)
    wanted = [(n, least)] + [(STRETCH, STRETCH_LEAST)] * (n >= STRETCH)
    for weight in range(min(MOST_WEIGHT, *(m for _, m in wanted), n), 1, -1):
        for span in range(weight, n + 1):
            if comb(span - 1, weight - 1) > MOST_MASKS:
                break
            if all(surely_hit(k, m, weight, span) for k, m in wanted):
                return masks_within(weight, span)
    if least >= 2:  # weight 2 with as long a span as it takes
        return masks_within(2, next(s for s in range(2, n + 1) if surely_hit(n, least, 2, s)))
    return ["1"]


def mask_lengths(lengths: Iterable[int], share: float) -> dict[str, list[int]]:
    """The masks, each with the item lengths it serves."""
    out: dict[str, list[int]] = {}
    for n in sorted(lengths):
        for mask in masks_for(n, share):
            out.setdefault(mask, []).append(n)
    return out


def token_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def mask_hash(tokens: Column, at: Column, mask: str, m: int) -> Column:
    return F.xxhash64(F.lit(m), *[F.get(tokens, at + i) for i, c in enumerate(mask) if c == "1"])


def seeded(df: DataFrame, key: str, masks: Sequence[str], serves: Sequence[Sequence[int]] | None = None) -> DataFrame:
    """key, at, h: a row for each position and mask that fits there and, if given, serves texts of that length. The tokens
    are left behind with the first step."""
    if not masks:
        return df.select(key, F.lit(0).alias("at"), F.lit(0).cast("bigint").alias("h")).limit(0)
    least = min(map(len, masks))
    n = F.size("tokens")
    hashes = []
    for m, x in enumerate(masks):
        h = mask_hash(F.col("tokens"), F.col("at"), x, m)
        if len(x) > least:
            h = F.when(F.col("at") + len(x) <= n, h)
        hashes.append(h if serves is None else F.when(n.isin(list(serves[m])), h))
    placed = df.filter(n >= least).select(key, "tokens", F.explode(F.sequence(F.lit(0), n - least)).alias("at"))
    return placed.select(key, "at", F.array(*hashes).alias("hs")).select(key, "at", F.explode("hs").alias("h")).filter("h is not null")


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = 0.5) -> DataFrame:
    """Leaks: doc_id, item_id, matched (tokens at their places), item_tokens, overlap (matched / item_tokens)."""
    items = benchmark.select("item_id", "text").select("item_id", token_hashes(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0).distinct()
    lengths = [r[0] for r in items.select(F.size("tokens").alias("n")).distinct().collect()]
    serves = mask_lengths(lengths, share)
    masks = list(serves)
    keyed = seeded(items, "item_id", masks, list(serves.values())).select("h", "item_id", F.col("at").alias("item_at")).distinct()
    texts = docs.select("doc_id", "text").select("doc_id", token_hashes(F.col("text")).alias("tokens"))
    looked_up = seeded(texts, "doc_id", masks)
    if keyed.count() <= BROADCAST_HASHES:
        met = looked_up.join(F.broadcast(keyed), "h")
    else:
        salted = looked_up.withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int"))
        met = salted.join(keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["h", "salt"])
    hits = met.select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
    scratch = Scratch(docs.sparkSession, "decontam")
    hits = hits.groupBy("doc_id", "item_id", "shift").agg(F.count("*").alias("n"))  # a repeated row only adds to the hits
    hits = hits.groupBy("doc_id", "item_id").agg(F.sort_array(F.collect_list("shift")).alias("shifts"), F.max("n").alias("most"))
    needed = F.create_map(*[F.lit(x) for n in lengths for x in (n, hits_needed(n, share))]) if lengths else F.create_map(F.lit(0), F.lit(0))
    needs = items.groupBy("item_id").agg(F.min(F.element_at(needed, F.size("tokens"))).alias("needed"))
    near = F.exists(F.transform("shifts", lambda s, j: F.get("shifts", j + 1) - s), lambda gap: gap <= JOINED)
    hits = scratch.save(hits.join(needs, "item_id").filter((F.col("most") >= F.col("needed")) | near).select("doc_id", "item_id", "shifts"))
    ids = hits.select(F.col("doc_id").alias("of")).distinct()
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    found = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
    found = found.select("doc_id", token_hashes(F.col("text")).alias("tokens"))
    sought = hits.join(items.withColumnRenamed("tokens", "item"), "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "shifts", "item")).alias("hits"))  # the hits of one document
    both = found.join(sought.withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of")))

    def at_offset(hit: Column, shift: Column) -> Column:
        """How many tokens are in place, and whether a stretch of them is."""
        places = F.filter(F.sequence(F.lit(0), F.size(hit["item"]) - 1), lambda i: F.get("tokens", i + shift) == F.get(hit["item"], i))

        def told(same: Column) -> Column:  # a lambda's variable is computed once
            close = F.size(F.filter(same, lambda p, j: F.get(same, j + (STRETCH_LEAST - 1)) - p < STRETCH)) > 0
            return F.struct(F.size(same).alias("n"), (close & (F.size(hit["item"]) >= STRETCH)).alias("stretch"))

        return F.get(F.transform(F.array(places), told), F.lit(0))

    def anywhere(hit: Column, base: Column) -> Column:
        """How many of the item's tokens stand at any of the offsets that are joined: no less than joined() finds."""
        return F.size(F.filter(F.sequence(F.lit(0), F.size(hit["item"]) - 1), lambda i: F.array_contains(F.slice("tokens", F.greatest(F.lit(0), i + base) + 1, F.greatest(F.lit(0), JOINED + 1 + F.least(F.lit(0), i + base))), F.get(hit["item"], i))))

    def joined(hit: Column, base: Column) -> Column:
        """Most tokens in the item's order at the offsets base to base + JOINED. A state is the rows of the last steps, the
        newest first: the most with the last token at each offset. From a higher offset one gets down by leaving out tokens."""
        width = JOINED + 1
        offsets = F.sequence(F.lit(0), F.lit(JOINED))

        def step(rows: Column, i: Column) -> Column:
            reach = lambda o: F.array_max(F.transform(offsets, lambda p: F.get(F.get(rows, F.greatest(F.lit(0), p - o)), p)))
            same = lambda o: F.coalesce(F.get("tokens", i + base + o) == F.get(hit["item"], i), F.lit(False)).cast("int")
            return F.concat(F.array(F.transform(offsets, lambda o: reach(o) + same(o))), F.slice(rows, 1, JOINED))

        nothing = F.array_repeat(F.array_repeat(F.lit(0), width), width)
        return F.aggregate(F.sequence(F.lit(0), F.size(hit["item"]) - 1), nothing, step, lambda rows: F.array_max(F.get(rows, F.lit(0))))

    def judged(hit: Column) -> Column:
        return F.struct(hit["item_id"].alias("item_id"), hit["item"].alias("item"), hit["shifts"].alias("shifts"), F.transform(hit["shifts"], lambda s: at_offset(hit, s)).alias("at"))

    def told(hit: Column) -> Column:
        n = F.size(hit["item"])
        most = F.array_max(F.transform(hit["at"], lambda a: a["n"]))
        leaks = (most >= F.lit(share) * n) | F.exists(hit["at"], lambda a: a["stretch"])
        near = F.filter(hit["shifts"], lambda s, j: (F.get(hit["shifts"], j + 1) - s <= JOINED) & (anywhere(hit, s) >= F.lit(share) * n))
        together = F.array_max(F.filter(F.transform(near, lambda s: joined(hit, s)), lambda m: m >= F.lit(share) * n))
        matched = F.when(leaks, most).otherwise(together)
        return F.struct(hit["item_id"].alias("item_id"), matched.cast("bigint").alias("matched"), n.cast("bigint").alias("item_tokens"))

    rows = both.select("doc_id", "tokens", F.transform("hits", judged).alias("hits")).select("doc_id", F.transform("hits", told).alias("found")).select("doc_id", F.inline("found"))
    best = rows.filter("matched is not null").groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("item_tokens").alias("item_tokens"))
    return best.withColumn("overlap", F.col("matched") / F.col("item_tokens"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a leak, all columns as they were."""
    leaked = unused("leaked", docs)
    leaks = decontaminate(docs, benchmark, **options).select(F.col("doc_id").alias(leaked)).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col(leaked)), "left_anti")
