"""Mixing sources to target weights by hierarchical budgets.

Documents are leaves' rows in a tree domain > language > source. A total budget of tokens (white-space words) flows from
the root by weights. What a child can't use (its tokens times ``max_epochs``) goes to its siblings by their weights; only
what no sibling can use goes back to the parent's siblings. A leaf takes whole passes over its rows and then a prefix
of one more: rows are ordered by a hash seeded with the pass, and the prefix ends before the row that would exceed the
budget.

The prefix is found without sorting a leaf: token sums over 256 ranges of the hash give the range in which the budget
ends, sums over 256 parts of it the part, and only that part (a 65,536th of the leaf) is put in order. The result is one
cut (hash, doc_id) a leaf, so choosing documents is a filter and their texts are not shuffled.

Leaves, their parents and cuts are tables, however many there are; nothing of them is held on the driver. A table of leaves
is broadcast if it has at most ``BROADCAST_LEAVES`` rows (counted first). Beyond, documents are joined with it by leaf and one
of ``SALTS`` salts, so that a leaf with most of the rows is dealt to many tasks. Budgets are divided by a window over the
children of a node: a row for each child, sorted and streamed, never the documents.

Null domains, languages and sources are leaves of their own. Null and empty texts have no tokens; they are chosen with the
prefix they fall in, not in a leaf without tokens. Rows that tie in hash and doc_id are chosen together, so repeated rows of
one doc_id at the cut may exceed the budget by their tokens. Texts of any length are counted whole. An empty table gives none.
A column of the input named as an added one (mix_domain, copies) is replaced by it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Scratch

LEVELS = ("domain", "lang", "source")
LOWEST = -(1 << 63)
#: Leaves that are broadcast at most (about 100 bytes each), and salts beyond.
BROADCAST_LEAVES, SALTS = 100_000, 32


@dataclass(frozen=True)
class Target:
    """Weights of the children of any node, by level; a name that isn't there has the weight ``default``."""

    domains: Mapping[str | None, float]
    languages: Mapping[str | None, float]
    sources: Mapping[str | None, float]
    default: float = 1.0


def poured(children: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Children (parent columns, name, weight, room, budget of the parent) with their own budget: shares by weight, none beyond
    its room; what is over goes to the others by weight. In order of room by weight, each child that its share fills leaves
    the rest to those after it, so the level that the others share is the greatest that any child is offered."""
    some = children.filter("weight > 0 and room > 0")
    of_parent = Window.partitionBy(*parent)
    later = of_parent.orderBy(F.col("room") / F.col("weight"), name).rowsBetween(0, Window.unboundedFollowing)
    before = of_parent.orderBy(F.col("room") / F.col("weight"), name).rowsBetween(Window.unboundedPreceding, -1)
    offered = (F.col("budget") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(later)
    level = F.max("offered").over(of_parent)
    return some.withColumn("offered", offered).withColumn("budget", F.least("room", F.greatest(F.lit(0.0), level) * F.col("weight"))).drop("offered")


def ordered(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place in a pass: a hash, shifted so that signed order is the order of its bits."""
    return F.xxhash64(F.lit(seed), epoch.cast("bigint"), doc_id).bitwiseXOR(F.lit(LOWEST).cast("bigint"))


def part_of(place: Column, level: int) -> Column:
    """The level-th eight bits of a place, from the top."""
    return F.shiftrightunsigned(place.bitwiseXOR(F.lit(LOWEST).cast("bigint")), 56 - 8 * level).bitwiseAND(255)


def same_leaf(a: DataFrame, b: DataFrame) -> Column:
    return a["domain"].eqNullSafe(b["domain"]) & a["lang"].eqNullSafe(b["lang"]) & a["source"].eqNullSafe(b["source"])


class Mixer:
    def __init__(self, spark: SparkSession, domain: Column, target: Target, share: float = 0.6, max_epochs: float = 2.0, seed: int = 1):
        self.spark, self.domain, self.target, self.share = spark, domain, target, share
        self.max_epochs, self.seed = max_epochs, seed

    def labelled(self, docs: DataFrame) -> DataFrame:
        id_ = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST + 1).cast("bigint"))
        return docs.select(id_.alias("id"), self.domain.alias("domain"), "lang", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")).cast("bigint").alias("tokens"))

    def with_leaf(self, rows: DataFrame, leaves: DataFrame) -> DataFrame:
        """Rows (id and leaf columns) with the other columns of their leaf's row; rows of other leaves go. ``leaves`` is saved."""
        if leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES:
            right, met = F.broadcast(leaves), same_leaf(rows, leaves)
        else:
            rows = rows.withColumn("salt_of_row", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
            right = leaves.withColumn("salt_of_leaf", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            met = same_leaf(rows, right) & (rows["salt_of_row"] == right["salt_of_leaf"])
        return rows.join(right, met).drop(*[leaves[c] for c in LEVELS]).drop("salt_of_row", "salt_of_leaf")

    def weight(self, level: int) -> Column:
        """The weight of a child by its name."""
        weights = (self.target.domains, self.target.languages, self.target.sources)[level]
        name, out = F.col(LEVELS[level]), F.lit(float(self.target.default))
        for k, v in weights.items():
            out = F.when(name.eqNullSafe(F.lit(k)), float(v)).otherwise(out)
        return out

    def budgets(self, supply: DataFrame) -> DataFrame:
        """Leaves (domain, lang, source, supply) with their budget in whole tokens, from the root down."""
        total = supply.agg(F.coalesce(F.sum("supply"), F.lit(0)).cast("double").alias("all"))
        above = total.select((F.col("all") * self.share).alias("budget"))
        for level in range(len(LEVELS)):
            parent, names = list(LEVELS[:level]), list(LEVELS[: level + 1])
            children = supply.groupBy(*names).agg(F.sum("supply").alias("supply")).withColumn("room", F.col("supply") * float(self.max_epochs)).withColumn("weight", self.weight(level))
            if level:
                met = reduce(and_, [children[c].eqNullSafe(above[c]) for c in parent])
                children = children.join(above, met).drop(*[above[c] for c in parent])
            else:
                children = children.join(F.broadcast(above))  # one row
            parted = poured(children, parent, names[-1])
            above = parted.select(*names, "budget")
        return parted.select(*LEVELS, "supply", F.floor(F.col("budget") + 1e-6).cast("bigint").alias("budget"))

    def cuts(self, docs: DataFrame, scratch: Scratch) -> DataFrame:
        """A row for each leaf that is used: domain, lang, source, epochs, cut, cut_id."""
        rows = scratch.save(self.labelled(docs))
        supply = scratch.save(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply")).filter("supply > 0"))
        plan = self.budgets(supply).withColumn("epochs", F.floor(F.col("budget") / F.col("supply"))).withColumn("rest", F.col("budget") % F.col("supply"))
        plan = scratch.save(plan.select(*LEVELS, "epochs", "rest"))
        seeking = scratch.save(plan.filter("rest > 0").select("*", F.lit(0).cast("bigint").alias("before"), F.lit(0).cast("bigint").alias("prefix")))
        for level in range(3):
            near = self.with_leaf(rows, seeking).withColumn("place", ordered(self.seed, F.col("epochs"), F.col("id")))
            for above in range(level):
                near = near.filter(part_of(F.col("place"), above) == F.shiftright("prefix", 8 * (level - 1 - above)).bitwiseAND(255))
            state = [*LEVELS, "epochs", "rest", "before", "prefix"]
            if level < 2:
                sums = near.groupBy(*state, part_of(F.col("place"), level).alias("part")).agg(F.sum("tokens").alias("tokens"))
                run = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("part")) + F.col("before")  # at most 256 a leaf
                reached = sums.withColumn("run", run).filter("run > rest").groupBy(*LEVELS).agg(F.min_by(F.struct("epochs", "rest", (F.col("run") - F.col("tokens")).alias("before"), (F.col("prefix") * 256 + F.col("part")).alias("prefix")), "part").alias("s"))
                seeking = scratch.save(reached.select(*LEVELS, "s.*"))
            else:
                run = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("place", "id")) + F.col("before")  # ties together
                taken = near.withColumn("run", run).filter("run <= rest").groupBy(*LEVELS).agg(F.max(F.struct("place", "id")).alias("m"))
                first = F.shiftleft("prefix", 48).bitwiseXOR(F.lit(LOWEST).cast("bigint"))
                ends = seeking.join(taken, same_leaf(seeking, taken), "left").select(*[seeking[c] for c in LEVELS], F.coalesce("m.place", first).alias("cut"), F.coalesce("m.id", F.lit(LOWEST).cast("bigint")).alias("cut_id"))
        none = F.lit(LOWEST).cast("bigint")
        found = plan.join(ends, same_leaf(plan, ends), "left").filter("epochs > 0 or rest > 0")
        return scratch.save(found.select(*[plan[c] for c in LEVELS], "epochs", F.coalesce("cut", none).alias("cut"), F.coalesce("cut_id", none).alias("cut_id")))

    def mixed(self, docs: DataFrame) -> DataFrame:
        """The chosen rows, all columns as they were, mix_domain, and copies (how often the mix has the row)."""
        scratch = Scratch(self.spark, "mixing")
        saved = self.cuts(docs, scratch)
        cuts = scratch.finish(saved)
        id_ = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST + 1).cast("bigint"))
        own = [c for c in docs.columns if c.lower() not in ("mix_domain", "copies")]
        rows = docs.select(F.struct(*own).alias("row"), id_.alias("id"), self.domain.alias("domain"), "lang", "source")
        rows = self.with_leaf(rows, cuts).withColumn("place", ordered(self.seed, F.col("epochs"), F.col("id")))
        inside = (F.col("place") < F.col("cut")) | (F.col("place") == F.col("cut")) & (F.col("id") <= F.col("cut_id"))
        rows = rows.withColumn("copies", F.col("epochs") + inside.cast("bigint")).filter("copies > 0")
        return rows.select("row.*", F.col("domain").alias("mix_domain"), F.col("copies"))


def domain_of(source: Column, domains: Sequence[str]) -> Column:
    """Domain by the number at the end of a source's name, dealt out in turn; null without a number."""
    number = F.regexp_extract(source, r"(\d+)$", 1).try_cast("int")
    return F.get(F.array(*map(F.lit, domains)), number % len(domains))
