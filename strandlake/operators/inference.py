"""Resampling: clustered bootstrap, jackknife, permutation tests, corrected intervals and false-discovery control.

Replicates are rows. Scores are first summed to (cluster, score) counts, so a replicate multiplies counts and not rows.
Draws come from hashes of (seed, replicate, key): they don't depend on how rows are dealt.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import draw, normal_cdf, normal_quantile, normal_quantile_of
from ..functions.running import RANGE, running_totals, with_ranges
from .metrics import _total, auc_or_half, auc_roc, by_score


def beside(df: DataFrame, figures: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Rows with the figures of their group (a row a group), or with those of one row, as a scalar subquery."""
    if groups:
        return df.join(figures, list(groups))
    one = figures.select(F.struct(*figures.columns).alias("s")).scalar()
    return df.withColumn("_one", one).select("*", *[F.col(f"_one.{c}").alias(c) for c in figures.columns]).drop("_one")


def cluster_counts(df: DataFrame, cluster: str, groups: Sequence[str] = ()) -> DataFrame:
    ranges = [RANGE] if RANGE in df.columns else []
    return df.groupBy(*groups, F.col(cluster).alias("cluster"), "p", *ranges).agg(F.sum((F.col("y") == 1).cast("bigint")).alias("pos"), F.sum((F.col("y") != 1).cast("bigint")).alias("neg"))


def numbered(df: DataFrame, cluster: str, groups: Sequence[str] = ()) -> DataFrame:
    """groups, cluster, number from 0 in order of name, clusters (how many); one row a cluster."""
    by = Window.partitionBy(*groups)
    names = df.select(*groups, F.col(cluster).alias("cluster")).distinct()
    return names.withColumn("number", F.row_number().over(by.orderBy("cluster")).cast("bigint") - 1).withColumn("clusters", F.count("*").over(by))


def resampled_clusters(df: DataFrame, cluster: str, replicates: int, seed: int = 0, groups: Sequence[str] = ()) -> DataFrame:
    """groups, b, cluster, times: as many clusters as there are, drawn with replacement, for each replicate. Each cluster's row
    makes the draw of the slot with its number, so no task holds all slots of a replicate. A group needs two clusters."""
    names = numbered(df, cluster, groups)
    enough = F.when(F.col("clusters") >= 2, True).otherwise(F.raise_error(F.lit("a clustered bootstrap needs two clusters")).cast("boolean"))
    slots = names.filter(enough).withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(replicates - 1).cast("bigint"))))
    drawn = slots.select(*groups, "b", F.floor(draw(F.lit(seed), F.col("b"), F.col("number")) * F.col("clusters")).alias("number"))
    times = drawn.groupBy(*groups, "b", "number").agg(F.count("*").alias("times"))
    return times.join(names, [*groups, "number"]).select(*groups, "b", "cluster", "times")


#: Over so many tasks replicates multiply counts, whichever of the two is broadcast.
TASKS = 128


def _resampled(df: DataFrame, cluster: str, replicates: int, seed: int, groups: Sequence[str]) -> DataFrame:
    """groups, b, p, y, w: the weighted score counts of each replicate, and the ranges of scores, made once for all replicates."""
    drawn = resampled_clusters(df, cluster, replicates, seed, groups)
    sides = F.explode(F.array(F.struct(F.lit(1).alias("y"), F.col("pos").alias("c")), F.struct(F.lit(0).alias("y"), F.col("neg").alias("c")))).alias("s")
    counts = with_ranges(cluster_counts(df, cluster, groups), "p")
    drawn, counts = drawn.repartition(TASKS, "b"), counts.repartition(TASKS, RANGE)  # both are small, but not what they make together
    rows = drawn.join(counts, [*groups, "cluster"]).select(*groups, "b", "p", RANGE, "times", sides)
    return rows.filter("s.c > 0").groupBy(*groups, "b", "p", RANGE, F.col("s.y").alias("y")).agg(F.sum(F.col("times") * F.col("s.c")).alias("w"))


def bootstrap_auc(df: DataFrame, cluster: str, replicates: int = 2000, seed: int = 0, groups: Sequence[str] = ()) -> DataFrame:
    """groups, b, stat."""
    rows = _resampled(df, cluster, replicates, seed, groups)
    return auc_roc(rows, [*groups, "b"], weight="w").select(*groups, "b", auc_or_half(F.col("auc")).alias("stat"))


def bootstrap_ece(df: DataFrame, cluster: str, bins: int = 15, replicates: int = 2000, seed: int = 0, groups: Sequence[str] = ()) -> DataFrame:
    """groups, b, stat: the calibration error of each replicate; 0 with fewer rows than bins. Equal scores are cut between bins by
    their mean outcome, as rows of one score have no order in a replicate."""
    by = [*groups, "b"]
    scores = _resampled(df, cluster, replicates, seed, groups).groupBy(*by, "p", RANGE).agg(F.sum("w").alias("w"), F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0)).alias("pos"))
    totals = scores.groupBy(*by).agg(F.sum("w").alias("all"))
    scores = running_totals(scores, "p", [], {"from": "w"}, by).join(totals, by)
    size, extra = F.floor(F.col("all") / bins), F.col("all") % bins
    bin_of = lambda place: F.least(F.when(place < (size + 1) * extra, F.floor(place / (size + 1))).otherwise(extra + F.coalesce(F.floor(F.try_divide(place - (size + 1) * extra, size)), F.lit(0))), F.lit(bins - 1))
    first = lambda k: size * k + F.least(k, extra)
    parts = scores.select(*by, "p", "w", "pos", "all", "from", F.explode(F.sequence(bin_of(F.col("from")), bin_of(F.col("from") + F.col("w") - 1))).alias("k"))
    inside = F.least(F.col("from") + F.col("w"), first(F.col("k") + 1)) - F.greatest("from", first(F.col("k")))
    parts = parts.withColumn("n", inside).filter("n > 0")
    gaps = parts.groupBy(*by, "k").agg(F.sum("n").alias("n"), F.abs(F.sum(F.col("n") * F.col("p")) - F.sum(F.col("n") * F.col("pos") / F.col("w"))).alias("gap"), F.max("all").alias("all"))
    return gaps.groupBy(*by).agg(F.when(F.max("all") >= bins, F.sum("gap") / F.sum("n")).otherwise(0.0).alias("stat"))


def jackknife_auc(df: DataFrame, cluster: str, groups: Sequence[str] = ()) -> DataFrame:
    """groups, cluster, stat without it, in closed form: all wins of positives over negatives, less those that the cluster's
    rows have a part in, which are its positives' over all negatives and all positives' over its negatives, less the wins
    within it, counted twice. So no replicate repeats the rows."""
    counts = with_ranges(cluster_counts(df, cluster, groups), "p")
    scores = counts.groupBy(*groups, "p", RANGE).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    scores = running_totals(scores, "p", [], {"below": "neg", "under": "pos"}, groups)
    whole = _total(scores, groups, F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("wins"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    at = scores.select(*groups, "p", (F.col("below") + F.col("neg") / 2).alias("beaten"), (F.col("under") + F.col("pos") / 2).alias("not_above"))
    within = running_totals(counts, "p", [], {"own": "neg"}, [*groups, "cluster"]).withColumn("own", F.col("own") + F.col("neg") / 2)
    rows = within.drop(RANGE).join(at, [*groups, "p"])
    own = rows.groupBy(*groups, "cluster").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("pos") * F.col("beaten")).alias("won"),
        F.sum("neg").alias("_n"), F.sum(F.col("neg") * F.col("not_above")).alias("at_or_under"), F.sum(F.col("pos") * F.col("own")).alias("within"),
    )
    own = beside(own, whole, groups)
    lost = F.col("neg") * F.col("n_pos") - F.col("at_or_under")  # all positives over its negatives
    left = (F.col("n_pos") - F.col("pos")) * (F.col("n_neg") - F.col("neg"))
    stat = F.when(left > 0, (F.col("wins") - F.col("won") - lost + F.col("within")) / left).otherwise(0.5)
    return own.select(*groups, "cluster", stat.alias("stat"))


def acceleration(jack: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The skewness of the jackknife statistic, by a sixth; 0 if it doesn't vary. A row, or a row a group."""
    means = _total(jack, groups, F.avg("stat").alias("m"))
    got = beside(jack, means, groups).withColumn("c", F.col("m") - F.col("stat"))
    got = _total(got, groups, F.sum(F.pow("c", 3)).alias("s3"), F.sum(F.pow("c", 2)).alias("s2"))
    return got.select(*groups, F.when(F.col("s2") <= 1e-30, 0.0).otherwise(F.try_divide(F.col("s3"), 6 * F.pow("s2", 1.5))).alias("acceleration"))


def bca_intervals(boot: DataFrame, jack: DataFrame, estimates: DataFrame, groups: Sequence[str] = (), alpha: float = 0.05, estimate: str = "auc") -> DataFrame:
    """groups, estimate, ci_low, ci_high: bias-corrected and accelerated end points, linear quantiles of ``boot`` at the
    adjusted levels. ``estimates`` has a row a group, or one. Replicates of a group, a bounded number, are sorted in one array."""
    seen = beside(boot, estimates.select(*groups, F.col(estimate).alias("estimate")), groups)
    got = _total(seen, groups, F.first("estimate").alias(estimate), F.count("*").alias("n"), F.avg((F.col("stat") < F.col("estimate")).cast("double")).alias("below"), F.sort_array(F.collect_list("stat")).alias("stats"))
    got = beside(got, acceleration(jack, groups), groups)
    edge = 1 / (2 * F.col("n"))
    z0 = normal_quantile_of(F.least(1 - edge, F.greatest(edge, F.col("below"))))

    def end(level: float) -> Column:
        z = F.col("z0") + normal_quantile(level)
        at = normal_cdf(F.col("z0") + z / (1 - F.col("acceleration") * z)) * (F.col("n") - 1)
        low = F.floor(at).cast("int")
        below, above = F.get("stats", low), F.coalesce(F.get("stats", low + 1), F.get("stats", low))
        return below + (at - low) * (above - below)

    return got.withColumn("z0", z0).select(*groups, estimate, end(alpha / 2).alias("ci_low"), end(1 - alpha / 2).alias("ci_high"))


#: Cells of [0, 1) that draws are counted in, to find where the positives of a replicate end.
CELLS = 1024


def shuffled_labels(df: DataFrame, row_id: str, replicates: int, seed: int = 0, groups: Sequence[str] = ()) -> DataFrame:
    """groups, b, p, y, w: score counts under shuffled labels. In each replicate the rows with the least draws take the
    positives. Draws are counted by cell; rows below the cell in which the positives end take one each, rows above it none,
    and only the rows in it, a ``CELLS``-th, are ranked. So no task sorts all rows of a replicate."""
    drawn = with_ranges(df.select(*groups, F.col(row_id).alias("id"), "p", "y"), "p").withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(replicates - 1).cast("bigint"))))
    drawn = drawn.withColumn("d", draw(F.lit(seed), F.col("b"), F.col("id"))).withColumn("cell", F.floor(F.col("d") * CELLS))
    cells = drawn.groupBy(*groups, "b", "cell").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    by = Window.partitionBy(*groups, "b")
    cells = cells.withColumn("all_pos", F.sum("pos").over(by)).withColumn("to", F.sum("n").over(by.orderBy("cell")))  # at most CELLS a replicate
    ends = cells.filter("to >= all_pos and to - n < all_pos or all_pos = 0 and to = n").select(*groups, "b", F.col("cell").alias("end"), (F.col("all_pos") - F.col("to") + F.col("n")).alias("rest"))
    placed = drawn.join(ends, [*groups, "b"])
    side = F.signum(F.col("cell") - F.col("end")).cast("int")
    at_end = lambda c: F.when(side == 0, F.col(c))
    kinds = placed.groupBy(*groups, "b", "rest", side.alias("side"), "p", RANGE, at_end("d").alias("d"), at_end("id").alias("id")).agg(F.count("*").alias("w"))
    rank = F.sum("w").over(Window.partitionBy(*groups, "b", "side").orderBy("d", "id", "p").rowsBetween(Window.unboundedPreceding, 0))
    y = F.when(F.col("side") < 0, 1).when(F.col("side") > 0, 0).otherwise((rank <= F.col("rest")).cast("int"))
    return kinds.select(*groups, "b", "p", RANGE, y.alias("y"), "w")


#: numpy's hypergeometric draws are exact up to here.
MOST_ROWS = 1_000_000_000


def _generator(seed: int, *key: object) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(repr(key).encode())])


def counted_permutation_auc(df: DataFrame, replicates: int = 1000, seed: int = 0, groups: Sequence[str] = ()) -> DataFrame:
    """groups, b, stat under shuffled labels, as ``permutation_auc``, by counted draws: how many positives each score gets is
    multivariate hypergeometric. Each replicate first splits a group's positives over the ranges of scores, and each range's over
    its scores, so a replicate costs scores and not rows, and no row is repeated. A task has one range's scores for all replicates;
    what goes between the two steps is a row a range with two numbers a replicate. Draws are seeded by group, range and replicate, so results
    don't depend on how rows are dealt. Groups of up to a thousand million rows."""
    scores = by_score(df, groups)
    scores = scores if RANGE in scores.columns else with_ranges(scores, "p")
    keys = [*groups, RANGE]
    scores = scores.select(*keys, "p", (F.col("pos") + F.col("neg")).alias("n"), "pos").withColumn("_g", F.lit(0))
    kinds = dict(scores.dtypes)
    ddl = "".join(f"`{g}` {kinds[g]}, " for g in groups)
    named = list(groups)

    def dealt(table: pa.Table) -> pa.Table:
        table = table.sort_by(RANGE)
        n, positives = table.column("n").to_numpy(), int(table.column("pos").to_numpy().sum())
        if n.sum() > MOST_ROWS:
            raise ValueError("a group of over a thousand million rows: take permutation_auc")
        rng = _generator(seed, *[table.column(g)[0].as_py() for g in named])
        got = rng.multivariate_hypergeometric(n, positives, size=replicates, method="marginals").T  # a row a range
        lower = np.cumsum(n) - n
        negatives = lower[:, None] - (np.cumsum(got, axis=0) - got)
        out = {g: table.column(g) for g in named} | {RANGE: table.column(RANGE), "took": pa.array(list(got), pa.list_(pa.int64())), "below": pa.array(list(negatives), pa.list_(pa.int64()))}
        return pa.table(out)

    def won(table: pa.Table, heads: pa.Table) -> pa.Table:
        table = table.sort_by("p")
        n, about = table.column("n").to_numpy(), [table.column(g)[0].as_py() for g in named]
        took, below = heads.column("took")[0].values.to_numpy(), heads.column("below")[0].values.to_numpy()
        rng = _generator(seed, *about, table.column(RANGE)[0].as_py())
        twice = np.empty(replicates, np.int64)
        for b in range(replicates):
            pos = rng.multivariate_hypergeometric(n, took[b], method="marginals") if len(n) > 1 else took[b : b + 1]
            neg = n - pos
            twice[b] = (pos * (2 * (np.cumsum(neg) - neg) + neg)).sum() + 2 * took[b] * below[b]
        out = {g: pa.array([v] * replicates, table.schema.field(g).type) for g, v in zip(named, about, strict=True)}
        return pa.table(out | {"b": pa.array(np.arange(replicates)), "twice": pa.array(twice)})

    totals = scores.groupBy("_g", *keys).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    heads = totals.groupBy("_g", *groups).applyInArrow(dealt, f"{ddl}{RANGE} int, took array<bigint>, below array<bigint>")
    parts = scores.groupBy(*keys).cogroup(heads.groupBy(*keys)).applyInArrow(won, f"{ddl}b bigint, twice bigint")
    sizes = _total(scores, groups, F.sum("pos").alias("n1"), (F.sum("n") - F.sum("pos")).alias("n0"))
    got = beside(parts.groupBy(*groups, "b").agg(F.sum("twice").alias("twice")), sizes, groups)
    stat = F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("twice") / 2 / F.col("n1") / F.col("n0")).otherwise(0.5)
    return got.select(*groups, "b", stat.alias("stat"))


def permutation_auc(df: DataFrame, row_id: str, replicates: int = 1000, seed: int = 0, groups: Sequence[str] = ()) -> DataFrame:
    """groups, b, stat under shuffled labels."""
    got = auc_roc(shuffled_labels(df, row_id, replicates, seed, groups), [*groups, "b"], weight="w")
    return got.select(*groups, "b", auc_or_half(F.col("auc")).alias("stat"))


def p_values(null: DataFrame, observed: DataFrame, groups: Sequence[str], stat: str = "auc") -> DataFrame:
    """groups, p_perm: as ``p_value``, for each group's observed statistic."""
    both = beside(null, observed.select(*groups, F.col(stat).alias("_seen")), groups)
    return _total(both, groups, ((1 + F.sum((F.col("stat") >= F.col("_seen")).cast("bigint"))) / (1 + F.count("*"))).alias("p_perm"))


def p_value(null: DataFrame, observed: float, alternative: str = "greater") -> DataFrame:
    """(1 + how many are as large) / (1 + all). two-sided compares absolute values, without centring."""
    if alternative not in ("greater", "two-sided"):
        raise ValueError(alternative)
    stat, seen = (F.col("stat"), observed) if alternative == "greater" else (F.abs("stat"), abs(observed))
    return null.agg(((1 + F.sum((stat >= seen).cast("bigint"))) / (1 + F.count("*"))).alias("p_value"))


def paired_permutation_auc(df: DataFrame, row_id: str, a: str, b: str, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """b, stat: the difference of the two scores' AUC, each row's scores swapped or not by a draw."""
    two = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(c).alias("p")) for side, c in enumerate((a, b))])).alias("s")
    rows = with_ranges(df.select(F.col(row_id).alias("id"), "y", two).select("id", "y", "s.*"), "p")
    rows = rows.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(replicates - 1).cast("bigint"))))
    swap = draw(F.lit(seed), F.col("b"), F.col("id")) < 0.5
    side = F.when(swap, 1 - F.col("side")).otherwise(F.col("side"))
    got = auc_roc(rows.select("b", side.alias("side"), "y", "p", RANGE), ["b", "side"]).groupBy("b")
    of = lambda k: F.max(F.when(F.col("side") == k, auc_or_half(F.col("auc"))))
    return got.agg((of(0) - of(1)).alias("stat"))


def adjusted(df: DataFrame, p: str, groups: Sequence[str] = (), row_id: str = "name") -> DataFrame:
    """Benjamini-Hochberg: adds p_adj. A family is a handful of tests; families are apart by ``groups``."""
    by = Window.partitionBy(*groups)
    ranked = df.withColumn("_k", F.row_number().over(by.orderBy(p, row_id))).withColumn("_m", F.count("*").over(by))
    low = F.min(F.col(p) * F.col("_m") / F.col("_k")).over(by.orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("p_adj", F.least(F.lit(1.0), low)).drop("_k", "_m")
