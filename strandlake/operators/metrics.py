"""Ranking and calibration metrics of a scored frame (y in {0, 1}, p in [0, 1]), by groups and with weights.

Every metric first sums rows to distinct scores, so ties are exact and later steps see as many rows as there are scores.
Bootstrap, jackknife, permutation and slices are the same aggregations with other groups and weights.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clipped
from ..functions.running import RANGE, running_totals
from ..session import saved

NAN = float("nan")


def by_score(df: DataFrame, groups: Sequence[str] = (), y: str = "y", p: str = "p", weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    ranges = [RANGE] if RANGE in df.columns else []  # which the score decides
    return df.groupBy(*groups, *ranges, F.col(p).alias("p")).agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0).otherwise(w)).alias("neg"))


def _total(df: DataFrame, groups: Sequence[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*groups).agg(*aggs) if groups else df.agg(*aggs)


def auc_roc(df: DataFrame, groups: Sequence[str] = (), y: str = "y", p: str = "p", weight: str | None = None) -> DataFrame:
    """groups, n, n_pos, n_neg, auc: the chance that a positive scores above a negative, ties by half. NaN with one class."""
    scores = running_totals(by_score(df, groups, y, p, weight), "p", [], {"below": "neg"}, groups)
    won = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    n1, n0 = F.coalesce(F.sum("pos"), F.lit(0)), F.coalesce(F.sum("neg"), F.lit(0))
    return _total(scores, groups, (n1 + n0).alias("n"), n1.alias("n_pos"), n0.alias("n_neg"), F.when((n1 > 0) & (n0 > 0), won / n1 / n0).otherwise(NAN).alias("auc"))


def auc_or_half(c: Column) -> Column:
    """As a statistic to resample: without both classes, a half."""
    return F.coalesce(F.nanvl(c, F.lit(0.5)), F.lit(0.5))


def curve(df: DataFrame, groups: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """A row for each threshold (a distinct score): tp, fp (rows at or above it), n_pos, n_neg, pos, neg (at it)."""
    scores = by_score(df, groups, y, p).withColumn("minus", -F.col("p"))
    if RANGE in scores.columns:
        scores = scores.withColumn(RANGE, -F.col(RANGE))
    got = running_totals(scores, "minus", [], {"tp": "pos", "fp": "neg"}, groups)
    totals = _total(scores, groups, F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    got = got.withColumn("tp", F.col("tp") + F.col("pos")).withColumn("fp", F.col("fp") + F.col("neg")).drop("minus", RANGE)
    return got.join(totals, list(groups)) if groups else got.crossJoin(F.broadcast(totals))  # one row


def roc_points(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return curve(df, groups).select(*groups, F.col("p").alias("threshold"), F.try_divide("fp", "n_neg").alias("fpr"), F.try_divide("tp", "n_pos").alias("tpr"))


def auc_pr(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Step average precision: each threshold's gain in recall times its precision."""
    return _total(curve(df, groups), groups, F.sum(F.col("pos") / F.col("n_pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("auc_pr"))


def youden(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The highest threshold with the largest tpr - fpr (infinity if none is above 0), and the accuracy at it."""
    pts = curve(df, groups)
    j = F.col("tp") / F.col("n_pos") - F.col("fp") / F.col("n_neg")
    best = _total(pts.withColumn("j", j), groups, F.max(F.struct("j", "p", "tp", "fp", "n_pos", "n_neg")).alias("b"))
    b = lambda c: F.col(f"b.{c}")
    some = b("j") > 0
    right = F.when(some, b("tp") + b("n_neg") - b("fp")).otherwise(b("n_neg"))
    return best.select(*groups, F.greatest(b("j"), F.lit(0.0)).alias("youden_j"), F.when(some, b("p")).otherwise(float("inf")).alias("threshold"), (right / (b("n_pos") + b("n_neg"))).alias("accuracy"))


def brier(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return _total(df, groups, F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"))


def log_loss(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    q = clipped(F.col("p"))
    return _total(df, groups, (-F.avg(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))).alias("bce"))


def _binned_scores(df: DataFrame, bins: int, groups: Sequence[str]) -> tuple[DataFrame, Callable[[Column], Column]]:
    """Scores with pos, neg, their first place in order, all rows of the group, and whether they lie in two bins or more; and the bin of a place."""
    scores = by_score(df, groups).withColumn("_n", F.col("pos") + F.col("neg"))
    placed = running_totals(scores, "p", [], {"_first": "_n"}, groups)
    totals = _total(df, groups, F.count("*").alias("_all"))
    placed = placed.join(totals, list(groups)) if groups else placed.crossJoin(F.broadcast(totals))  # one row
    size, extra = F.floor(F.col("_all") / bins), F.col("_all") % bins
    large = (size + 1) * extra
    number = lambda place: (F.when(place < large, F.floor(place / (size + 1))).otherwise(extra + F.floor(F.try_divide(place - large, size))) + 1).cast("bigint")
    placed = placed.withColumn("_cut", number(F.col("_first")) != number(F.col("_first") + F.col("_n") - 1))
    return saved(placed, "scores"), number  # a row a score, read by both of what follows


def _cut_rows(df: DataFrame, scores: DataFrame, groups: Sequence[str], row_id: str) -> DataFrame:
    """Rows of the scores that lie in several bins, with their place in order of row_id within the score."""
    rows = df.drop(RANGE).join(scores.filter("_cut").select(*groups, "p", "_first", "_all"), [*groups, "p"])
    return running_totals(rows.withColumn("_one", F.lit(1).cast("bigint")), row_id, [], {"_within": "_one"}, [*groups, "p"]).drop("_one")


def equal_mass_bins(df: DataFrame, bins: int = 15, groups: Sequence[str] = (), row_id: str = "row_id") -> DataFrame:
    """Adds bin (1 to bins): rows in order of (p, row_id), sizes differing by one at most, larger ones first. ``row_id`` is numeric.

    A score's first place is the running sum over scores. Only rows of scores that lie in two bins or more, of which there are
    ``bins`` - 1 at most in a group, are put in order, and that by ranges of row_id; so neither many rows nor one score with
    most of them meet in a task."""
    scores, number = _binned_scores(df, bins, groups)
    whole = df.drop(RANGE).join(scores.filter("not _cut").select(*groups, "p", "_first", "_all"), [*groups, "p"]).withColumn("_within", F.lit(0).cast("bigint"))
    both = whole.unionByName(_cut_rows(df, scores, groups, row_id))
    return both.withColumn("bin", number(F.col("_first") + F.col("_within"))).drop("_first", "_all", "_within")


def reliability(df: DataFrame, bins: int = 15, groups: Sequence[str] = (), row_id: str = "row_id") -> DataFrame:
    """groups, bin, n, mean_p, frac_pos. Scores within a bin are taken as they are summed up; rows only of those in several."""
    scores, number = _binned_scores(df, bins, groups)
    whole = scores.filter("not _cut").select(*groups, number(F.col("_first")).alias("bin"), F.col("_n").alias("n"), (F.col("_n") * F.col("p")).alias("sum_p"), F.col("pos"))
    cut = _cut_rows(df, scores, groups, row_id)
    cut = cut.select(*groups, number(F.col("_first") + F.col("_within")).alias("bin"), F.lit(1).cast("bigint").alias("n"), F.col("p").alias("sum_p"), (F.col("y") == 1).cast("bigint").alias("pos"))
    got = whole.unionByName(cut).groupBy(*groups, "bin").agg(F.sum("n").alias("n"), F.sum("sum_p").alias("sum_p"), F.sum("pos").alias("pos"))
    return got.select(*groups, "bin", "n", (F.col("sum_p") / F.col("n")).alias("mean_p"), (F.col("pos") / F.col("n")).alias("frac_pos"))


def calibration_error(df: DataFrame, bins: int = 15, groups: Sequence[str] = (), row_id: str = "row_id") -> DataFrame:
    """groups, ece, mce over equal-mass bins. NaN with fewer rows than bins."""
    gap = F.abs(F.col("mean_p") - F.col("frac_pos"))
    got = _total(reliability(df, bins, groups, row_id), groups, F.sum("n").alias("n"), (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))
    few = F.col("n") < bins
    return got.select(*groups, F.when(few, NAN).otherwise(F.col("ece")).alias("ece"), F.when(few, NAN).otherwise(F.col("mce")).alias("mce"))
