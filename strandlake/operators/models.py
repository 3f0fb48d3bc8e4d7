"""Discriminators: a registry of trainers, boosted trees on features, folds by groups, saved models, and scores made elsewhere.

A trainer takes (features with y, split and the group column) and returns a scored frame (segment_id, y, split, p). Scores of
networks trained elsewhere come in as a table; ``external`` checks and joins them.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import md5_seed
from ..functions.running import running_totals
from ..session import saved, shared_path
from ..sources import files
from . import metrics, trees

Trainer = Callable[..., DataFrame]
_TRAINERS: dict[str, Trainer] = {}


def register(name: str) -> Callable[[Trainer], Trainer]:
    def add(trainer: Trainer) -> Trainer:
        if name in _TRAINERS:
            raise ValueError(f"{name} is registered already")
        _TRAINERS[name] = trainer
        return trainer

    return add


def create(name: str) -> Trainer:
    if name not in _TRAINERS:
        raise ValueError(f"no trainer {name}; there are {', '.join(available())}")
    return _TRAINERS[name]


def available() -> list[str]:
    return sorted(_TRAINERS)


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_f", handleInvalid="keep").transform(df.withColumn("_y", F.col("y").cast("double")))


def _scored(model, rows: DataFrame) -> DataFrame:  # noqa: ANN001
    return model.transform(rows).select("segment_id", "y", "split", vector_to_array("probability")[1].alias("p"))


@dataclass
class Boosted:
    """Boosted trees: the fitted model, its trees as arrays, how many of them are used, and the AUC on val by their number."""

    model: GBTClassificationModel
    ensemble: trees.Ensemble
    used: int
    stages: DataFrame | None
    parameters: dict[str, Any]

    @property
    def best(self) -> trees.Ensemble:
        return self.ensemble.first(self.used)

    def score(self, rows: DataFrame, keep: Sequence[str] = ("segment_id", "y", "split")) -> DataFrame:
        return trees.scored(rows, self.best, list(keep))


#: Trees, depth of about 31 leaves, rate, rows a leaf, shares of rows and features, patience, seed.
DEFAULTS = {"trees": 400, "depth": 5, "rate": 0.05, "least": 20, "rows": 0.9, "columns": 0.9, "patience": 50, "seed": 0}


#: Training rows a task. A fit has a job for each level of each tree, so what a task costs by itself counts as many times.
TASK_ROWS = 1 << 15


def dealt_by_rows(df: DataFrame, key: str = "segment_id") -> DataFrame:
    """Rows by digest of their key over as many tasks as their number asks for, in order of key: what a fit draws from depends
    on the rows alone, and a small file of many rows isn't one task."""
    return df.repartition(max(1, -(-df.count() // TASK_ROWS)), key).sortWithinPartitions(key)


def _fitted(rows: DataFrame, features: Sequence[str], n: int, c: Mapping[str, Any]) -> tuple[GBTClassificationModel, trees.Ensemble]:
    learner = GBTClassifier(
        featuresCol="_f", labelCol="_y", maxIter=n, maxDepth=c["depth"], stepSize=c["rate"], minInstancesPerNode=c["least"],
        subsamplingRate=c["rows"], featureSubsetStrategy=str(c["columns"]) if c["columns"] < 1 else "all", seed=c["seed"],
    )
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # else each tree's jobs carry the lineage of all trees before it
        context.setCheckpointDir(shared_path(rows.sparkSession, "checkpoints"))
    model = learner.fit(_vectors(dealt_by_rows(rows), features))
    path = shared_path(rows.sparkSession, "trees")
    model.write().save(path)
    return model, trees.read_ensemble(rows.sparkSession, path, features)


def stage_aucs(rows: DataFrame, ensemble: trees.Ensemble) -> DataFrame:
    """stage, auc: of the scores by the first trees, for every number of them in one plan."""
    return metrics.auc_roc(trees.staged(rows, ensemble, ["y"]), ["stage"]).select("stage", "auc")


def fit_boosted(df: DataFrame, features: Sequence[str], train: str = "split = 'train'", val: str | None = "split = 'val'", **parameters: Any) -> Boosted:
    """Fitted on ``train``. If val has both classes, the number of trees is the first with the greatest AUC there, once ``patience``
    further trees haven't bettered it. Fits grow by blocks until then: with one seed, fewer trees are the first of more."""
    c = DEFAULTS | parameters
    if set(c) != set(DEFAULTS):
        raise ValueError(f"no parameter {', '.join(set(c) - set(DEFAULTS))}")
    rows, held = df.filter(train), df.filter(val) if val else None
    if held is None or held.select("y").distinct().count() < 2:
        model, ensemble = _fitted(rows, features, c["trees"], c)
        return Boosted(model, ensemble, c["trees"], None, c)
    n = min(c["trees"], c["patience"] + 10)
    while True:
        model, ensemble = _fitted(rows, features, n, c)
        stages = stage_aucs(held, ensemble)
        found = {r["stage"]: r["auc"] for r in stages.collect()}  # a row a tree
        used = stopped(found, c["patience"])
        if used + c["patience"] <= n or n == c["trees"]:
            return Boosted(model, ensemble, used, df.sparkSession.createDataFrame(sorted(found.items()), "stage bigint, auc double"), c)
        n = min(c["trees"], 2 * n)


def stopped(aucs: Mapping[int, float], patience: int) -> int:
    """The first stage that none of the next ``patience`` ones betters."""
    best = 1
    for stage in sorted(aucs):
        if aucs[stage] > aucs[best]:
            best = stage
        if stage - best >= patience:
            break
    return best


@register("gbt")
def boosted_trees(df: DataFrame, features: Sequence[str], **parameters: Any) -> DataFrame:
    """Fitted on train, stopped early by AUC on val, scored everywhere."""
    return fit_boosted(df, features, **parameters).score(df)


def importances(df: DataFrame, boosted: Boosted, top: int = 10) -> DataFrame:
    """feature, importance: mean absolute attributions of the trees in use over all rows of ``df``, the largest first."""
    return trees.mean_attributions(df, boosted.best, top)


# Folds by groups


def fold_assignment(df: DataFrame, group: str, folds: int = 5) -> DataFrame:
    """group, n, fold (0 to folds - 1): groups by falling size, each to the fold that is lightest then; ties by the group's digest and
    name, and of folds by number.

    Groups of one size only differ in order, so it is enough to deal sizes: the driver gets how many groups have each size (with N
    rows under sqrt(2 N) sizes) and finds who is dealt to whom as stretches of turns that repeat, a few a size."""
    sizes = df.groupBy(F.col(group).alias(group)).agg(F.count("*").alias("n"))
    loads, stretches = [0] * folds, []
    for n, groups in sorted(((r["n"], r["groups"]) for r in sizes.groupBy("n").agg(F.count("*").alias("groups")).collect()), reverse=True):
        stretches += [(n, *s) for s in turns(loads, n, groups)]
    dealt = df.sparkSession.createDataFrame(stretches, "n bigint, first bigint, last bigint, turn array<int>")
    ranked = running_totals(sizes.withColumn("_one", F.lit(1).cast("bigint")).withColumn("_key", md5_seed(F.col(group).cast("string"))), "_key", [F.col(group).cast("string")], {"_rank": "_one"}, ["n"])
    inside = (ranked.n == dealt.n) & (F.col("_rank") >= F.col("first")) & (F.col("_rank") <= F.col("last"))
    fold = F.get("turn", F.pmod(F.col("_rank") - F.col("first"), F.size("turn")).cast("int"))
    return ranked.join(dealt, inside).select(group, ranked.n, fold.cast("bigint").alias("fold"))


def turns(loads: list[int], n: int, groups: int) -> list[tuple[int, int, list[int]]]:
    """(first, last, folds in turn) of ``groups`` groups of n rows each dealt to the lightest fold; ``loads`` is brought up to date."""
    out, at = [], 0
    while at < groups:
        order = sorted(range(len(loads)), key=lambda f: (loads[f], f))
        low = loads[order[0]]
        turn = [f for f in order if loads[f] < low + n]  # who gets one before any gets two
        rest = [loads[f] for f in order if loads[f] >= low + n]
        level = [(loads[f], f) for f in turn]
        rounds = (groups - at) // len(turn)
        if rest:  # until the next fold has its turn
            rounds = min(rounds, max(1, (min(rest) - max(x for x, _ in level)) // n))
        took = rounds * len(turn) if rounds else groups - at
        if not rounds:
            turn = turn[:took]
            rounds = 1
        heapq.heapify(level)
        out.append((at, at + took - 1, turn))
        for f in turn:
            loads[f] += rounds * n
        at += took
    return out


def cross_fitted(df: DataFrame, features: Sequence[str], group: str, folds: int = 5, at_once: int = 5, **parameters: Any) -> DataFrame:
    """segment_id, y, fold, p: each row scored by trees fitted without its fold. No group is in two folds. Rows with their folds are
    saved once; ``at_once`` folds are fitted side by side, as a fit is many short jobs."""
    dealt = saved(df.join(fold_assignment(df, group, folds).select(group, "fold"), group), "folds")

    def part(k: int) -> DataFrame:
        fitted = fit_boosted(dealt, features, train=f"fold != {k}", val=None, **parameters)
        return fitted.score(dealt.filter(F.col("fold") == k), ["segment_id", "y", "fold"])

    with ThreadPool(min(at_once, folds)) as pool:
        parts = pool.map(inheritable_thread_target(df.sparkSession)(part), range(folds))
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def fold_aucs(scores: DataFrame) -> DataFrame:
    """fold, n, auc; a fold with one class has none."""
    got = metrics.auc_roc(scores, ["fold"])
    return got.select("fold", "n", F.when(~F.isnan("auc"), F.col("auc")).alias("auc"))


# Saved models


def save(boosted: Boosted, path: str) -> None:
    """The trees by Spark's writer, and beside them a record of parameters, trees in use and features in order."""
    boosted.model.write().overwrite().save(f"{path}/model")
    record = {"features": boosted.ensemble.features, "used": boosted.used, "parameters": boosted.parameters}
    files.write_record(SparkSession.active(), record, f"{path}/record")


def load(spark: SparkSession, path: str, features: Sequence[str]) -> Boosted:
    """Refused if ``features`` aren't those of the record, in its order."""
    record = files.read_record(spark, f"{path}/record")
    if list(features) != record["features"]:
        raise ValueError(f"the model was fitted on {', '.join(record['features'])}, in this order")
    return Boosted(GBTClassificationModel.load(f"{path}/model"), trees.read_ensemble(spark, f"{path}/model", features), record["used"], None, record["parameters"])


@register("mlp")
def perceptron(df: DataFrame, features: Sequence[str], hidden: int = 16, rounds: int = 60, seed: int = 1) -> DataFrame:
    rows = _vectors(df, features)
    rows = StandardScaler(inputCol="_f", outputCol="_s", withMean=True).fit(rows.filter("split = 'train'")).transform(rows).drop("_f").withColumnRenamed("_s", "_f")
    model = MultilayerPerceptronClassifier(featuresCol="_f", labelCol="_y", layers=[len(features), hidden, 2], maxIter=rounds, seed=seed).fit(rows.filter("split != 'test'"))
    return _scored(model, rows)


@register("external")
def external(df: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores (segment_id, p) of a model that ran elsewhere; every segment needs one."""
    out = df.select("segment_id", "y", "split").join(scores.select("segment_id", "p"), "segment_id", "left")
    if out.filter("p is null").limit(1).count():
        raise ValueError("segments without a score")
    return out
