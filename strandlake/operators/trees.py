"""Fitted tree ensembles as arrays: staged scores and exact attributions of scores to features, in Arrow batches.

An ensemble has trees x 2 ** (depth + 1) nodes at most, which is what tasks get of it; rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEEPEST = 12


@dataclass
class Tree:
    """Nodes by number, the root first. feature is -1 at a leaf; a row goes left if its value is at most the threshold; cover is
    how many training rows came by."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    weight: float

    def predicted(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while (inner := self.feature[at] >= 0).any():
            go_left = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(go_left, self.left[at], self.right[at]), at)
        return self.value[at]

    def leaves(self) -> Iterator[tuple[int, list[tuple[int, bool]]]]:
        """(leaf, the nodes on its path with whether it goes left there)."""
        todo: list[tuple[int, list[tuple[int, bool]]]] = [(0, [])]
        while todo:
            node, path = todo.pop()
            if self.feature[node] < 0:
                yield node, path
            else:
                todo += [(int(self.left[node]), [*path, (node, True)]), (int(self.right[node]), [*path, (node, False)])]


@dataclass
class LeafGame:
    """What a leaf adds to each feature of its path, for every set of features by which a row goes along the path."""

    features: np.ndarray
    low: np.ndarray  # a row fits a feature's splits if low < value <= high
    high: np.ndarray
    table: np.ndarray  # 2 ** m x m
    base: float

    def add(self, x: np.ndarray, out: np.ndarray) -> None:
        v = x[:, self.features]
        fits = (v > self.low) & (v <= self.high)
        code = fits @ (1 << np.arange(len(self.features)))
        np.add.at(out.T, self.features, self.table[code].T)


def leaf_game(tree: Tree, leaf: int, path: Sequence[tuple[int, bool]]) -> LeafGame:
    """Exact Shapley values of the game in which a feature that is left out sends rows both ways, by cover. With m features on the path,
    the products over subsets are sums by size of polynomials' coefficients; all 2 ** m patterns are worked out once."""
    features = sorted({int(tree.feature[n]) for n, _ in path})
    m = len(features)
    if m > DEEPEST:
        raise ValueError(f"paths of over {DEEPEST} features")
    low, high, share = np.full(m, -np.inf), np.full(m, np.inf), np.ones(m)
    for node, goes_left in path:
        j = features.index(int(tree.feature[node]))
        if goes_left:
            high[j] = min(high[j], tree.threshold[node])
        else:
            low[j] = max(low[j], tree.threshold[node])
        share[j] *= tree.cover[tree.left[node] if goes_left else tree.right[node]] / tree.cover[node]
    value = tree.weight * tree.value[leaf]
    fits = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
    table = np.zeros((1 << m, m))
    for i in range(m):
        sizes = np.zeros((1 << m, m))  # coefficient s: the sum over subsets of s others, in or out
        sizes[:, 0] = 1
        for k in range(m):
            if k != i:
                sizes = sizes * share[k] + np.pad(sizes[:, :-1] * fits[:, [k]], ((0, 0), (1, 0)))
        weights = np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)]) if m else np.zeros(0)
        table[:, i] = value * (sizes @ weights) * (fits[:, i] - share[i])
    return LeafGame(np.array(features, np.int64), low, high, table, float(value * share.prod()))


@dataclass
class Ensemble:
    """Trees whose weighted sum is the margin; a score is 1 / (1 + exp(-2 margin))."""

    trees: list[Tree]
    features: list[str]
    games: list[LeafGame] = field(default_factory=list)

    def first(self, n: int) -> Ensemble:
        return Ensemble(self.trees[:n], self.features)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """A column for each number of trees."""
        return np.cumsum([t.weight * t.predicted(x) for t in self.trees], axis=0).T

    def attributions(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Each feature's part of the margin, and the mean by cover; together they are the margin."""
        if not self.games:
            self.games = [leaf_game(t, *leaf) for t in self.trees for leaf in t.leaves()]
        out = np.zeros((len(x), len(self.features)))
        for game in self.games:
            if len(game.features):
                game.add(x, out)
        return out, sum(g.base for g in self.games)


def read_ensemble(spark: SparkSession, path: str, features: Sequence[str]) -> Ensemble:
    """Of a saved Spark model of boosted trees. All splits are of numbers."""
    n = "nodeData"
    rows = spark.read.parquet(f"{path}/data").select("treeID", f"{n}.id", f"{n}.prediction", f"{n}.rawCount", f"{n}.leftChild", f"{n}.rightChild", f"{n}.split.featureIndex", F.get(f"{n}.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), f"{n}.split.numCategories").collect()
    weights = {r[0]: r[1] for r in spark.read.parquet(f"{path}/treesMetadata").select("_1", "_3").collect()}
    by_tree: dict[int, list] = {k: [] for k in weights}
    for r in rows:
        by_tree[r["treeID"]].append(r)
    out = []
    for k in sorted(weights):
        nodes = sorted(by_tree[k], key=lambda r: r["id"])
        if any(r["leftChild"] >= 0 and r["numCategories"] != -1 for r in nodes):
            raise ValueError("splits of categories")
        inner = np.array([r["leftChild"] >= 0 for r in nodes])
        column = lambda c, kind, nodes=nodes: np.array([r[c] for r in nodes], kind)
        out.append(Tree(np.where(inner, column("featureIndex", np.int64), -1), np.where(inner, np.array([r["threshold"] or 0.0 for r in nodes]), 0.0), column("leftChild", np.int64), column("rightChild", np.int64), column("prediction", np.float64), column("rawCount", np.float64), float(weights[k])))
    return Ensemble(out, list(features))


def _matrix(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(f).to_numpy(zero_copy_only=False).astype(np.float64) for f in features])


def _with_features(df: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    return df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features])


def _kinds(source: DataFrame, keep: Sequence[str]) -> str:
    return "".join(f"`{n}` {t}, " for n, t in source.dtypes if n in keep)


def scored(df: DataFrame, ensemble: Ensemble, keep: Sequence[str]) -> DataFrame:
    """keep, p."""
    source = _with_features(df, keep, ensemble.features)
    box = df.sparkSession.sparkContext.broadcast(ensemble)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, box.value.features)
            margin = sum((t.weight * t.predicted(x) for t in box.value.trees), np.zeros(len(x)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(1 / (1 + np.exp(-2 * margin)))], names=[*keep, "p"])

    return source.mapInArrow(run, _kinds(source, keep) + "p double")


def staged(df: DataFrame, ensemble: Ensemble, keep: Sequence[str]) -> DataFrame:
    """keep, stage (1 to the number of trees), p: the score by the first trees, all in one pass over the rows."""
    source = _with_features(df, keep, ensemble.features)
    box = df.sparkSession.sparkContext.broadcast(ensemble)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(box.value.trees)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                p = 1 / (1 + np.exp(-2 * box.value.margins(_matrix(batch, box.value.features))))
                rows = pa.array(np.repeat(np.arange(batch.num_rows), n))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in keep], pa.array(np.tile(np.arange(1, n + 1), batch.num_rows)), pa.array(p.ravel())], names=[*keep, "stage", "p"])

    return source.mapInArrow(run, _kinds(source, keep) + "stage bigint, p double")


def attributed(df: DataFrame, ensemble: Ensemble, keep: Sequence[str]) -> DataFrame:
    """keep, base, margin, and a column for each feature with its part: base and parts add up to the margin."""
    source = _with_features(df, keep, ensemble.features)
    box = df.sparkSession.sparkContext.broadcast(ensemble)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = box.value.features
        for batch in batches:
            x = _matrix(batch, names)
            parts, base = box.value.attributions(x)
            margin = box.value.margins(x)[:, -1] if box.value.trees else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(np.full(len(x), base)), pa.array(margin), *[pa.array(parts[:, i]) for i in range(len(names))]], names=[*keep, "base", "margin", *names])

    return source.mapInArrow(run, _kinds(source, keep) + "base double, margin double, " + ", ".join(f"`{n}` double" for n in ensemble.features))


def mean_attributions(df: DataFrame, ensemble: Ensemble, top: int = 10) -> DataFrame:
    """feature, importance: the mean absolute part over all rows, the ``top`` largest."""
    parts = attributed(df, ensemble, [])
    means = parts.agg(*[F.avg(F.abs(F.col(f"`{n}`"))).alias(n) for n in ensemble.features])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("importance")) for n in ensemble.features])).alias("s")
    return means.select(pairs).select("s.*").orderBy(F.col("importance").desc(), "feature").limit(top)
