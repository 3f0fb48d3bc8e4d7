"""Roll-ups of counts and of sweep results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_balance(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, pct of all rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("pct", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()))


def knob_rollup(df: DataFrame, knobs: Sequence[str], value: str = "auc") -> DataFrame:
    """knob, level, mean, n of all knobs in one pass by grouping sets."""
    sets = [[k] for k in knobs]
    typed = df.select(*[F.col(k).cast("string").alias(k) for k in knobs], value)
    got = typed.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in knobs]).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.grouping_id().alias("_g"))
    top = len(knobs) - 1
    knob = F.coalesce(*[F.when(F.col("_g").bitwiseAND(1 << (top - i)) == 0, F.lit(k)) for i, k in enumerate(knobs)])
    level = F.coalesce(*[F.when(F.col("_g").bitwiseAND(1 << (top - i)) == 0, F.col(k)) for i, k in enumerate(knobs)])
    return got.select(knob.alias("knob"), level.alias("level"), "mean", "n")


def knob_spread(rollup: DataFrame, order: Sequence[str]) -> DataFrame:
    """One row: the knob whose level means spread most; of equal ones the first in ``order``."""
    place = F.coalesce(*[F.when(F.col("knob") == k, F.lit(i)) for i, k in enumerate(order)])
    spread = rollup.groupBy("knob").agg((F.max("mean") - F.min("mean")).alias("spread"))
    return spread.agg(F.max(F.struct("spread", (-place).alias("o"), "knob")).alias("b")).select("b.knob", "b.spread")


def model_matrix(df: DataFrame, row: str, model: str, models: Sequence[str], value: str = "auc") -> DataFrame:
    return df.groupBy(row).pivot(model, list(models)).agg(F.avg(value))


def stacked(overall: DataFrame, slices: DataFrame) -> DataFrame:
    """Overall rows and slice rows; columns that one side lacks are null."""
    return overall.unionByName(slices, allowMissingColumns=True)


def channel_statistics(df: DataFrame, channels: Sequence[str], train: str = "split = 'train'") -> DataFrame:
    return df.filter(train).agg(*[f(c).alias(f"{c}_{n}") for c in channels for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def normalised(df: DataFrame, channels: Sequence[str], train: str = "split = 'train'") -> DataFrame:
    """Channels less their mean, by their deviation, both of the training rows."""
    stats = F.broadcast(channel_statistics(df, channels, train))  # one row
    rest = [c for c in df.columns if c not in channels]
    return df.crossJoin(stats).select(*rest, *[((F.col(c) - F.col(f"{c}_mean")) / (F.col(f"{c}_std") + 1e-5)).alias(c) for c in channels])
