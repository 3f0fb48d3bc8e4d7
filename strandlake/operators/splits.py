"""Grouped splits without leakage, and split tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import md5_bucket


def split_of(group: Column, train: float = 0.7, val: float = 0.15) -> Column:
    """train, val or test by the group's digest, so that a group is in one split and order doesn't matter."""
    if train + val >= 1:
        raise ValueError("no share is left for test")
    bucket = md5_bucket(group)
    return F.when(bucket < round(100 * train), "train").when(bucket < round(100 * (train + val)), "val").otherwise("test")


def leaking_groups(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    return df.groupBy(group).agg(F.countDistinct(split).alias("n_splits")).filter("n_splits > 1")


def assert_no_leak(df: DataFrame, group: str, split: str = "split") -> None:
    found = leaking_groups(df, group, split).limit(1).collect()
    if found:
        raise RuntimeError(f"{group} {found[0][0]} is in {found[0][1]} splits")


def split_assignment(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    return df.groupBy(group).agg(F.min(split).alias("split"), F.count("*").alias("n_segments"))


def evaluated_split(df: DataFrame, split: str = "split", groups: Sequence[str] = ()) -> DataFrame:
    """Rows of the first split that has any, by group: test, val, train."""
    rank = F.when(F.col(split) == "test", 0).when(F.col(split) == "val", 1).otherwise(2)
    if groups:
        return df.withColumn("_rank", rank).join(df.groupBy(*groups).agg(F.min(rank).alias("_rank")), [*groups, "_rank"]).select(*df.columns)
    first = df.agg(F.min(rank).alias("_first"))
    return df.withColumn("_rank", rank).join(F.broadcast(first), F.col("_rank") == F.col("_first")).drop("_rank", "_first")  # one row
