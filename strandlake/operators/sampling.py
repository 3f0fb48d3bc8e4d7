"""Exact samples by a seeded draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import draw


def bottom_k(df: DataFrame, k: int, row_id: str, groups: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """k rows of each group, or all it has: those with the least draws, which depend on seed and row_id alone; ties go by row_id. Every task keeps k rows
    a group at most before rows are dealt by group, so a group of any size is k rows a task, and the sample is the same however
    rows are dealt. A greater k has the sample of a smaller one in it."""
    drawn = df.withColumn("_draw", draw(F.lit(seed), F.col(row_id)))
    if not groups:
        return drawn.orderBy("_draw", row_id).limit(k).drop("_draw")
    place = F.row_number().over(Window.partitionBy(*groups).orderBy("_draw", row_id))
    return drawn.withColumn("_place", place).filter(F.col("_place") <= k).drop("_draw", "_place")
