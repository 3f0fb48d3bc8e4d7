"""Running sums without one task for all rows of a group: ranges of the key first, then rows within a range."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges hold about equally many rows. Cells are what they are made of; a cell with more rows than a range is cut into parts.
RANGES, CELLS, PARTS = 256, 1 << 14, 256
RANGE = "_range"


def _squeezed(key: Column) -> Column:
    """Numbers in their order within [-1, 1]; NaN is above all, as in Spark's order."""
    k = key.cast("double")
    return F.when(F.isnan(k) | (k == float("inf")), 1.0).when(k == float("-inf"), -1.0).otherwise(k / (1 + F.abs(k)))


def _place(u: Column, low: Column, high: Column, n: int) -> Column:
    """Which of n equal parts of [low, high] u is in, from 0."""
    return F.when(high > low, F.least(F.floor((u - low) / (high - low) * n), F.lit(n - 1))).otherwise(0).cast("int")


def with_ranges(df: DataFrame, key: str, ranges: int = RANGES) -> DataFrame:
    """Adds ``_range``, which grows with the numeric ``key``: cut where the rows are, by counts of fixed cells (a quarter of them
    for [0, 1]), and of parts between a cell's least and greatest key where it is full. Counts and ends are exact, so every
    branch of a plan, and a task that runs again, has the same ranges. What is broadcast has a row a cell, ``CELLS`` at most.
    Rows of one key share a range; a null key is in range -1."""
    placed = df.withColumn("_r_u", _squeezed(F.col(key))).withColumn("_r_cell", _place(F.col("_r_u"), F.lit(-1.0), F.lit(1.0), CELLS))
    cells = placed.filter("_r_u is not null").groupBy("_r_cell").agg(F.count("*").alias("_r_n"), F.min("_r_u").alias("_r_low"), F.max("_r_u").alias("_r_high"))
    earlier = Window.orderBy("_r_cell").rowsBetween(Window.unboundedPreceding, -1)  # at most CELLS rows
    cells = cells.withColumn("_r_before", F.coalesce(F.sum("_r_n").over(earlier), F.lit(0))).withColumn("_r_all", F.sum("_r_n").over(Window.partitionBy()))
    out = placed.join(F.broadcast(cells), "_r_cell", "left")
    first = F.call_function("div", F.col("_r_before") * ranges, F.col("_r_all")).cast("int") * (PARTS + 1)
    full = F.col("_r_n") * ranges > F.col("_r_all")  # the next cell is then in a later range
    part = F.when(full, 1 + _place(F.col("_r_u"), F.col("_r_low"), F.col("_r_high"), PARTS)).otherwise(0)
    return out.withColumn(RANGE, F.when(F.col("_r_u").isNull(), -1).otherwise(first + part)).drop("_r_u", "_r_cell", "_r_n", "_r_low", "_r_high", "_r_before", "_r_all")


def running_totals(df: DataFrame, key: str, order: Sequence[Column | str], sums: Mapping[str, str], groups: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """Adds for each (name: column) the sum over all rows of the group before this one in order of (key, order).

    Ranges are those that ``df`` has (see ``with_ranges``; they must grow with the key) or are made for all groups together. Their
    totals, a row for each group and range, are summed up first; windows then run within (group, range), so a group with most of
    the rows is many tasks. All of it is one plan."""
    placed = df if RANGE in df.columns else with_ranges(df, key, ranges)
    by = [*groups, RANGE]
    w = Window.partitionBy(*by).orderBy(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()})
    totals = placed.groupBy(*by).agg(*[F.sum(c).alias(f"_b_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*groups).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = totals.select(*[F.col(c).alias(f"_of_{c}") for c in by], *[F.coalesce(F.sum(f"_b_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in sums])
    met = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    joined = out.join(before if groups else F.broadcast(before), met)  # without groups at most a row a range
    joined = joined.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in sums}).drop(*[f"_of_{c}" for c in by], *[f"_b_{n}" for n in sums])
    return joined if RANGE in df.columns else joined.drop(RANGE)
