"""Fixed overlapping windows of series, their checks and their nested form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_count(n: int, size: int = 61, step: int = 30) -> int:
    return 0 if n < size else (n - size) // step + 1


def cut_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int = 61, step: int = 30, name: str = "window") -> DataFrame:
    """Whole windows of ``size`` rows, one every ``step``: a row appears in each window that holds it. Adds idx (place in
    the series), the window's number and pos (place in it). One shuffle by the series."""
    by = Window.partitionBy(*keys)
    placed = df.withColumn("idx", F.row_number().over(by.orderBy(*order)).cast("bigint") - 1).withColumn("_n", F.count("*").over(by))
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - (size - 1)) / step))
    last = F.least(F.floor(F.col("idx") / step), F.floor((F.col("_n") - size) / step))
    inside = placed.filter(F.col("_n") >= size).withColumn("_a", first.cast("bigint")).withColumn("_b", last.cast("bigint")).filter("_a <= _b")
    return inside.withColumn(name, F.explode(F.sequence("_a", "_b"))).withColumn("pos", F.col("idx") - F.col(name) * step).drop("_n", "_a", "_b")


def incomplete(df: DataFrame, keys: Sequence[str], size: int = 61) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") != size)


def nested(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], kind: str = "float") -> DataFrame:
    """One row a series, one array a channel, in order. Check ``incomplete`` first if all must have one length."""
    rows = F.sort_array(F.collect_list(F.struct(order, *values)))
    out = df.groupBy(*keys).agg(rows.alias("_r"))
    channel = lambda v: F.transform("_r", lambda r: r[v].cast(kind)).alias(v)
    return out.select(*keys, *map(channel, values))
