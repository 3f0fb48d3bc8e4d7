"""Operators on ordered series, as window expressions: one shuffle by series, no Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .columns import PI


def ordered(keys: Sequence[str], *by: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*by)


def gradient(c: Column, step: Column | float, w: WindowSpec) -> Column:
    """Central differences on an even grid, one-sided at the ends."""
    before, after = F.lag(c).over(w), F.lead(c).over(w)
    step = step if isinstance(step, Column) else F.lit(step)
    return F.coalesce((after - before) / (2 * step), (after - c) / step, (c - before) / step)


def uneven_gradient(c: Column, s: Column, w: WindowSpec) -> Column:
    """Second-order differences of c along uneven s, one-sided at the ends."""
    a, b = s - F.lag(s).over(w), F.lead(s).over(w) - s
    down, up = c - F.lag(c).over(w), F.lead(c).over(w) - c
    return F.coalesce((a * a * up + b * b * down) / (a * b * (a + b)), up / b, down / a)


def unwrapped(c: Column, w: WindowSpec) -> tuple[Column, Column]:
    """Steps of the wraps to sum: jumps of over half a turn are turned back. (correction of a row; to be summed by ``w``)."""
    jump = c - F.lag(c).over(w)
    wrapped = F.pmod(jump + PI, F.lit(2 * PI)) - PI
    wrapped = F.when((wrapped == -PI) & (jump > 0), PI).otherwise(wrapped)
    return F.when(F.abs(jump) < PI, 0.0).otherwise(F.coalesce(wrapped - jump, F.lit(0.0))), jump


def with_unwrapped(df: DataFrame, column: str, name: str, w: WindowSpec) -> DataFrame:
    fix, _ = unwrapped(F.col(column), w)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_fix", fix).withColumn(name, F.col(column) + F.sum("_fix").over(running)).drop("_fix")


def moving_average(c: Column, taps: int, w: WindowSpec) -> Column:
    """Centred mean of an odd number of taps; the ends are repeated beyond themselves."""
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(c).over(whole), F.last(c).over(whole)
    total = c
    for k in range(1, taps // 2 + 1):
        total = total + F.coalesce(F.lag(c, k).over(w), first) + F.coalesce(F.lead(c, k).over(w), last)
    return total / taps


def running_sum(c: Column, w: WindowSpec) -> Column:
    return F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0))


def arc_step(x: Column, y: Column, w: WindowSpec) -> Column:
    return F.coalesce(F.hypot(x - F.lag(x).over(w), y - F.lag(y).over(w)), F.lit(0.0))


def with_runs(df: DataFrame, keys: Sequence[str], time: str, gap: float, name: str = "run") -> DataFrame:
    """Numbers runs of a series: a new one begins where ``time`` (numeric) jumps by more than ``gap``."""
    w = ordered(keys, time)
    df = df.withColumn("_new", F.coalesce((F.col(time) - F.lag(time).over(w) > gap).cast("bigint"), F.lit(0).cast("bigint")))
    return df.withColumn(name, running_sum(F.col("_new"), w)).drop("_new")


def resampled(df: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], step: float) -> DataFrame:
    """Linear interpolation on the grid from the first time on, every ``step``, up to the last. Each pair of neighbours
    makes the grid points that it covers, so no range join is needed."""
    w = ordered(keys, time)
    whole = Window.partitionBy(*keys)
    t = F.col(time)
    pairs = df.select(*keys, t.alias("a"), F.lead(t).over(w).alias("b"), F.min(t).over(whole).alias("t0"), F.max(t).over(whole).alias("t1"), *[c for v in values for c in (F.col(v).alias(f"a_{v}"), F.lead(v).over(w).alias(f"b_{v}"))])
    low = F.ceil((F.col("a") - F.col("t0")) / step - 1e-9)
    high = F.when(F.col("b").isNull(), F.floor((F.col("t1") - F.col("t0")) / step + 1e-9)).otherwise(F.ceil((F.col("b") - F.col("t0")) / step - 1e-9) - 1)
    out = pairs.withColumn("low", low).withColumn("high", high).filter("low <= high").withColumn("k", F.explode(F.sequence("low", "high")))
    grid = F.col("t0") + F.col("k") * step
    share = F.when(F.col("b").isNull() | (F.col("b") == F.col("a")), 0.0).otherwise((grid - F.col("a")) / (F.col("b") - F.col("a")))
    return out.select(*keys, F.col("k").cast("bigint").alias("k"), grid.alias(time), *[F.coalesce(F.col(f"a_{v}") + share * (F.col(f"b_{v}") - F.col(f"a_{v}")), F.col(f"a_{v}")).alias(v) for v in values])
