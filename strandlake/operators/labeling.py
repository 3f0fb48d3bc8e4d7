"""Rule-based event labels of segments: one pass of aggregates, the first rule that holds wins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import quantised
from ..functions.series import ordered, with_unwrapped

# Thresholds of the rules.
THRESHOLDS = {
    "stop_and_go": {"stop_speed": 0.5, "min_speed_range": 5.0},
    "unprotected_left": {"min_heading_change": 1.0, "min_mean_speed": 1.0},
    "lateral": {"min_lateral_m": 1.6, "max_heading_change": 0.6, "cut_in_from": 0.25, "cut_in_to": 0.75},
}
MANEUVERS = ("cut_in", "merge", "unprotected_left", "lane_keep", "stop_and_go")


def thresholds(overrides: Mapping[str, Mapping[str, float]] | None = None, complete: bool = False) -> dict[str, dict[str, float]]:
    """Defaults with some replaced. Unknown names are refused, and with ``complete``, as for a record of all thresholds, missing ones."""
    out = {k: dict(v) for k, v in THRESHOLDS.items()}
    missing = [f"{rule}.{k}" for rule, v in out.items() for k in v if k not in (overrides or {}).get(rule, {})]
    if complete and missing:
        raise ValueError(f"no value for {', '.join(missing)}")
    for rule, values in (overrides or {}).items():
        for k, v in values.items():
            if k not in out.get(rule, {}):
                raise ValueError(f"no threshold {rule}.{k}")
            out[rule][k] = float(v)
    return out


def maneuvers(df: DataFrame, keys: Sequence[str], overrides: Mapping[str, Mapping[str, float]] | None = None) -> DataFrame:
    """keys, maneuver, from long rows with t, x, y, heading, speed. Segments need two rows; others have a null label. Figures are
    rounded to six digits before they meet a threshold, so that one which stands at it is at it however sums were ordered."""
    cfg = thresholds(overrides)
    w = ordered(keys, "t")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = with_unwrapped(df, "heading", "_h", w)
    first = lambda c: F.first(c).over(whole)
    df = df.withColumn("_lat", quantised(F.abs(-F.sin(first("heading")) * (F.col("x") - first("x")) + F.cos(first("heading")) * (F.col("y") - first("y")))))
    got = df.groupBy(*keys).agg(
        F.count("*").alias("n"), quantised(F.min("speed")).alias("slow"), quantised(F.max("speed")).alias("fast"), quantised(F.avg("speed")).alias("mean"),
        quantised(F.max_by("_h", "t") - F.min_by("_h", "t")).alias("turn"), F.min("t").alias("t0"), F.max("t").alias("t1"),
        F.max(F.struct(F.col("_lat").alias("a"), (-F.col("t")).alias("back"))).alias("peak"),
    )
    s, u, c = cfg["stop_and_go"], cfg["unprotected_left"], cfg["lateral"]
    part = quantised(F.when(F.col("t1") > F.col("t0"), (-F.col("peak.back") - F.col("t0")) / (F.col("t1") - F.col("t0"))).otherwise(0.0))
    aside = (F.col("peak.a") >= c["min_lateral_m"]) & (F.abs("turn") <= c["max_heading_change"])
    label = (
        F.when((F.col("slow") <= s["stop_speed"]) & (quantised(F.col("fast") - F.col("slow")) >= s["min_speed_range"]), "stop_and_go")
        .when((F.col("turn") >= u["min_heading_change"]) & (F.col("mean") >= u["min_mean_speed"]), "unprotected_left")
        .when(aside & (part > c["cut_in_from"]) & (part < c["cut_in_to"]), "cut_in")
        .when(aside, "merge")
        .otherwise("lane_keep")
    )
    return got.select(*keys, F.when(F.col("n") >= 2, label).alias("maneuver"))
