"""Tracks from token-linked keyframe tables: scene, sample, sample_annotation, ego_pose. Links are followed by equi joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import yaw_of
from ..functions.series import gradient, moving_average, ordered, resampled, with_runs, with_unwrapped


def origins(sample: DataFrame, ego_pose: DataFrame) -> DataFrame:
    """scene_token, ox, oy: where the recorder stood at the scene's first sample."""
    first = sample.groupBy("scene_token").agg(F.min_by("ego_pose_token", "timestamp").alias("token"))
    return first.join(ego_pose, "token").select("scene_token", F.get("translation", F.lit(0)).alias("ox"), F.get("translation", F.lit(1)).alias("oy"))


def observations(scene: DataFrame, sample: DataFrame, annotation: DataFrame, ego_pose: DataFrame) -> DataFrame:
    """scene_id, agent_token, t (s), x, y (from the scene's origin), heading."""
    rows = annotation.join(sample.select(F.col("token").alias("sample_token"), "scene_token", "timestamp"), "sample_token")
    rows = rows.join(origins(sample, ego_pose), "scene_token").join(scene.select(F.col("token").alias("scene_token"), F.col("name").alias("scene_id")), "scene_token")
    q = lambda k: F.col("rotation")[k]
    return rows.select(
        "scene_id", F.col("instance_token").alias("agent_token"), (F.col("timestamp") / 1e6).alias("t"),
        (F.get("translation", F.lit(0)) - F.col("ox")).alias("x"), (F.get("translation", F.lit(1)) - F.col("oy")).alias("y"), yaw_of(q("w"), q("x"), q("y"), q("z")).alias("heading"),
    )


def tracks(observed: DataFrame, step: float = 0.1, gap: float = 1.0, least: float = 6.0, taps: int = 5) -> DataFrame:
    """Runs without gaps, on an even grid, smoothed, with speed and yaw rate. Runs shorter than ``least`` seconds go."""
    keys = ["scene_id", "agent_token", "run"]
    runs = with_runs(observed, keys[:2], "t", gap)
    span = Window.partitionBy(*keys)
    runs = runs.withColumn("_s", F.max("t").over(span) - F.min("t").over(span)).withColumn("_c", F.count("*").over(span)).filter((F.col("_s") >= least - 1e-9) & (F.col("_c") >= 2)).drop("_s", "_c")
    runs = with_unwrapped(runs, "heading", "h", ordered(keys, "t"))
    grid = resampled(runs.withColumn("heading", F.col("h")), keys, "t", ["x", "y", "heading"], step)
    w = ordered(keys, "k")
    grid = grid.withColumns({c: moving_average(F.col(c), taps, w) for c in ("x", "y", "heading")})
    grid = grid.withColumns({"_dx": gradient(F.col("x"), step, w), "_dy": gradient(F.col("y"), step, w), "yaw_rate": gradient(F.col("heading"), step, w)})
    return grid.withColumn("speed", F.hypot("_dx", "_dy")).drop("_dx", "_dy")
