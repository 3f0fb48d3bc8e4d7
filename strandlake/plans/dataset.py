"""The dataset from start to end: real windows, simulated counterparts, recorder's noise on both, labels, splits, features."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators import features, labeling, simulate, splits, windows

KEYS = ["scene_id", "agent_token", "window"]


@dataclass
class Dataset:
    segments: DataFrame
    labels: DataFrame
    features: DataFrame

    def checked(self) -> Dataset:
        """Raises if a scene is in two splits or a segment isn't whole."""
        splits.assert_no_leak(self.labels, "scene_id")
        bad = windows.incomplete(self.segments, ["segment_id"]).limit(1).collect()
        if bad:
            raise ValueError(f"segment {bad[0]['segment_id']} has {bad[0]['n']} rows")
        return self

    def views(self) -> None:
        for name in ("segments", "labels", "features"):
            getattr(self, name).createOrReplaceTempView(name)

    def aligned(self) -> DataFrame:
        """A row a segment: its label, features and channels as arrays, joined by segment_id."""
        series = windows.nested(self.segments, ["segment_id"], "t", list(schemas.CHANNELS[1:]))
        return self.labels.join(self.features.drop("scene_id", "source"), "segment_id").join(series, "segment_id")

    def manifest(self) -> DataFrame:
        """source, split, maneuver, n, n_scenes."""
        return self.labels.groupBy("source", "split", "maneuver").agg(F.count("*").alias("n"), F.countDistinct("scene_id").alias("n_scenes"))


def numbered(real: DataFrame) -> DataFrame:
    """Adds segment_id from 0 on in order of scene, agent and window, and n_real, how many there are. Offsets are summed over
    scenes, a row each; segments are numbered within their scene."""
    keys = real.select(*KEYS).distinct()
    scenes = keys.groupBy("scene_id").agg(F.count("*").alias("n"))
    before = Window.orderBy("scene_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scenes.select("scene_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy()).alias("n_real"))
    within = Window.partitionBy("scene_id").orderBy("agent_token", "window")
    ids = keys.join(offsets, "scene_id").select(*KEYS, (F.col("first") + F.row_number().over(within) - 1).alias("segment_id"), "n_real")
    return real.join(ids, KEYS)


def build(real: DataFrame, fixed: Mapping[str, float] | None = None, ranges: Mapping[str, tuple[float, float]] | None = None, base: int = 42) -> Dataset:
    """Of real windows (scene_id, agent_token, window, t and channels). A simulated segment has the number of its real one
    plus how many of these there are."""
    channels = list(schemas.CHANNELS)
    named = numbered(real)
    about = named.select("segment_id", "scene_id", "agent_token", "n_real").distinct()
    sim = simulate.matched_rollouts(named, base=base, fixed=fixed, ranges=ranges)
    logged = lambda df, tag: simulate.recorder_noise(df.select("segment_id", *channels), ["segment_id"], tag)
    sides = []
    for source, rows in (("real", named), ("sim", sim)):
        joined = logged(rows, source).join(about, "segment_id")
        number = F.col("segment_id") + (F.col("n_real") if source == "sim" else F.lit(0))
        sides.append(joined.select(number.alias("segment_id"), "scene_id", F.lit(source).alias("source"), "agent_token", *channels))
    segments = sides[0].unionByName(sides[1])
    configs = sim.select("segment_id", "config_json").distinct().join(about.select("segment_id", "n_real"), "segment_id").select((F.col("segment_id") + F.col("n_real")).alias("segment_id"), "config_json")
    heads = segments.select("segment_id", "scene_id", "source", "agent_token").distinct()
    labels = heads.join(labeling.maneuvers(segments, ["segment_id"]), "segment_id").withColumn("split", splits.split_of(F.col("scene_id"))).join(configs, "segment_id", "left")
    found = heads.select("segment_id", "scene_id", "source").join(features.extract_features(segments, ["segment_id"]), "segment_id")
    return Dataset(segments, labels.select("segment_id", "scene_id", "source", "agent_token", "maneuver", "split", "config_json"), found.select("segment_id", "scene_id", "source", *schemas.FEATURES))
