"""Vehicle-motion simulator: a kinematic bicycle that follows a path, with steering errors, latency and observation noise.

A partition's scenarios run side by side as NumPy arrays, one step for all of them at a time. Random numbers come from a
counter-based generator keyed by (scenario seed, purpose), so results depend neither on partitions nor on neighbours.
``bicycle_states`` is the noise-free bicycle with constant controls as a fold in the plan, without Python.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Defaults of a scenario's configuration.
DEFAULTS = {
    "dt": 0.1, "wheelbase": 2.7, "max_steer": 0.6, "max_accel": 3.0, "max_decel": 5.0, "accel": 0.0, "lookahead_gain": 3.0,
    "min_lookahead": 0.5, "pos_noise_std": 0.0, "heading_noise_std": 0.0, "latency_steps": 0, "steer_bias": 0.0, "steer_noise_std": 0.0,
}
# Ranges of sampled knobs; deviations are sampled log-uniformly, the rest uniformly.
RANGES = {
    "wheelbase": (2.4, 3.2), "max_accel": (2.5, 4.0), "max_decel": (4.0, 6.0), "accel": (-0.5, 0.5), "lookahead_gain": (0.6, 1.4),
    "min_lookahead": (0.2, 1.0), "pos_noise_std": (1e-3, 0.15), "heading_noise_std": (1e-4, 0.03), "steer_bias": (-0.1, 0.1), "steer_noise_std": (1e-4, 0.05),
}
# Levels of the sweep.
SWEEP = {"noise": ("low", "mid", "high"), "latency": (0, 2, 4), "bias": (0.0, 0.2)}
NOISE_RANGES = {
    "low": {"pos_noise_std": (0.002, 0.002), "heading_noise_std": (0.0003, 0.0003), "steer_noise_std": (0.0003, 0.0003)},
    "mid": {"pos_noise_std": (1e-3, 0.15), "heading_noise_std": (1e-4, 0.03), "steer_noise_std": (1e-4, 0.05)},
    "high": {"pos_noise_std": (1e-2, 0.5), "heading_noise_std": (1e-3, 0.1), "steer_noise_std": (1e-3, 0.1)},
}
# Knobs that a sweep holds, and deviations of the recorder's noise, drawn in this order.
PINNED = {"accel": 0.0, "wheelbase": 2.7, "lookahead_gain": 0.9, "min_lookahead": 0.3}
RECORDER = {"x": 0.02, "y": 0.02, "heading": 0.005, "speed": 0.05, "yaw_rate": 0.005}
MASK = (1 << 64) - 1


def mixed_seed(x: int) -> int:
    """The public splitmix64 finaliser."""
    x = (x + 0x9E3779B97F4A7C15) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def scenario_seed(base: int, scenario: int) -> int:
    return mixed_seed((base ^ mixed_seed(scenario & MASK)) & MASK)


def generator(seed: int, purpose: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[seed & MASK, purpose]))


def sampled_config(seed: int, ranges: Mapping[str, tuple[float, float]] | None = None, fixed: Mapping[str, float] | None = None, latency_max: int = 4) -> dict[str, float]:
    """Every knob is drawn, fixed ones too, so fixing one leaves the others as they were."""
    rng, use = generator(seed, 1), {**RANGES, **(ranges or {})}
    out = dict(DEFAULTS)
    for k, (a, b) in use.items():
        u = rng.random()
        out[k] = math.exp(math.log(a) + u * (math.log(b) - math.log(a))) if k.endswith("_std") else a + u * (b - a)
    out["latency_steps"] = int(rng.integers(0, latency_max + 1))
    return out | dict(fixed or {})


def knob_grid(spark: SparkSession) -> DataFrame:
    """config_id, knob_noise, knob_latency, knob_bias: all combinations of the sweep."""
    levels = [F.explode(F.array(*map(F.lit, SWEEP[k]))).alias(f"knob_{k}") for k in ("noise", "latency", "bias")]
    grid = spark.range(1).select(levels[0]).select("*", levels[1]).select("*", levels[2])
    bias = F.when(F.col("knob_bias") == F.floor("knob_bias"), F.col("knob_bias").cast("bigint").cast("string")).otherwise(F.col("knob_bias").cast("string"))
    return grid.select(F.format_string("noise_%s_lat_%d_bias_%s", "knob_noise", "knob_latency", bias).alias("config_id"), "knob_noise", F.col("knob_latency").cast("bigint").alias("knob_latency"), "knob_bias")


def sweep_cell(noise: str, latency: int, bias: float) -> tuple[dict[str, tuple[float, float]], dict[str, float]]:
    """(ranges, fixed knobs) of one combination: what isn't swept is held, so that the sweep shows the swept knobs alone."""
    return dict(NOISE_RANGES[noise]), {"latency_steps": latency, "steer_bias": bias, **PINNED}


def bicycle_states(steer: Column, accel: Column, speed: Column, steps: int, config: Mapping[str, float] | None = None) -> Column:
    """Array of structs t, x, y, heading, speed from the origin: Euler steps on the old heading and speed, as a fold."""
    c = {**DEFAULTS, **(config or {})}
    turn = F.greatest(F.lit(-c["max_steer"]), F.least(F.lit(c["max_steer"]), steer))
    push = F.greatest(F.lit(-c["max_decel"]), F.least(F.lit(c["max_accel"]), accel))
    state = lambda t, x, y, h, v: F.struct(t.alias("t"), x.alias("x"), y.alias("y"), h.alias("heading"), v.alias("speed"))
    zero = F.lit(0.0)
    start = F.array(state(zero, zero, zero, zero, speed.cast("double")))

    def step(states: Column, i: Column) -> Column:
        s = F.element_at(states, -1)
        heading = s["heading"] + s["speed"] / c["wheelbase"] * F.tan(turn) * c["dt"]
        return F.concat(states, F.array(state(i * F.lit(c["dt"]), s["x"] + s["speed"] * F.cos(s["heading"]) * c["dt"], s["y"] + s["speed"] * F.sin(s["heading"]) * c["dt"], heading, F.greatest(zero, s["speed"] + push * c["dt"]))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


class Paths:
    """Paths side by side (a row each, padded by repeating the last point), with what doesn't change from step to step."""

    def __init__(self, paths: Sequence[np.ndarray]):
        n, most = len(paths), max([2, *map(len, paths)])
        pad = np.zeros((2, n, most))
        for i, p in enumerate(paths):
            p = np.asarray(p, float).reshape(-1, 2)
            if len(p):
                pad[:, i, : len(p)], pad[:, i, len(p) :] = p.T, p[-1][:, None]
        self.x, self.y = pad
        self.dx, self.dy = np.diff(pad, axis=2)
        size = self.dx * self.dx + self.dy * self.dy
        self.none = size <= 1e-12
        self.size = np.where(self.none, 1.0, size)
        self.rows, self.legs = np.arange(n), np.arange(most - 1)
        self.led = ~self.none.all(1)

    def steer(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, v: np.ndarray, gain: np.ndarray, least: np.ndarray, wheelbase: np.ndarray) -> np.ndarray:
        """Steering of each row towards the point of its path at the look-ahead distance: the first crossing of that circle from
        the nearest leg on, else the nearest point. A leg crosses if its ends lie on both sides or its nearest point lies within."""
        reach = np.maximum(gain * v, least)
        px, py = self.x - x[:, None], self.y - y[:, None]
        ax, ay, dx, dy = px[:, :-1], py[:, :-1], self.dx, self.dy
        dot = ax * dx
        dot += ay * dy
        along = np.clip(dot / -self.size, 0.0, 1.0)
        nx, ny = along * dx, along * dy
        nx += ax
        ny += ay
        gap = nx * nx
        gap += ny * ny
        gap[self.none] = np.inf
        near, rows = gap.argmin(1), self.rows
        px *= px
        py *= py
        px += py
        limit = (reach * reach)[:, None]
        inside = px <= limit
        cross = inside[:, 1:] != inside[:, :-1]
        cross |= ~inside[:, 1:] & ~inside[:, :-1] & (gap <= limit)
        cross |= (px[:, 1:] == limit) | (px[:, :-1] == limit)
        cross &= ~self.none & (self.legs >= near[:, None])
        hit = cross.argmax(1)
        found = cross[rows, hit]
        b, size = dot[rows, hit], self.size[rows, hit]
        hx, hy = self.x[rows, hit] - x, self.y[rows, hit] - y
        root = np.sqrt(np.maximum(b * b - size * (hx * hx + hy * hy - reach * reach), 0.0))
        first = (-b - root) / size
        t = np.clip(np.where((first >= -1e-12) & (first <= 1), first, (-b + root) / size), 0.0, 1.0)
        gx = np.where(found, hx + t * dx[rows, hit], nx[rows, near])
        gy = np.where(found, hy + t * dy[rows, hit], ny[rows, near])
        alpha = np.arctan2(gy, gx) - h
        return np.where(self.led, np.arctan2(2 * wheelbase * np.sin(alpha), reach), 0.0)


def rollouts(paths: Sequence[np.ndarray], start: np.ndarray, horizon: int, config: Mapping[str, np.ndarray], seeds: Sequence[int]) -> np.ndarray:
    """(scenario, horizon + 1, 6): t, observed x, y, heading, true speed and yaw rate. start: x, y, heading, speed."""
    if horizon < 0:
        raise ValueError("a horizon can't be negative")
    if not len(paths) == len(start) == len(seeds):
        raise ValueError("paths, states and seeds differ in number")
    n = len(paths)
    if not n:
        return np.zeros((0, horizon + 1, 6))
    ahead = Paths(paths)
    c = {k: np.broadcast_to(np.asarray(config.get(k, v), float), (n,)) for k, v in DEFAULTS.items()}
    noise = np.zeros((n, horizon))
    seen = np.zeros((n, horizon + 1, 3))
    for i, s in enumerate(seeds):  # deviations of zero need no draws
        if c["steer_noise_std"][i]:
            noise[i] = generator(s, 2).standard_normal(horizon)
        if c["pos_noise_std"][i] or c["heading_noise_std"][i]:
            seen[i] = generator(s, 3).standard_normal((horizon + 1, 3))
    x, y, h, v = np.asarray(start, float).T.copy()
    applied = np.zeros(n)
    late = c["latency_steps"].astype(int)
    push = np.clip(c["accel"], -c["max_decel"], c["max_accel"])
    wanted = np.zeros((n, horizon + 1))
    out = np.zeros((n, horizon + 1, 6))
    rows = np.arange(n)
    for k in range(horizon + 1):
        out[:, k, 0] = k * c["dt"]
        out[:, k, 1], out[:, k, 2] = x + c["pos_noise_std"] * seen[:, k, 0], y + c["pos_noise_std"] * seen[:, k, 1]
        out[:, k, 3], out[:, k, 4], out[:, k, 5] = h + c["heading_noise_std"] * seen[:, k, 2], v, v / c["wheelbase"] * np.tan(applied)
        if k == horizon:
            break
        steer = ahead.steer(x, y, h, v, c["lookahead_gain"], c["min_lookahead"], c["wheelbase"])
        wanted[:, k] = steer * (1 + c["steer_bias"]) + c["steer_noise_std"] * noise[:, k]
        steer = np.where(late <= k, wanted[rows, np.maximum(0, k - late)], 0.0)
        applied = np.clip(steer, -c["max_steer"], c["max_steer"])
        x, y = x + v * np.cos(h) * c["dt"], y + v * np.sin(h) * c["dt"]
        h = h + v / c["wheelbase"] * np.tan(applied) * c["dt"]
        v = np.maximum(0.0, v + push * c["dt"])
    return out


STATES = ("t", "x", "y", "heading", "speed", "yaw_rate")
ROLLOUT_DDL = "scenario_id bigint, step bigint, t double, x double, y double, heading double, speed double, yaw_rate double"


def lists_of(column: pa.Array) -> list[np.ndarray]:
    """The lists of an Arrow column as arrays that share its memory."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def batch_rollout(df: DataFrame, horizon: int = 60, base: int = 42, knobs: Sequence[str] = (), block: int = 128) -> DataFrame:
    """Long rows for scenarios (scenario_id, path_x, path_y, x, y, heading, speed and any knobs as columns), dealt to as many
    tasks as the cluster runs at once; results don't depend on how."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                column = lambda n: part.column(n).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                paths = [np.column_stack(p) for p in zip(lists_of(part.column("path_x")), lists_of(part.column("path_y")), strict=True)]
                ids = column("scenario_id")
                got = rollouts(paths, np.column_stack([column(n) for n in STATES[1:5]]), horizon, {k: column(k).astype(float) for k in knobs}, [scenario_seed(base, int(s)) for s in ids]).reshape(-1, 6)
                steps = np.tile(np.arange(horizon + 1), len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.repeat(ids, horizon + 1), steps, *got.T.copy())], names=["scenario_id", "step", *STATES])

    number = [F.col(n).cast("double").alias(n) for n in (*STATES[1:5], *knobs)]
    path = [F.col(n).cast("array<double>").alias(n) for n in ("path_x", "path_y")]
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.select(F.col("scenario_id").cast("bigint").alias("scenario_id"), *path, *number).repartition(tasks, "scenario_id").mapInArrow(run, ROLLOUT_DDL)


@lru_cache(maxsize=8)
def second_differences(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared weights and vectors of the penalty on second differences of n points."""
    d = np.diff(np.eye(n), 2, axis=0)
    weights, vectors = np.linalg.eigh(d.T @ d)
    return np.maximum(weights, 0.0), vectors


def reference_path(x: np.ndarray, y: np.ndarray, points: int = 400, tail: float = 10.0, rms: float = 0.05) -> np.ndarray:
    """A smooth path through noisy points, even in arc length, with a straight tail. Smoothing is a penalty on second
    differences, raised until the residual reaches ``rms``."""
    if len(x) < 4:
        raise ValueError("a path needs four points")
    step = np.hypot(np.diff(x), np.diff(y))
    keep = np.concatenate([[True], step > 1e-6])
    px, py = np.asarray(x, float)[keep], np.asarray(y, float)[keep]
    if len(px) < 4:
        return np.repeat([[float(x[0]), float(y[0])]], points, 0)
    weights, vectors = second_differences(len(px))
    parts = vectors.T @ np.column_stack([px, py])
    strength = np.logspace(-3, 4, 29)[:, None]
    kept = 1 / (1 + strength * weights)  # (strengths, parts)
    residual = np.sqrt((((1 - kept) ** 2) @ (parts**2).sum(1)) / len(px))
    strong = int(np.argmax(residual > rms)) if (residual > rms).any() else len(residual)
    best = vectors @ (kept[strong - 1][:, None] * parts) if strong else np.column_stack([px, py])
    s = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(best, axis=0).T))])
    grid = np.linspace(0, s[-1], points)
    path = np.column_stack([np.interp(grid, s, best[:, 0]), np.interp(grid, s, best[:, 1])])
    way = path[-1] - path[-2]
    way = way / max(1e-12, np.hypot(*way))
    return np.concatenate([path, path[-1] + np.arange(0.5, tail + 1e-9, 0.5)[:, None] * way])


TRACK_DDL = "segment_id bigint, scene_id string, agent_token string, template string, t double, x double, y double, heading double, speed double, yaw_rate double"
TEMPLATES = ("cruise", "cut_in", "merge", "turn_left")
# Ranges of speed (m/s), of where a turn or shift begins (share of the way), of its length (share of the way, or m), and of a straight way's heading.
SPEEDS = {"cruise": (8.0, 12.0), "cut_in": (5.0, 9.0), "merge": (5.0, 9.0), "turn_left": (4.0, 7.0)}
TURN_AT, TURN_LENGTH = (0.25, 0.3), (0.35, 0.45)
SHIFT_AT, SHIFT_LENGTH, MERGE_LENGTH, SHIFT = (0.3, 0.5), (18.0, 26.0), (9.0, 12.0), 2.0
STRAIGHT = (-0.03, 0.03)


def _nested(df: DataFrame, keys: Sequence[str], seed: Column) -> DataFrame:
    """keys, seed, and each channel as one array a segment, in order of t."""
    rows = F.sort_array(F.collect_list(F.struct(*STATES)))
    channel = lambda c: F.transform("r", lambda r: r[c].cast("double")).alias(c)
    return df.groupBy(*keys).agg(rows.alias("r")).select(*keys, seed.alias("seed"), *map(channel, STATES))


def _long(df: DataFrame, keys: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """A row for each place of the channels' arrays."""
    return df.select(*keys, *more, F.inline(F.arrays_zip(*STATES)))


def _arrays(keys: Sequence[str], df: DataFrame, more: str = "") -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *([more] if more else []), *(f"{c} array<double>" for c in STATES)])


def recorder_noise(df: DataFrame, keys: Sequence[str], tag: str) -> DataFrame:
    """Segments (keys, t, channels) as a recorder would log them: noise by the segment's key, speeds not below 0, then a
    three-tap mean of heading, speed and yaw rate. Many segments pass through a Python worker at once."""
    from ..functions.columns import md5_seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            channels = {c: lists_of(batch.column(c)) for c in STATES}
            for i, seed in enumerate(batch.column("seed").to_pylist()):
                rng = generator(seed, 5)
                for c, deviation in RECORDER.items():
                    noisy = channels[c][i] + deviation * rng.standard_normal(len(channels[c][i]))
                    if c == "speed":
                        noisy = np.maximum(noisy, 0.0)
                    if c in ("heading", "speed", "yaw_rate") and len(noisy):
                        wide = np.concatenate([noisy[:1], noisy, noisy[-1:]])
                        noisy = (wide[:-2] + wide[1:-1] + wide[2:]) / 3
                    channels[c][i] = noisy
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(channels[c], pa.list_(pa.float64())) for c in STATES)], names=[*keys, *STATES])

    seed = md5_seed(F.concat_ws("|", F.lit(tag), *[F.col(k).cast("string") for k in keys]))
    nested = _nested(df.select(*keys, *STATES), keys, seed)
    return _long(nested.mapInArrow(run, _arrays(keys, df)), keys)


def _driven(df: DataFrame, keys: Sequence[str], seed: Column, horizon: int, config_of: Callable[[int, np.ndarray], dict[str, float]]) -> DataFrame:
    """A rollout of each segment from its first row along the path fitted to it, with config_json."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                channels = {c: lists_of(part.column(c)) for c in STATES}
                seeds = part.column("seed").to_pylist()
                configs = [config_of(s, v) for s, v in zip(seeds, channels["speed"], strict=True)]
                paths = [reference_path(x, y) for x, y in zip(channels["x"], channels["y"], strict=True)]
                start = np.array([[channels[c][i][0] for c in STATES[1:5]] for i in range(len(seeds))])
                got = rollouts(paths, start, horizon, {k: np.array([c[k] for c in configs]) for k in DEFAULTS}, [mixed_seed(s) for s in seeds])
                texts = [json.dumps(c | {"config_seed": s}, sort_keys=True) for c, s in zip(configs, seeds, strict=True)]
                flat = [pa.array(list(got[:, :, k]), pa.list_(pa.float64())) for k in range(6)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), pa.array(texts), *flat], names=[*keys, "config_json", *STATES])

    nested = _nested(df.select(*keys, *STATES), keys, seed).repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)
    return _long(nested.mapInArrow(run, _arrays(keys, df, "config_json string")), keys, ["config_json"])


def matched_rollouts(segments: DataFrame, horizon: int = 60, base: int = 42, fixed: Mapping[str, float] | None = None, ranges: Mapping[str, tuple[float, float]] | None = None, keys: Sequence[str] = ("segment_id",)) -> DataFrame:
    """A simulated counterpart of each segment (keys, t and channels), from its first row along its path. Parked segments (no
    speed of 0.5) don't accelerate. Adds config_json."""
    from ..functions.columns import md5_seed

    def config_of(seed: int, speed: np.ndarray) -> dict[str, float]:
        config = sampled_config(seed, ranges, fixed)
        if speed.max() < 0.5:
            config["accel"] = min(0.0, config["accel"])
        return config

    seed = md5_seed(F.concat_ws("|", F.lit(str(base)), *[F.col(k).cast("string") for k in keys]))
    return _driven(segments, keys, seed, horizon, config_of)


# The controller that stands for reality.
REFERENCE = {**DEFAULTS, **PINNED, "pos_noise_std": 0.002, "heading_noise_std": 0.0003, "steer_noise_std": 0.0003}


def reference_rollouts(tracks: DataFrame, size: int = 61, step: int = 30) -> DataFrame:
    """Tracks (scene_id, agent_token, t and channels) as the reference controller drives them, a window at a time: scene_id,
    agent_token, window, t and channels. A track shorter than a window gives none."""
    from ..functions.columns import md5_seed
    from .windows import cut_windows

    keys = ["scene_id", "agent_token", "window"]
    cut = cut_windows(tracks.select("scene_id", "agent_token", *STATES), keys[:2], ["t"], size, step)
    seed = md5_seed(F.concat_ws(":", "scene_id", "agent_token", (F.col("window") * step).cast("string")))
    return _driven(cut, keys, seed, size - 1, lambda _, __: dict(REFERENCE)).drop("config_json")
