"""Thirty features of segments. Time-domain ones are window expressions and one aggregation; the power spectrum is a
transform of the segment's array in Arrow batches. Standard deviations are of populations; what isn't finite becomes 0."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite
from ..functions.series import arc_step, gradient, ordered, running_sum, with_unwrapped

FS = 10.0
LEAST_ROWS = 4


def kinematics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with accel, jerk, lat_accel, curvature, heading_rate, the arc so far and the time to the path's end at this
    speed. Rates are taken by each segment's median step."""
    w, whole = ordered(keys, "t"), Window.partitionBy(*keys)
    df = with_unwrapped(df, "heading", "_h", w).withColumn("_gap", F.col("t") - F.lag("t").over(w)).withColumn("_dt", F.median("_gap").over(whole))
    dt = F.col("_dt")
    df = df.withColumn("accel", gradient(F.col("speed"), dt, w)).withColumn("heading_rate", gradient(F.col("_h"), dt, w))
    df = df.withColumn("jerk", gradient(F.col("accel"), dt, w)).withColumn("_step", arc_step(F.col("x"), F.col("y"), w))
    df = df.withColumn("arc", running_sum(F.col("_step"), w))
    left = (F.max("arc").over(whole) - F.col("arc")) / F.greatest(F.col("speed"), F.lit(0.1))
    df = df.withColumn("path_end", F.least(F.lit(10.0), F.greatest(F.lit(0.0), left)))
    return df.withColumn("lat_accel", F.col("speed") * F.col("yaw_rate")).withColumn("curvature", F.when(F.col("speed") > 0.5, F.abs(F.try_divide("yaw_rate", "speed"))).otherwise(0.0)).drop("_h", "_step", "_gap", "_dt")


def _std(c: str) -> Column:
    return F.stddev_pop(c)


def motion_features(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All but the spectral features. A segment of under four rows is an error."""
    k = kinematics(df, keys)
    a = lambda c: F.abs(F.col(c))
    flat = (F.stddev_pop("curvature") <= 1e-12) | (F.stddev_pop("speed") <= 1e-12)
    out = k.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.avg("speed").alias("speed_mean"), _std("speed").alias("speed_std"), F.max("speed").alias("speed_max"), F.min("speed").alias("speed_min"),
        F.avg(a("accel")).alias("accel_mean"), _std("accel").alias("accel_std"), F.max(a("accel")).alias("accel_max"),
        F.avg(a("jerk")).alias("jerk_mean"), _std("jerk").alias("jerk_std"), F.max(a("jerk")).alias("jerk_max"), F.percentile(a("jerk"), 0.95).alias("jerk_p95"),
        F.avg(a("lat_accel")).alias("lat_accel_mean"), _std("lat_accel").alias("lat_accel_std"), F.max(a("lat_accel")).alias("lat_accel_max"), F.percentile(a("lat_accel"), 0.95).alias("lat_accel_p95"),
        F.sqrt(F.avg(F.col("lat_accel") * F.col("lat_accel"))).alias("lat_accel_rms"),
        F.avg("curvature").alias("curvature_mean"), F.percentile("curvature", 0.95).alias("curvature_p95"), F.when(flat, 0.0).otherwise(F.try_divide(F.covar_pop("curvature", "speed"), _std("curvature") * _std("speed"))).alias("curv_speed_corr"),
        F.avg(a("heading_rate")).alias("heading_rate_mean"), _std("heading_rate").alias("heading_rate_std"), F.max(a("heading_rate")).alias("heading_rate_max"),
        (1 / (1 + _std("heading_rate"))).alias("heading_smoothness"),
        (F.avg("speed") / 6).alias("ttc_stop_mean"), (F.min("speed") / 6).alias("ttc_stop_min"),
        F.min("path_end").alias("ttc_path_end_min"),
    )
    out = out.filter(F.when(F.col("_n") >= LEAST_ROWS, True).otherwise(F.raise_error(F.lit(f"a segment has under {LEAST_ROWS} rows")).cast("boolean")))
    names = [c for c in out.columns if c not in keys and not c.startswith("_")]
    return out.select(*keys, *[finite(F.col(c)).alias(c) for c in names])


def densities(x: np.ndarray, fs: float, most: int) -> np.ndarray:
    """Of signals of one length, a row each: one-sided densities by Welch's method."""
    size = x.shape[1]
    n = min(size, most)
    step = max(1, n - n // 2)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    total, parts = 0.0, range(0, size - n + 1, step)
    for at in parts:
        part = x[:, at : at + n]
        total = total + np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * taper, axis=1)) ** 2
    sides = np.full(n // 2 + 1, 2.0)
    sides[0] = 1.0
    if n % 2 == 0:
        sides[-1] = 1.0
    return total / len(parts) * sides / (fs * (0.375 * n if n > 2 else 1.0))


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, signals as a matrix) of rows whose last column has arrays of one length."""
    for batch in batches:
        lengths = np.array(pc.list_value_length(batch.column(batch.num_columns - 1)))
        for n in np.unique(lengths):
            rows = batch.take(pa.array(np.flatnonzero(lengths == n)))
            flat = rows.column(rows.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield rows, flat.reshape(rows.num_rows, n)


def _signals(df: DataFrame, keys: Sequence[str], signal: str) -> tuple[DataFrame, str]:
    rows = df.filter(F.size(signal) > 0).select(*keys, F.col(signal).cast("array<double>").alias("_signal"))
    return rows, "".join(f"`{n}` {t}, " for n, t in rows.dtypes if n in keys)


def power_density(df: DataFrame, keys: Sequence[str], signal: str, fs: float = FS, most: int = 64) -> DataFrame:
    """keys, k, density, n_bins, width: one-sided density by Welch's method at the frequencies k * width. Parts of
    min(n, most) samples overlap by half; their mean is removed; the window is a periodic Hann window. A transform of each
    segment's array, in Arrow batches: nothing is dealt anew."""
    rows, ddl = _signals(df, keys, signal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _by_length(batches):
            d = densities(x, fs, most)
            at, bins = pa.array(np.repeat(np.arange(len(d)), d.shape[1])), d.shape[1]
            columns = [part.column(i).take(at) for i in range(len(keys))]
            more = [np.tile(np.arange(bins, dtype=np.int32), len(d)), d.ravel(), np.full(d.size, bins, np.int64), np.full(d.size, fs / min(x.shape[1], most))]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, more)], names=[*keys, "k", "density", "n_bins", "width"])

    return rows.mapInArrow(run, ddl + "k int, density double, n_bins bigint, width double")


def spectral_features(df: DataFrame, keys: Sequence[str], signal: str, fs: float = FS, most: int = 64) -> DataFrame:
    """Power in [0, 2] and (2, 5] Hz and in all, by trapezoids, and the bands' ratio (at most 100)."""
    rows, ddl = _signals(df, keys, signal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _by_length(batches):
            d, width = densities(x, fs, most), fs / min(x.shape[1], most)
            last = d.shape[1] - 1
            two, top = math.floor(2.0 / width + 1e-9), min(math.floor(5.0 / width + 1e-9), last)
            area = lambda a, b, d=d, width=width: np.trapezoid(d[:, a : b + 1], dx=width, axis=1) if a < b else np.zeros(len(d))
            low, high, whole = area(0, min(two, last)), area(two + 1, top), area(0, last)
            ratio = np.where(high > 1e-12, np.clip(low / np.where(high > 1e-12, high, 1.0), 0.0, 100.0), np.where(low > 1e-12, 100.0, 0.0))
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keys))], *map(pa.array, (low, high, whole, ratio))], names=[*keys, "yaw_psd_0_2hz", "yaw_psd_2_5hz", "yaw_psd_total", "yaw_psd_ratio"])

    return rows.mapInArrow(run, ddl + "yaw_psd_0_2hz double, yaw_psd_2_5hz double, yaw_psd_total double, yaw_psd_ratio double")


def extract_features(df: DataFrame, keys: Sequence[str], fs: float = FS) -> DataFrame:
    """All thirty."""
    from .windows import nested

    spectrum = spectral_features(nested(df, keys, "t", ["yaw_rate"], "double"), keys, "yaw_rate", fs)
    return motion_features(df, keys).join(spectrum, list(keys))
