"""The segment engine on small inputs whose results are known."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from strandlake import schemas
from strandlake.functions import columns, series
from strandlake.functions.running import running_totals
from strandlake.operators import evaluation, features, inference, labeling, metrics, models, power, simulate, slices, splits, windows
from strandlake.plans import dataset
from strandlake.sources import files


def track(spark, n=61, x=None, y=None, heading=None, speed=None, key=0, yaw=None):
    t = [i / 10 for i in range(n)]
    pick = lambda f, d: [float(f(a)) if f else d for a in t]
    v = pick(speed, 10.0)
    xs = [float(x(a)) for a in t] if x else [10.0 * a for a in t]
    rows = list(zip([key] * n, t, xs, pick(y, 0.0), pick(heading, 0.0), v, pick(yaw, 0.0), strict=True))
    return spark.createDataFrame(rows, "segment_id bigint, t double, x double, y double, heading double, speed double, yaw_rate double")


@pytest.mark.parametrize(("n", "count"), [(0, 0), (1, 0), (60, 0), (61, 1), (90, 1), (91, 2), (121, 3)])
def test_window_counts(spark, n, count):
    assert windows.window_count(n) == count
    cut = windows.cut_windows(track(spark, n), ["segment_id"], ["t"])
    got = {r["window"]: (r["n"], r["first"]) for r in cut.groupBy("window").agg(F.count("*").alias("n"), F.min("idx").alias("first")).collect()}
    assert got == {k: (61, 30 * k) for k in range(count)}


def test_labels(spark):
    label = lambda d, o=None: labeling.maneuvers(d, ["segment_id"], o).first()["maneuver"]
    assert label(track(spark)) == "lane_keep"
    side = track(spark, y=lambda t: 2.0 * math.exp(-((t - 3) ** 2)))
    assert label(side) == "cut_in" and label(side, {"lateral": {"min_lateral_m": 5}}) == "lane_keep"
    assert label(track(spark, y=lambda t: 2.0 * math.exp(-((t - 0.9) ** 2) * 9))) == "merge"
    assert label(track(spark, speed=lambda t: abs(10 - t * 20 / 6))) == "stop_and_go"
    assert label(track(spark, heading=lambda t: t / 6 * math.pi / 2, speed=lambda t: 5)) == "unprotected_left"
    assert label(track(spark, 1)) is None
    with pytest.raises(ValueError):
        labeling.thresholds({"lateral": {"unknown": 1}})


def test_features_are_finite_and_right(spark):
    rng = np.random.default_rng(1)
    shapes = [
        track(spark, speed=lambda t: 0, x=lambda t: 0),
        track(spark),
        track(spark, x=lambda t: 10 * math.cos(t), y=lambda t: 10 * math.sin(t), heading=lambda t: math.pi / 2 + t, yaw=lambda t: 1.0),
        track(spark, speed=lambda t: abs(rng.normal(5, 2)), heading=lambda t: rng.normal(), yaw=lambda t: rng.normal()),
    ]
    for d in shapes:
        row = features.extract_features(d, ["segment_id"]).first().asDict()
        assert set(row) == {"segment_id", *schemas.FEATURES} and all(math.isfinite(v) for v in row.values())
    d = shapes[3].orderBy("t").toPandas()
    row = features.extract_features(shapes[3].sparkSession.createDataFrame(d), ["segment_id"]).first()
    v = d["speed"].to_numpy()
    jerk = np.gradient(np.gradient(v, 0.1), 0.1)
    assert np.isclose(row["jerk_p95"], np.percentile(abs(jerk), 95)) and np.isclose(row["speed_std"], v.std())
    assert np.isclose(row["heading_rate_std"], np.gradient(np.unwrap(d["heading"]), 0.1).std())
    y = d["yaw_rate"].to_numpy()
    h = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(61) / 61)
    p = abs(np.fft.rfft((y - y.mean()) * h)) ** 2 / (10 * (h * h).sum())
    p[1:] *= 2
    assert np.isclose(row["yaw_psd_total"], np.trapezoid(p, dx=10 / 61)) and np.isclose(row["yaw_psd_0_2hz"], np.trapezoid(p[:13], dx=10 / 61))
    with pytest.raises(Exception, match="under 4 rows"):
        features.motion_features(track(spark, 3), ["segment_id"]).collect()
    slow = track(spark, speed=lambda t: t * t).withColumn("t", F.col("t") * 2)  # a grid of another step
    assert np.isclose(features.motion_features(slow, ["segment_id"]).first()["accel_max"], np.gradient(np.arange(61) ** 2 / 100, 0.2).max())
    ends = features.kinematics(track(spark, speed=lambda t: 2.0), ["segment_id"]).orderBy("t").collect()
    assert np.allclose([r["path_end"] for r in ends], [min(10, (6 - i / 10) * 10 / 2) for i in range(61)])


def test_long_signals_are_averaged_over_parts(spark):
    x = np.random.default_rng(3).normal(size=150)
    d = spark.createDataFrame([(1, x.tolist())], "id bigint, s array<double>")
    got = np.array([r["density"] for r in features.power_density(d, ["id"], "s").orderBy("k").collect()])
    h = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)
    want = np.mean([abs(np.fft.rfft((x[a : a + 64] - x[a : a + 64].mean()) * h)) ** 2 for a in (0, 32, 64)], axis=0) / (10 * 24)
    want[1:-1] *= 2
    assert np.allclose(got, want)


def test_series(spark):
    rng = np.random.default_rng(2)
    a = rng.uniform(-3.1, 3.1, 50)
    s = np.cumsum(rng.uniform(0.1, 1, 50))
    d = spark.createDataFrame([(0, i, float(a[i]), float(s[i])) for i in range(50)], "k bigint, i bigint, a double, s double")
    w = series.ordered(["k"], "i")
    got = series.with_unwrapped(d, "a", "u", w).withColumn("g", series.uneven_gradient(F.col("a"), F.col("s"), w)).orderBy("i").collect()
    assert np.allclose([r["u"] for r in got], np.unwrap(a)) and np.allclose([r["g"] for r in got], np.gradient(a, s))
    grid = series.resampled(d, ["k"], "s", ["a"], 0.3).orderBy("k", "s").collect()
    assert np.allclose([r["a"] for r in grid], np.interp([r["s"] for r in grid], s, a)) and len(grid) == int((s[-1] - s[0]) / 0.3 + 1e-9) + 1


def test_splits(spark):
    scenes = spark.createDataFrame([(f"scene_{i:03d}",) for i in range(60)], "s string")
    got = {r[0]: r[1] for r in scenes.select("s", splits.split_of(F.col("s"))).collect()}
    for k, v in got.items():
        b = int(hashlib.md5(k.encode()).hexdigest(), 16) % 100
        assert v == ("train" if b < 70 else "val" if b < 85 else "test")
    with pytest.raises(ValueError):
        splits.split_of(F.lit("x"), 0.9, 0.1)
    with pytest.raises(RuntimeError):
        splits.assert_no_leak(spark.createDataFrame([("a", "train"), ("a", "test")], "s string, split string"), "s")


def frame(spark, rows):
    return spark.createDataFrame([(i, int(y), float(p), f"c{i % 7}") for i, (y, p) in enumerate(rows)], "row_id bigint, y int, p double, cluster string")


def test_metrics(spark):
    rng = np.random.default_rng(4)
    y = rng.random(300) < 0.4
    p = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    d = frame(spark, zip(y, p, strict=True))
    pairs = np.sign(p[y][:, None] - p[~y][None, :])
    assert np.isclose(metrics.auc_roc(d).first()["auc"], ((pairs + 1) / 2).mean())
    order = np.argsort(-p, kind="stable")
    cut = np.flatnonzero(np.append(np.diff(p[order]) != 0, True))
    tp, n = np.cumsum(y[order])[cut], cut + 1
    assert np.isclose(metrics.auc_pr(d).first()[0], (np.diff(np.append(0, tp / y.sum())) * tp / n).sum())
    bins = np.array_split(np.lexsort((np.arange(300), p)), 15)
    gaps = [abs(p[b].mean() - y[b].mean()) for b in bins]
    got = metrics.calibration_error(d).first()
    assert np.isclose(got["ece"], sum(g * len(b) for g, b in zip(gaps, bins, strict=True)) / 300) and np.isclose(got["mce"], max(gaps))
    exact = frame(spark, [(i < 150, 0.3) for i in range(500)] + [(i < 400, 0.8) for i in range(500)])
    got = metrics.calibration_error(exact, 2).first()
    assert got["ece"] < 1e-9 and got["mce"] < 1e-9
    apart = frame(spark, [(0, 0.1)] * 50 + [(1, 0.9)] * 50)
    best = metrics.youden(apart).first()
    assert (metrics.auc_roc(apart).first()["auc"], best["threshold"], best["accuracy"]) == (1.0, 0.9, 1.0) and np.isclose(metrics.brier(apart).first()[0], 0.01)
    assert math.isnan(metrics.auc_roc(frame(spark, [(1, 0.5)] * 3)).first()["auc"]) and math.isnan(metrics.calibration_error(frame(spark, [(1, 0.5)] * 3)).first()["ece"])


def test_running_totals_in_ranges(spark):
    d = spark.range(500).select(F.col("id"), (F.col("id") * 37 % 101).cast("double").alias("k"), (F.col("id") % 5).alias("v"))
    got = {r["id"]: r["s"] for r in running_totals(d, "k", ["id"], {"s": "v"}, ranges=9).collect()}
    total = 0
    for r in sorted(d.collect(), key=lambda r: (r["k"], r["id"])):
        assert got[r["id"]] == total
        total += r["v"]


def test_resampling(spark):
    rng = np.random.default_rng(5)
    y = rng.random(200) < 0.5
    d = frame(spark, zip(y, rng.normal(y * 0.8, 1), strict=True))
    rows = d.toPandas()

    def auc(r):
        a, b = r[r.y == 1].p.to_numpy(), r[r.y == 0].p.to_numpy()
        return ((np.sign(a[:, None] - b[None, :]) + 1) / 2).mean()

    jack = {r[0]: r[1] for r in inference.jackknife_auc(d, "cluster").collect()}
    assert all(np.isclose(jack[c], auc(rows[rows.cluster != c])) for c in jack) and len(jack) == 7
    assert not any(x in inference.jackknife_auc(d, "cluster")._jdf.queryExecution().toString() for x in ("CartesianProduct", "BroadcastNestedLoopJoin"))
    boot = inference.bootstrap_auc(d, "cluster", 200)
    stats = sorted(r["stat"] for r in boot.collect())
    from statistics import NormalDist

    n, values = NormalDist(), np.array(list(jack.values()))
    c = values.mean() - values
    z0, a = n.inv_cdf(np.mean(np.array(stats) < auc(rows))), (c**3).sum() / (6 * (c**2).sum() ** 1.5)
    want = [np.percentile(stats, 100 * n.cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))) for z in (n.inv_cdf(0.025), n.inv_cdf(0.975))]
    got = inference.bca_intervals(boot, inference.jackknife_auc(d, "cluster"), metrics.auc_roc(d)).first()
    assert np.allclose([got["ci_low"], got["ci_high"]], want) and got["ci_low"] < auc(rows) < got["ci_high"]
    assert sorted(boot.collect()) == sorted(inference.bootstrap_auc(d.repartition(5), "cluster", 200).collect())
    with pytest.raises(Exception, match="two clusters"):
        inference.bootstrap_auc(d.filter("cluster = 'c1'"), "cluster", 10).collect()
    ece = inference.bootstrap_ece(d.withColumn("p", 1 / (1 + F.exp(-F.col("p")))), "cluster", 10, 40)
    assert ece.count() == 40 and ece.filter("stat <= 0 or stat > 1").count() == 0
    null = inference.permutation_auc(d, "row_id", 60)
    wanted = {}
    for b in range(60):
        order = sorted(rows.row_id, key=lambda i: (int(hashlib.md5(f"0|{b}|{i}".encode()).hexdigest()[:8], 16), i))
        wanted[b] = auc(rows.assign(y=rows.row_id.isin(order[: int(rows.y.sum())]).astype(int)))
    assert all(np.isclose(r["stat"], wanted[r["b"]]) for r in null.collect())
    assert inference.p_value(null, auc(rows)).first()[0] < 0.05
    same = inference.paired_permutation_auc(d.withColumn("q", F.col("p")), "row_id", "p", "q", 20)
    assert {r["stat"] for r in same.collect()} == {0.0} and inference.p_value(same, 0.0, "two-sided").first()[0] == 1.0
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "name string, p double")
    got = {r["name"]: round(r["p_adj"], 9) for r in inference.adjusted(tests, "p").collect()}
    assert got == {"a": 0.04, "b": round(0.04 * 4 / 3, 9), "c": round(0.04 * 4 / 3, 9), "d": 0.9}


def test_power(spark):
    asked = spark.createDataFrame([(0.55,), (0.51,), (0.5,), (1.0,), (0.5001,), (0.4,)], "auc double")
    assert [r["n"] for r in power.with_required(asked).collect()] == [816, 20_600, None, 4, None, None]
    grid = [x / 7 for x in range(-80, 81)]
    got = spark.createDataFrame([(x,) for x in grid], "x double").select(columns.normal_cdf(F.col("x")).alias("c"), columns.normal_quantile_of(columns.normal_cdf(F.col("x"))).alias("x")).collect()
    assert all(math.isclose(r["c"], math.erfc(-x / math.sqrt(2)) / 2, rel_tol=1e-9, abs_tol=1e-15) for r, x in zip(got, grid, strict=True))
    assert all(math.isclose(r["x"], x, abs_tol=1e-6) for r, x in zip(got, grid, strict=True) if abs(x) < 5)
    row = spark.range(1).select(power.auc_error(F.lit(0.7), F.lit(100.0), F.lit(100.0)).alias("se"), power.auc_error(F.lit(1.5), F.lit(9.0), F.lit(9.0)).alias("bad")).first()
    q1, q2 = 0.7 / 1.3, 2 * 0.49 / 1.7
    assert np.isclose(row["se"], math.sqrt((0.21 + 99 * (q1 - 0.49) + 99 * (q2 - 0.49)) / 1e4)) and row["bad"] is None


def test_slices_of_knobs(spark):
    rows = spark.createDataFrame([(1, "real", "a"), (2, "sim", "a"), (3, "sim", "b")], "segment_id bigint, source string, maneuver string")
    names = lambda c: sorted((r["slice"], r["segment_id"]) for r in slices.sliced(rows, spark.createDataFrame(c, "segment_id bigint, config_json string")).collect())
    plain = [("maneuver:a", 1), ("maneuver:a", 2), ("maneuver:b", 3)]
    assert names([(2, None)]) == plain
    both = [(2, '{"pos_noise_std": 0.1, "latency_steps": 0}'), (3, '{"pos_noise_std": 0.3, "latency_steps": 2}')]
    knobs = [("knob:latency_0", 1), ("knob:latency_0", 2), ("knob:latency_gt0", 1), ("knob:latency_gt0", 3), ("knob:noise_high", 1), ("knob:noise_high", 3), ("knob:noise_low", 1), ("knob:noise_low", 2)]
    assert names(both) == knobs + plain
    assert names([(2, '{"latency_steps": 0}')]) == [("knob:latency_0", 1), ("knob:latency_0", 2), ("knob:latency_gt0", 1), *plain]
    ranges, fixed = simulate.sweep_cell("high", 4, 0.2)
    assert fixed["accel"] == 0 and fixed["wheelbase"] == 2.7 and fixed["latency_steps"] == 4 and ranges["pos_noise_std"] == (1e-2, 0.5)
    assert {"noise_low_lat_0_bias_0", "noise_mid_lat_2_bias_0.2"} <= {r[0] for r in simulate.knob_grid(spark).collect()}


def test_gate_and_diff(spark):
    side = lambda rows: spark.createDataFrame(rows, "slice string, auc double, ci_low double, ci_high double, n bigint")
    base = side([(s, 0.9, 0.85, 0.95, n) for s, n in (("worse", 50), ("gone", 50), ("meets", 50), ("few", 6), ("near", 50))])
    now = side([("worse", 0.65, 0.5, 0.6, 50), ("meets", 0.7, 0.6, 0.9, 50), ("few", 0.1, 0.0, 0.2, 50), ("near", 0.86, 0.8, 0.84, 50)])
    again = slices.read_baseline(spark, slices.baseline_json(base))
    got = {r["slice"]: (r["status"], r["violates"]) for r in slices.regression_gate(again, now).collect()}
    assert got == {"worse": ("worse", True), "gone": ("missing", True), "meets": ("kept", False), "few": ("few", False), "near": ("kept", False)}
    assert slices.flattened({"a": {"b": 1, "c": [2, {"d": 3}]}}) == {"a.b": 1, "a.c.0": 2, "a.c.1.d": 3}
    pair = lambda rows: spark.createDataFrame(rows, "path string, value double")
    diff = slices.metric_diff(pair([("a", 1.0), ("b", float("nan")), ("c", 2.0), ("x.elapsed_s", 1.0)]), pair([("a", 1.0 + 1e-8), ("b", float("nan")), ("d", 2.0), ("x.elapsed_s", 9.0)]))
    assert {(r["path"], r["problem"]) for r in diff.collect()} == {("c", "missing"), ("d", "extra")}


def drives(spark, scenes, agents, duration):
    """A track for each agent: winding gently, at a speed of its own."""
    rows = []
    for s in range(scenes):
        for a in range(agents):
            v, x, y = 5.0 + s % 4 + a / 2, 0.0, float(a)
            for i in range(round(duration * 10) + 1):
                h = 0.1 * math.sin(i / 25 + s)
                rows.append((s * agents + a, f"scene_{s:03d}", f"agent_{a}", i / 10, x, y, h, v, 0.04 * math.cos(i / 25 + s)))
                x, y = x + v * math.cos(h) / 10, y + v * math.sin(h) / 10
    return spark.createDataFrame(rows, "segment_id bigint, scene_id string, agent_token string, t double, x double, y double, heading double, speed double, yaw_rate double")


def test_simulator(spark):
    path = np.column_stack([np.arange(0, 200.0), np.zeros(200)])
    got = simulate.rollouts([path], np.array([[0, 0, 0, 10.0]]), 100, {}, [1])[0]
    assert got.shape == (101, 6) and np.allclose(got[:, 1], got[:, 0] * 10, atol=1e-9) and np.allclose(got[:, 2], 0)
    bent = np.column_stack([np.arange(0, 60.0), np.arange(0, 60.0) * 0.5])
    late = simulate.rollouts([bent], np.array([[0, 0, 0, 5.0]]), 4, {"latency_steps": np.array([2])}, [1])[0]
    assert late[1, 5] == late[2, 5] == 0 and late[3, 5] > 0
    noisy = {"pos_noise_std": np.array([0.1, 0.1]), "steer_noise_std": np.array([0.02, 0.02])}
    two = simulate.rollouts([path, bent], np.array([[0, 0, 0, 10.0], [0, 0, 0, 5.0]]), 30, noisy, [7, 8])
    one = simulate.rollouts([bent], np.array([[0, 0, 0, 5.0]]), 30, {k: v[:1] for k, v in noisy.items()}, [8])
    assert np.array_equal(two[1], one[0])
    with pytest.raises(ValueError):
        simulate.rollouts([path], np.zeros((1, 4)), -1, {}, [1])
    states = spark.range(1).select(simulate.bicycle_states(F.lit(1.5), F.lit(10.0), F.lit(10.0), 1).alias("s")).first()["s"]
    assert np.isclose(states[1]["speed"], 10.3) and np.isclose(states[1]["heading"], 10 / 2.7 * math.tan(0.6) * 0.1)
    free, pinned = simulate.sampled_config(5), simulate.sampled_config(5, fixed={"steer_bias": 0.2})
    assert pinned["steer_bias"] == 0.2 and {k: v for k, v in free.items() if k != "steer_bias"} == {k: v for k, v in pinned.items() if k != "steer_bias"}
    assert simulate.knob_grid(spark).count() == 18
    rng = np.random.default_rng(1)
    x = np.linspace(0, 60, 61)
    fit = simulate.reference_path(x + rng.normal(0, 0.02, 61), np.sin(x / 10) + rng.normal(0, 0.02, 61))
    assert len(fit) == 420 and np.abs(np.interp(x[5:55], fit[:, 0], fit[:, 1]) - np.sin(x[5:55] / 10)).max() < 0.15
    d = np.diff(np.eye(61), 2, axis=0)  # the smoothing against its own equations
    y = np.sin(x / 10) + rng.normal(0, 0.05, 61)
    weights, vectors = simulate.second_differences(61)
    assert np.allclose(vectors @ ((vectors.T @ y) / (1 + 3.0 * weights)), np.linalg.solve(np.eye(61) + 3.0 * d.T @ d, y))
    tracks = drives(spark, 2, 2, 6.0)
    sim = simulate.matched_rollouts(tracks)
    assert sim.groupBy("segment_id").count().filter("count = 61").count() == 4 and sorted(sim.collect()) == sorted(simulate.matched_rollouts(tracks.repartition(7)).collect())
    driven = simulate.reference_rollouts(drives(spark, 2, 2, 12.0))
    assert {(r["window"], r["count"]) for r in driven.groupBy("scene_id", "agent_token", "window").count().collect()} == {(0, 61), (1, 61), (2, 61)}
    noisy = simulate.recorder_noise(tracks, ["segment_id"], "real")
    assert sorted(noisy.collect()) == sorted(simulate.recorder_noise(tracks.repartition(5), ["segment_id"], "real").collect()) and noisy.filter("speed < 0").count() == 0


def slow_steer(path, x, y, h, v, gain, least, wheelbase):
    """Leg by leg."""
    reach, best, near, goal = max(gain * v, least), math.inf, None, None
    for k in range(len(path) - 1):
        (ax, ay), (bx, by) = path[k] - (x, y), path[k + 1] - (x, y)
        dx, dy = bx - ax, by - ay
        if dx * dx + dy * dy <= 1e-12:
            continue
        t = min(1, max(0, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
        nx, ny = ax + t * dx, ay + t * dy
        if nx * nx + ny * ny < best:
            best, near, goal = nx * nx + ny * ny, k, (nx, ny)
    for k in range(near, len(path) - 1):
        (ax, ay), (bx, by) = path[k] - (x, y), path[k + 1] - (x, y)
        roots = [t for t in np.roots([(bx - ax) ** 2 + (by - ay) ** 2, 2 * (ax * (bx - ax) + ay * (by - ay)), ax * ax + ay * ay - reach * reach]) if np.isreal(t) and 0 <= t.real <= 1]
        if roots:
            t = min(roots).real
            goal = ax + t * (bx - ax), ay + t * (by - ay)
            break
    return math.atan2(2 * wheelbase * math.sin(math.atan2(goal[1], goal[0]) - h), reach)


def test_steering_against_legs_one_by_one():
    rng = np.random.default_rng(3)
    paths = [np.cumsum(rng.normal(0.5, 1, (n, 2)), 0) for n in rng.integers(2, 40, 300)]
    state = [rng.normal(0, 5, 300), rng.normal(0, 5, 300), rng.uniform(-3, 3, 300), rng.uniform(0, 8, 300)]
    knobs = [rng.uniform(0.5, 2, 300), rng.uniform(0.1, 1, 300), np.full(300, 2.7)]
    got = simulate.Paths(paths).steer(*state, *knobs)
    want = [slow_steer(p, *(a[i] for a in (*state, *knobs))) for i, p in enumerate(paths)]
    assert np.isclose(got, want, atol=1e-7).mean() > 0.99  # if a corner is nearest, rounding decides to which of its legs it belongs


def test_models_and_files(spark, tmp_path):
    assert {"gbt", "mlp", "external"} <= set(models.available())
    with pytest.raises(ValueError):
        models.create("none")
    with pytest.raises(ValueError):
        models.register("gbt")(lambda: None)
    head, tail = files.sections("-- a\nSELECT 1;\n;SELECT 2 -- x\n;\n-- MARK: b\nSELECT 3;", "-- MARK:")
    assert head == ["SELECT 1", "SELECT 2 -- x"] and tail == ["SELECT 3"]
    d = track(spark).withColumn("scene_id", F.lit("s")).withColumn("source", F.lit("real")).withColumn("agent_token", F.lit("a"))
    files.write(d, str(tmp_path / "seg"), schemas.SEGMENTS_DDL)
    assert files.read(spark, str(tmp_path / "seg"), schemas.SEGMENTS_DDL).count() == 61
    files.write_record(spark, {"b": 1, "a": [2]}, str(tmp_path / "m"))
    assert json.loads(json.dumps(files.read_record(spark, str(tmp_path / "m")))) == {"a": [2], "b": 1}


def test_evaluation(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        sim = i % 2
        rows.append((i, f"s{i % 20}", "sim" if sim else "real", ["cut_in", "merge", "rare"][0 if i < 200 else 1 if i < 397 else 2], "test" if i % 20 < 12 else "val", float(1 / (1 + math.exp(-rng.normal(1.2 * sim * (i < 200), 1))))))
    d = spark.createDataFrame(rows, "segment_id bigint, scene_id string, source string, maneuver string, split string, prob_sim double")
    configs = d.filter("source = 'sim'").select("segment_id", F.to_json(F.struct((F.col("segment_id") / 400).alias("pos_noise_std"), (F.col("segment_id") % 3).alias("latency_steps"))).alias("config_json"))
    baseline = spark.createDataFrame([("maneuver:cut_in", 0.99, 0.98, 1.0, 100), ("maneuver:gone", 0.8, 0.7, 0.9, 50), ("maneuver:merge", 0.5, 0.4, 0.6, 50)], "slice string, auc double, ci_low double, ci_high double, n bigint")
    run = evaluation.evaluate(d, configs, baseline, replicates=60, permutations=40)
    got = {r["slice"]: r for r in run.slices.collect()}
    assert set(got) == {"maneuver:cut_in", "maneuver:merge", "maneuver:rare", "knob:noise_low", "knob:noise_high", "knob:latency_0", "knob:latency_gt0"} - ({"maneuver:rare"} - set(got))
    assert all(r["skipped"] or r["ci_low"] <= r["auc"] <= r["ci_high"] and r["p_perm"] <= r["p_adj"] <= 1 for r in got.values())
    assert got["maneuver:cut_in"]["p_perm"] < 0.05 < got["maneuver:merge"]["p_perm"] and got["maneuver:cut_in"]["n"] == 120
    assert {r["slice"]: r["status"] for r in run.gate.collect()} == {"maneuver:cut_in": "worse", "maneuver:gone": "missing", "maneuver:merge": "kept"} and run.exit_state() == 1
    whole = run.overall.first()
    assert whole["n"] == 240 and whole["ci_low"] < whole["auc"] < whole["ci_high"] and 0 < whole["ece_ci_low"] <= whole["ece_ci_high"] and {r["method"] for r in run.calibration.collect()} == {"none", "platt", "isotonic"}
    sweep = evaluation.sweep_row(run, "noise_mid_lat_2_bias_0", "mid", 2, 0.0, "gbt")
    assert sweep.schema.simpleString() == schemas.fields(schemas.SWEEP_DDL).simpleString()
    table = {(r["scope"], r["slice_name"]): r for r in sweep.collect()}
    assert set(table) == {("overall", None)} | {("slice", s) for s in got if s.startswith("maneuver:") and not got[s]["skipped"]}
    first, after = table["overall", None], {r["method"]: r["ece"] for r in run.calibration.collect()}
    assert (first["split_used"], first["ece_after_platt"], first["ece_after_isotonic"]) == ("test", after["platt"], after["isotonic"]) and None not in (first["auc_pr"], first["p_perm"], first["ece_ci_low"])
    assert all(r["split_used"] == "test" and r["brier"] is None and r["auc"] == got[s]["auc"] and r["ci_low"] == got[s]["ci_low"] for (scope, s), r in table.items() if scope == "slice")
    bare = d.withColumn("maneuver", F.when(F.col("segment_id") % 3 > 0, F.col("maneuver")))  # without a label: in no slice, but a row like any other
    assert evaluation.evaluate(bare, replicates=10, permutations=10).overall.first()["auc"] == whole["auc"]


def test_dataset_from_start_to_end(spark):
    tracks = drives(spark, 6, 2, 9.0)
    built = dataset.build(simulate.reference_rollouts(tracks)).checked()
    n = 6 * 2 * 2
    labels = {r["segment_id"]: r for r in built.labels.collect()}
    assert set(labels) == set(range(2 * n)) and all((r["source"] == "sim") == (i >= n) == (r["config_json"] is not None) for i, r in labels.items())
    assert all(labels[i]["scene_id"] == labels[i + n]["scene_id"] and labels[i]["split"] == labels[i + n]["split"] for i in range(n))
    assert built.segments.columns == [f.name for f in schemas.fields(schemas.SEGMENTS_DDL)] and built.features.columns == [f.name for f in schemas.fields(schemas.FEATURES_DDL)]
    rows = built.aligned().collect()
    assert len(rows) == 2 * n and all(len(r["speed"]) == 61 and math.isfinite(r["yaw_psd_ratio"]) for r in rows)
    with pytest.raises(ValueError):
        dataset.Dataset(built.segments.limit(100), built.labels, built.features).checked()


def test_seeds_and_angles(spark):
    row = spark.range(1).select(columns.md5_seed(F.lit("k")).alias("s"), columns.yaw_of(F.lit(math.cos(0.3)), F.lit(0.0), F.lit(0.0), F.lit(math.sin(0.3))).alias("y")).first()
    assert row["s"] == int(hashlib.md5(b"k").hexdigest()[:16], 16) % 2**32 and np.isclose(row["y"], 0.6)


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70


SQL = sorted(set(__spark_entry__.oracle_sql()) - {k for k in __spark_entry__.oracle_sql() if k.startswith("op") or k == "pipeline"})


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):  # both sides round to 3 to 7 digits, so they are one number or neighbours
        return a == b or math.isnan(a) and math.isnan(b) or abs(a - b) <= 1e-9 * max(1.0, abs(a))
    return a == b


@pytest.mark.parametrize("name", SQL)
def test_queries_against_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings labels".split():
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got = __spark_entry__.queries()[name](spark, sf_dir)
    rel = con.execute(__spark_entry__.oracle_sql()[name])
    names = sorted(d[0] for d in rel.description)
    assert sorted(got.columns) == names
    place = {d[0]: i for i, d in enumerate(rel.description)}
    key = lambda r: tuple((x is None, str(x)) if not isinstance(x, float) else (False, "") for x in r) + tuple(x for x in r if isinstance(x, float))
    want = sorted(([r[place[n]] for n in names] for r in rel.fetchall()), key=key)
    rows = sorted(([r[n] for n in names] for r in got.collect()), key=key)
    assert len(rows) == len(want)
    assert all(same(x, y) for a, b in zip(rows, want, strict=True) for x, y in zip(a, b, strict=True))


def test_all_windows_of_a_long_series_are_segments(spark, tmp_path):
    rows = [(u * 1000 + i, u, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", "click", float(i * 37 % 500), json.dumps({"k": i * 13 % 100})) for u, n in ((1, 300), (2, 61), (3, 60)) for i in range(n)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts string, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    want = {(1, w) for w in range(8)} | {(2, 0)}
    for name in ("maneuver_label", "feat_speed", "feat_ttc", "segment_features", "pivot_tensor", "recorder_noise"):
        got = {(r["user_id"], r["window"]) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).select("user_id", "window").collect()}
        assert got == want, name
    assert __spark_entry__.queries()["recorder_noise"](spark, str(tmp_path)).count() == 61 * len(want)
