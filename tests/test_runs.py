"""Ranges, counted draws, trees, folds, many runs, replay, publication and samples against brute-force versions."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake import schemas
from strandlake.functions import running
from strandlake.operators import evaluation, inference, labeling, metrics, models, replay, sampling, trees
from strandlake.plans import catalogue
from strandlake.sources import files
from strandlake.sources.published import Published


def test_thresholds_of_a_record_must_be_complete():
    assert labeling.thresholds(labeling.THRESHOLDS, complete=True) == labeling.THRESHOLDS
    with pytest.raises(ValueError, match="lateral.max_heading_change"):
        labeling.thresholds({k: {n: v for n, v in r.items() if n != "max_heading_change"} for k, r in labeling.THRESHOLDS.items()}, complete=True)


def test_a_figure_at_its_threshold_is_at_it_however_it_was_summed(spark):
    turn = list(itertools.accumulate([0.0, *[0.1] * 10]))  # ends at 0.9999999999999999
    rows = [(0, i / 10, float(i), 0.0, turn[i], 5.0) for i in range(11)]
    d = spark.createDataFrame(rows, "segment_id bigint, t double, x double, y double, heading double, speed double")
    assert rows[-1][4] < 1.0 and labeling.maneuvers(d, ["segment_id"]).first()["maneuver"] == "unprotected_left"


# Ranges


def test_ranges_follow_the_rows(spark):
    rng = np.random.default_rng(1)
    keys = [*(0.5 + rng.random(9000) * 1e-6), *rng.random(900), *(rng.normal(size=98) * 1e6), float("inf"), float("-inf")]
    d = spark.createDataFrame([(i, float(k), i % 3, i % 7) for i, k in enumerate(keys)] + [(10**6, None, 0, 1), (10**6 + 1, float("nan"), 0, 1)], "id bigint, k double, g int, v long")
    rows = running.with_ranges(d, "k", 64).collect()
    in_order = sorted((r for r in rows if r["k"] is not None), key=lambda r: (math.isnan(r["k"]), r["k"]))
    assert [r[running.RANGE] for r in in_order] == sorted(r[running.RANGE] for r in in_order)
    sizes = {}
    for r in rows:
        sizes[r[running.RANGE]] = sizes.get(r[running.RANGE], 0) + 1
    assert max(sizes.values()) <= 3 * len(keys) / 64 and sizes[-1] == 1
    got = {r["id"]: r["s"] for r in running.running_totals(d, "k", ["id"], {"s": "v"}, ["g"], 64).collect()}
    total = {}
    for r in sorted(rows, key=lambda r: (r["k"] is not None, r["k"] is not None and math.isnan(r["k"]), r["k"] or 0.0, r["id"])):
        assert got[r["id"]] == total.get(r["g"], 0)
        total[r["g"]] = total.get(r["g"], 0) + r["v"]


def test_bins_when_one_score_has_most_rows(spark):
    rng = random.Random(2)
    rows = [(i, int(rng.random() < 0.3), 0.5 if rng.random() < 0.9 else round(rng.random(), 3), f"g{i % 2}") for i in range(2000)]
    d = spark.createDataFrame(rows, "row_id bigint, y int, p double, g string")
    for groups in ([], ["g"]):
        got = {r["row_id"]: r["bin"] for r in metrics.equal_mass_bins(d, 15, groups).collect()}
        for g in ("g0", "g1") if groups else (None,):
            own = sorted((p, i) for i, _, p, h in rows if g in (None, h))
            want = {i: b + 1 for b, part in enumerate(np.array_split(np.arange(len(own)), 15)) for i in (own[k][1] for k in part)}
            assert all(got[i] == b for i, b in want.items())
        bins = {(r["bin"], *[r[g] for g in groups]): r for r in metrics.reliability(d, 15, groups).collect()}
        of = {}
        for i, y, p, h in rows:
            of.setdefault((got[i], h) if groups else (got[i],), []).append((y, p))
        assert all(bins[k]["n"] == len(v) and np.isclose(bins[k]["frac_pos"], np.mean([y for y, _ in v])) and np.isclose(bins[k]["mean_p"], np.mean([p for _, p in v])) for k, v in of.items()) and len(of) == len(bins)


# Counted draws


def auc_of(y, p):
    y, p = np.array(y, bool), np.array(p)
    return ((np.sign(p[y][:, None] - p[~y][None, :]) + 1) / 2).mean()


def test_counted_draws_are_permutations(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.random() < 0.4), float(round(rng.random(), 1 if i % 2 else 6)), f"g{i % 2}") for i in range(400)]
    d = spark.createDataFrame(rows, "row_id bigint, y int, p double, g string")
    got = inference.counted_permutation_auc(d, 400, 5, ["g"]).toPandas()
    again = inference.counted_permutation_auc(d.repartition(7), 400, 5, ["g"]).toPandas()
    assert got.sort_values(["g", "b"]).stat.tolist() == again.sort_values(["g", "b"]).stat.tolist() and len(got) == 800
    for g in ("g0", "g1"):
        y, p = zip(*[(y, p) for _, y, p, h in rows if h == g], strict=True)
        brute = np.array([auc_of(rng.permutation(y), p) for _ in range(3000)])
        own = got[got.g == g].stat.to_numpy()
        error = brute.std() / math.sqrt(len(own))
        assert abs(own.mean() - 0.5) < 4 * error and 0.85 < own.std() / brute.std() < 1.15
        for level in (0.05, 0.5, 0.95):
            assert abs(np.mean(own <= np.quantile(brute, level)) - level) < 4 * math.sqrt(level * (1 - level) / len(own)) + 0.01
    tiny = spark.createDataFrame([(0, 1, 0.1), (1, 0, 0.1), (2, 0, 0.9)], "row_id bigint, y int, p double")
    found = inference.counted_permutation_auc(tiny, 300, 1).toPandas().stat
    assert set(found) == {0.25, 1.0} and 0.55 < np.mean(found == 0.25) < 0.78  # two of three places for the positive are low
    one = inference.counted_permutation_auc(tiny.filter("y = 0"), 5).toPandas().stat
    assert set(one) == {0.5}


# Trees


@pytest.fixture(scope="module")
def examples(spark):
    rng = np.random.default_rng(4)
    names = [f"f{i}" for i in range(8)]
    x = rng.random((600, 8))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.2, 600) > 0.8).astype(int)
    rows = [(i, f"s{i % 23}" if i % 4 else "big", ["train", "train", "val", "test"][i % 23 % 4] if i % 4 else "train", int(y[i]), *map(float, x[i])) for i in range(600)]
    return spark.createDataFrame(rows, "segment_id bigint, scene_id string, split string, y int, " + ", ".join(f"{n} double" for n in names)).cache(), names


@pytest.fixture(scope="module")
def boosted(examples):
    return models.fit_boosted(*examples, trees=24, depth=3, patience=6, rate=0.2)


def expected(tree, x, known, node=0):
    """The mean of the tree's values for x, when only the ``known`` features are."""
    if tree.feature[node] < 0:
        return tree.value[node]
    left, right = tree.left[node], tree.right[node]
    if tree.feature[node] in known:
        return expected(tree, x, known, left if x[tree.feature[node]] <= tree.threshold[node] else right)
    return sum(tree.cover[n] / tree.cover[node] * expected(tree, x, known, n) for n in (left, right))


def shapley(ensemble, x, n):
    worth = {s: sum(t.weight * expected(t, x, set(s)) for t in ensemble.trees) for k in range(n + 1) for s in itertools.combinations(range(n), k)}
    out = []
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        out.append(sum(math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (worth[tuple(sorted((*s, i)))] - worth[s]) for k in range(n) for s in itertools.combinations(rest, k)))
    return out, worth[()]


def test_attributions_are_shapley_values(spark, examples, boosted):
    df, names = examples
    got = trees.attributed(df, boosted.ensemble, ["segment_id"]).orderBy("segment_id").collect()
    assert len(got) == 600 and all(abs(r["base"] + sum(r[n] for n in names) - r["margin"]) < 1e-9 for r in got)
    raw = {r["segment_id"]: (r["rawPrediction"][1], r["probability"][1]) for r in boosted.model.transform(models._vectors(df, names)).select("segment_id", "rawPrediction", "probability").collect()}
    assert all(abs(raw[r["segment_id"]][0] - r["margin"]) < 1e-9 for r in got)
    scores = {r["segment_id"]: r["p"] for r in trees.scored(df, boosted.ensemble, ["segment_id"]).collect()}
    assert all(abs(scores[i] - p) < 1e-9 for i, (_, p) in raw.items())
    rows = {r["segment_id"]: [r[n] for n in names] for r in df.collect()}
    for r in got[::75]:
        parts, base = shapley(boosted.ensemble, rows[r["segment_id"]], len(names))
        assert np.allclose([r[n] for n in names], parts, atol=1e-9) and abs(base - r["base"]) < 1e-9
    top = models.importances(df, boosted, 3).collect()
    means = {n: np.mean([abs(r[n]) for r in trees.attributed(df, boosted.best, ["segment_id"]).collect()]) for n in names}
    assert [r["feature"] for r in top] == sorted(means, key=means.get, reverse=True)[:3] and "f0" in means and np.isclose(top[0]["importance"], max(means.values()))


def test_a_single_split_and_a_bare_leaf():
    a = lambda *v: np.array(v, np.float64)
    i = lambda *v: np.array(v, np.int64)
    split = trees.Tree(i(1, -1, -1), a(0.5, 0, 0), i(1, -1, -1), i(2, -1, -1), a(0, 1, 5), a(4, 3, 1), 2.0)
    leaf = trees.Tree(i(-1), a(0), i(-1), i(-1), a(7), a(4), 1.0)
    parts, base = trees.Ensemble([split, leaf], ["f0", "f1"]).attributions(np.array([[0.0, 0.5], [0.0, 0.6]]))
    assert base == 2 * (0.75 * 1 + 0.25 * 5) + 7 and np.allclose(parts, [[0, 2 * (1 - 2)], [0, 2 * (5 - 2)]])


def test_stages_are_prefixes_and_the_best_is_used(spark, examples, boosted):
    df, names = examples
    val = df.filter("split = 'val'")
    stages = {r["stage"]: r["auc"] for r in models.stage_aucs(val, boosted.ensemble).collect()}
    assert set(stages) == set(range(1, len(boosted.ensemble.trees) + 1))
    for n in (1, 2, 5, len(stages)):
        rows = boosted.ensemble.first(n)
        apart = metrics.auc_roc(trees.scored(val, rows, ["y"])).first()["auc"]
        assert abs(stages[n] - apart) < 1e-12
    best = max(stages.values())
    assert boosted.used == models.stopped(stages, 6) and boosted.used <= len(stages) and (len(stages) == 24 or stages[boosted.used] == best)
    assert models.stopped({1: 0.5, 2: 0.7, 3: 0.7, 4: 0.6, 5: 0.9}, 2) == 2 and models.stopped({1: 0.5, 2: 0.7, 3: 0.7, 4: 0.6, 5: 0.9}, 3) == 5
    fewer = models._fitted(df.filter("split = 'train'"), names, 5, boosted.parameters)[1]
    assert all(np.array_equal(x.feature, y.feature) and np.allclose(x.value, y.value) for x, y in zip(fewer.trees, boosted.ensemble.trees, strict=False))  # one seed: the first of more
    assert models.create("gbt")(df, names, trees=2, patience=1).columns == ["segment_id", "y", "split", "p"]
    with pytest.raises(ValueError, match="no parameter"):
        models.fit_boosted(df, names, tree=3)


def test_saved_models(spark, examples, boosted, tmp_path):
    df, names = examples
    models.save(boosted, str(tmp_path / "m"))
    again = models.load(spark, str(tmp_path / "m"), names)
    assert again.used == boosted.used and again.parameters == boosted.parameters
    assert sorted(again.score(df).collect()) == sorted(boosted.score(df).collect())
    for wrong in (names[::-1], names[:-1]):
        with pytest.raises(ValueError, match="in this order"):
            models.load(spark, str(tmp_path / "m"), wrong)


# Folds


def test_turns_deal_like_one_by_one():
    rng = random.Random(1)
    for _ in range(500):
        loads = [rng.choice([0, rng.randrange(50)]) for _ in range(rng.randrange(1, 7))]
        slow, n, groups = list(loads), rng.randrange(1, 9), rng.randrange(60)
        got = [turn[i % len(turn)] for first, last, turn in models.turns(loads, n, groups) for i in range(last - first + 1)]
        want = []
        for _ in range(groups):
            want.append(min(range(len(slow)), key=lambda f: (slow[f], f)))
            slow[want[-1]] += n
        assert got == want and loads == slow


def test_folds_keep_groups_together_and_balanced(spark, examples):
    df, names = examples
    got = models.fold_assignment(df, "scene_id", 4).collect()
    assert len(got) == len({r["scene_id"] for r in got}) == df.select("scene_id").distinct().count()
    sizes = {}
    for r in got:
        sizes[r["fold"]] = sizes.get(r["fold"], 0) + r["n"]
    assert sum(sizes.values()) == 600 and max(sizes.values()) - min(sizes.values()) <= max(r["n"] for r in got)
    scores = models.cross_fitted(df, names, "scene_id", 3, trees=3, depth=2).collect()
    fold_of = {r["scene_id"]: r["fold"] for r in models.fold_assignment(df, "scene_id", 3).collect()}
    scene = {r["segment_id"]: r["scene_id"] for r in df.collect()}
    assert len(scores) == 600 and all(r["fold"] == fold_of[scene[r["segment_id"]]] for r in scores)
    aucs = {r["fold"]: r["auc"] for r in models.fold_aucs(spark.createDataFrame(scores)).collect()}
    assert set(aucs) == {0, 1, 2} and all(a > 0.7 for a in aucs.values())


def test_replicates_multiply_counts_over_many_tasks(spark, monkeypatch):
    """Few clusters make few draws, which alone would be one task with all replicates' scores."""
    rng = random.Random(3)
    df = spark.createDataFrame([(rng.randrange(2), rng.randrange(50) / 50, f"c{i % 3}") for i in range(300)], "y int, p double, cluster string").cache()
    seen = {}
    for tasks in (1, 5):
        monkeypatch.setattr(inference, "TASKS", tasks)
        rows = inference._resampled(df, "cluster", 40, 0, ())
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert tasks == 1 or plan.count(", 5), REPARTITION_BY_NUM") >= 2
        seen[tasks] = sorted(map(tuple, rows.select("b", "p", "y", "w").collect()))
    assert seen[1] == seen[5] and len({r[0] for r in seen[5]}) == 40


def test_fits_deal_rows_by_their_number_and_not_by_how_they_lay(spark, examples, monkeypatch):
    monkeypatch.setattr(models, "TASK_ROWS", 100)
    df, names = examples
    assert models.dealt_by_rows(df.coalesce(1)).rdd.getNumPartitions() == 6
    few, many = (models.cross_fitted(d, names, "scene_id", 2, trees=2, depth=2) for d in (df.coalesce(1), df.repartition(7, "f0")))
    assert sorted(few.collect()) == sorted(many.collect())


def test_fold_scores_fit_no_further_trees(spark, examples, monkeypatch):
    df, names = examples
    fits, real = [], models.fit_boosted
    monkeypatch.setattr(models, "fit_boosted", lambda *args, **kept: fits.append(kept) or real(*args, **{**kept, "trees": 2}))
    monkeypatch.setattr(catalogue, "_examples", lambda *_: df)
    monkeypatch.setattr(catalogue.schemas, "FEATURES", names)
    assert {r["fold"] for r in catalogue.fold_scores(spark, "nowhere").collect()} == set(range(5))
    assert sorted(k["train"] for k in fits) == [f"fold != {k}" for k in range(5)]


def test_fold_scores_fit_all_trees_and_cut_their_lineage(spark, examples, monkeypatch):
    df, names = examples
    asked, real = [], models._fitted
    monkeypatch.setattr(models, "_fitted", lambda rows, features, n, c: asked.append(n) or real(rows, features, 2, c))
    monkeypatch.setattr(catalogue, "_shared_examples", lambda *_: df)
    monkeypatch.setattr(catalogue.schemas, "FEATURES", names)
    assert {r["fold"] for r in catalogue.fold_scores(spark, "nowhere").collect()} == set(range(5))
    assert asked == [models.DEFAULTS["trees"]] * 5 == [400] * 5
    assert spark.sparkContext.getCheckpointDir() is not None


# Many runs


def test_all_runs_at_once_equal_runs_one_by_one(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = []
    for config, model, push in (("c1", "gbt", 1.0), ("c1", "cnn", 0.2), ("c2", "gbt", 0.5)):
        for i in range(240):
            sim = i % 2
            split = "val" if config == "c2" or i % 12 > 8 else "test"  # c2 has no test rows
            rows.append((config, {"c1": "low", "c2": "mid"}[config], 2, 0.1, model, i, f"s{i % 12}", "sim" if sim else "real", ["cut_in", "merge"][i % 3 % 2], split, float(round(1 / (1 + math.exp(-rng.normal(push * sim, 1))), 3))))
    d = spark.createDataFrame(rows, "config_id string, knob_noise string, knob_latency bigint, knob_bias double, model string, segment_id bigint, scene_id string, source string, maneuver string, split string, prob_sim double")
    got = evaluation.sweep_rows(d, replicates=40, permutations=30)
    assert got.schema.simpleString() == schemas.fields(schemas.SWEEP_DDL).simpleString()
    table = {(r["config_id"], r["model"], r["slice_name"]): r.asDict() for r in got.collect()}
    assert len(table) == 3 * 3 and {r["split_used"] for r in table.values() if r["config_id"] == "c2"} == {"val"}
    for config, model in (("c1", "cnn"), ("c2", "gbt")):
        own = d.filter((F.col("config_id") == config) & (F.col("model") == model))
        run = evaluation.evaluate(own.drop("config_id", "model"), replicates=40, permutations=30)
        for r in evaluation.sweep_row(run, config, {"c1": "low", "c2": "mid"}[config], 2, 0.1, model).collect():
            many = table[config, model, r["slice_name"]]
            for k, v in r.asDict().items():
                if k == "p_perm" and v is not None:  # draws are seeded by the run's name, too
                    assert 0 < many[k] <= 1
                elif not k.startswith("ece_after"):
                    assert v == many[k] or abs(v - many[k]) < 1e-9, k
    path = str(tmp_path / "sweep")
    wanted = d.select("config_id", "model").distinct()
    assert files.cells_left(wanted, path).count() == 3
    files.write_cells(got.filter("config_id = 'c1'"), path)
    assert [tuple(r) for r in files.cells_left(wanted, path).collect()] == [("c2", "gbt")]
    files.write_cells(got.filter("config_id = 'c2'"), path)
    assert files.cells_left(wanted, path).count() == 0 and files.read_cells(spark, path).count() == 9
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "sweep").rglob("*.parquet")}
    files.write_cells(got.filter("config_id = 'c1' and model = 'cnn'").withColumn("auc", F.lit(0.25)), path)
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "sweep").rglob("*.parquet")}
    assert {f for f in before if after.get(f) == before[f]} == {f for f in before if "model=cnn" not in str(f)}
    assert files.read_cells(spark, path).filter("auc = 0.25").count() == 3 and files.read_cells(spark, path).schema.simpleString() == got.schema.simpleString()


# Replay


def test_digests_and_replay(spark):
    rows = [(i, f"t{i % 5}", None if i % 7 == 0 else i / 3, [i]) for i in range(200)]
    ddl = "k bigint, s string, v double, a array<bigint>"
    d = spark.createDataFrame(rows, ddl)
    digest = lambda df: tuple(replay.table_digest(df).first())
    assert digest(d) == digest(d.repartition(9).orderBy("v")) == digest(d.select("a", "v", "s", "k")) and digest(d)[0] == 200
    assert digest(d.union(d.limit(1))) != digest(d) and digest(d.withColumn("v", F.coalesce("v", F.lit(0.0)))) != digest(d) and digest(d.limit(0)) == (0, "0")
    other = d.filter("k != 3").withColumn("v", F.when(F.col("k") == 8, 1.5).otherwise(F.col("v"))).union(spark.createDataFrame([(500, "x", 1.0, [])], ddl))
    assert {(r["k"], r["status"]) for r in replay.changed_rows(d, other, ["k"]).collect()} == {(3, "gone"), (8, "changed"), (500, "new")}

    def step(data, seed, bias=0.0):
        picked = sampling.bottom_k(data, 3, "k", ["s"], seed)
        return {"picked": picked, "figures": picked.agg(F.avg("v").alias("mean"), (F.count("*") + F.lit(bias)).alias("n"))}

    record, out = replay.run_record(step, {"data": d}, {"seed": 4}, ["figures"])
    record = json.loads(json.dumps(record))
    assert out["picked"].count() == 15 and replay.replayed(record, step, {"data": d.repartition(5)}) == []
    broken = replay.replayed(record, lambda data, seed: step(data, seed + 1, 0.5), {"data": d})
    assert len(broken) == 3 and broken[0].startswith("picked") and any("figures.n: differs" in x for x in broken)
    with pytest.raises(ValueError, match="data"):
        replay.replayed(record, step, {"data": d.limit(199)})


# Publication


def test_publication_is_all_or_nothing(spark, tmp_path):
    def tables(n, split="train", short=0, ids=None):
        seg = spark.range(n).select(F.col("id").alias("segment_id"), F.explode(F.sequence(F.lit(1), F.lit(61))).alias("t")).filter(f"not (segment_id = 0 and t <= {short})")
        labels = spark.range(ids or n).select(F.col("id").alias("segment_id"), (F.col("id") % 2).cast("string").alias("scene_id"), F.when(F.col("id") == 2, split).otherwise("train").alias("split"))
        return {"segments": seg, "labels": labels, "features": spark.range(n).select(F.col("id").alias("segment_id"), F.rand(1).alias("f"))}

    root = Published(spark, str(tmp_path / "data"))
    assert root.current() is None
    with pytest.raises(ValueError):
        root.table("labels")
    first = root.publish(tables(4), by={"labels": "split"})
    assert root.current() == first and root.table("segments").count() == 4 * 61
    for bad, error in ((tables(5, split="test"), RuntimeError), (tables(5, short=1), ValueError), (tables(5, ids=6), ValueError)):
        with pytest.raises(error):
            root.publish(bad)
        assert root.current() == first and root.table("labels").count() == 4 and len(list((tmp_path / "data").glob("v-*"))) == 1
    reader = root.table("labels")
    second = root.publish(tables(6))
    assert root.current() == second and root.table("labels").count() == 6 and reader.count() == 4  # who reads the version before still can
    root.drop_others()
    assert root.views() == second and spark.sql("SELECT count(*) FROM features").first()[0] == 6 and len(list((tmp_path / "data").glob("v-*"))) == 1


# Samples


def test_samples_of_exactly_k(spark):
    d = spark.range(2000).select("id", F.when(F.col("id") % 10 < 9, "hot").when(F.col("id") < 15, "few").otherwise("rest").alias("g"))
    got = sampling.bottom_k(d, 7, "id", ["g"], 3)
    rows = sorted(map(tuple, got.collect()))
    assert {g: sum(r[1] == g for r in rows) for g in ("hot", "few", "rest")} == {"hot": 7, "few": 1, "rest": 7}
    assert rows == sorted(map(tuple, sampling.bottom_k(d.repartition(11), 7, "id", ["g"], 3).collect())) and set(rows) < set(map(tuple, sampling.bottom_k(d, 9, "id", ["g"], 3).collect()))
    assert rows != sorted(map(tuple, sampling.bottom_k(d, 7, "id", ["g"], 4).collect())) and sampling.bottom_k(d, 7, "id").count() == 7
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
