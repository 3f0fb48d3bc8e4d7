"""Registered queries: each operator on the driver's tables, with the equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import columns as C
from ..functions import series as S
from ..operators import calibration, evaluation, features, inference, labeling, metrics, models, power, replay, rollups, sampling, simulate, slices, splits, trees, windows
from ..session import saved, table
from ..sources import files, keyframes
from . import dataset
from .mappings import DRIVE_SQL, SCORED_SQL, SWEEP_SQL, TIED_SQL, TRACK_SQL, scored, sweep, tied, tracks

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def q(c: str, digits: int = 6) -> str:
    return f"floor(({c}) * 1e{digits} + 0.5) / 1e{digits}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[C.quantised(F.col(n), digits).alias(n) if t == "double" else F.col(n).cast("bigint").alias(n) if t == "int" else F.col(n) for n, t in df.dtypes])


# Roll-ups, joins, splits


@query(f"WITH {TRACK_SQL} SELECT source, event_type, count(*) AS n, {q('100.0 * count(*) / sum(count(*)) OVER ()')} AS pct FROM track GROUP BY source, event_type")
def class_balance_pct(spark, sf_dir):
    return rounded(rollups.class_balance(tracks(spark, sf_dir), ["source", "event_type"]))


BUCKET = "CAST((((('0x' || substr(md5({0}), 1, 16))::UBIGINT % 100) * 16 + ('0x' || substr(md5({0}), 17, 16))::UBIGINT % 100) % 100) AS BIGINT)"
SPLIT = f"CASE WHEN {BUCKET.format('scene_id')} < 70 THEN 'train' WHEN {BUCKET.format('scene_id')} < 85 THEN 'val' ELSE 'test' END"
WITH_SPLIT = f"{TRACK_SQL}, labelled AS (SELECT *, {SPLIT} AS split FROM track)"


def with_split(spark, sf_dir):
    return tracks(spark, sf_dir).withColumn("split", splits.split_of(F.col("scene_id")))


@query(f"WITH {TRACK_SQL} SELECT DISTINCT scene_id, {BUCKET.format('scene_id')} AS bucket, {SPLIT} AS split FROM track")
def md5_split(spark, sf_dir):
    scenes = tracks(spark, sf_dir).select("scene_id").distinct()
    return scenes.select("scene_id", C.md5_bucket(F.col("scene_id")).alias("bucket"), splits.split_of(F.col("scene_id")).alias("split"))


@query("SELECT DISTINCT user_id, CAST(('0x' || substr(md5('agent|' || user_id), 1, 16))::UBIGINT % 4294967296 AS BIGINT) AS seed FROM events")
def md5_seed(spark, sf_dir):
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", C.md5_seed(F.concat(F.lit("agent|"), F.col("user_id").cast("string"))).alias("seed"))


@query(f"WITH {WITH_SPLIT} SELECT split, count(*) AS n, {q('avg(speed)')} AS speed_mean, {q('stddev_samp(speed)')} AS speed_std, {q('avg(yaw_rate)')} AS yaw_mean FROM labelled GROUP BY split")
def split_summary(spark, sf_dir):
    return rounded(with_split(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.avg("speed").alias("speed_mean"), F.stddev_samp("speed").alias("speed_std"), F.avg("yaw_rate").alias("yaw_mean")))


@query(f"WITH {WITH_SPLIT} SELECT scene_id, min(split) AS split, count(*) AS n_segments FROM labelled GROUP BY scene_id")
def split_assignment(spark, sf_dir):
    return splits.split_assignment(with_split(spark, sf_dir), "scene_id")


@query("SELECT l_orderkey, o_orderstatus AS split, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def split_join_train(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    labels = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("split"))
    return facts.join(labels, "l_orderkey").select("l_orderkey", "split", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_quantity")


@query("SELECT l_orderkey, o_orderstatus AS split, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def split_join_all(spark, sf_dir):
    """The tables of all splits."""
    facts = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_quantity")
    labels = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("split"))
    return facts.join(labels, "l_orderkey").select("l_orderkey", "split", "l_linenumber", "l_quantity")


@query("SELECT o_orderstatus, c.* EXCLUDE (c_custkey, c_name, c_nationkey) FROM orders JOIN customer c ON o_custkey = c_custkey")
def star_except_features(spark, sf_dir):
    rest = table(spark, sf_dir, "customer").drop("c_name", "c_nationkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus").join(rest, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey")


@query("SELECT user_id, count(DISTINCT event_type) AS n_splits FROM events GROUP BY user_id HAVING n_splits > 1")
def leakage_having(spark, sf_dir):
    return splits.leaking_groups(table(spark, sf_dir, "events"), "user_id", "event_type")


@query(f"""WITH {TRACK_SQL}, s AS (SELECT scene_id, speed, CASE WHEN {BUCKET.format('scene_id')} < 70 THEN 2 WHEN {BUCKET.format('scene_id')} < 85 THEN 1 ELSE 0 END AS r FROM track)
SELECT scene_id, count(*) AS n FROM s WHERE r = (SELECT min(r) FROM s) GROUP BY scene_id""")
def evaluated_split(spark, sf_dir):
    return splits.evaluated_split(with_split(spark, sf_dir)).groupBy("scene_id").agg(F.count("*").alias("n"))


@query(f"""WITH {SWEEP_SQL}, o AS (SELECT * FROM sweep WHERE scope = 'overall')
SELECT 'knob_noise' AS knob, knob_noise AS level, {q('avg(auc)')} AS mean, count(auc) AS n FROM o GROUP BY 2
UNION ALL SELECT 'knob_latency', CAST(knob_latency AS VARCHAR), {q('avg(auc)')}, count(auc) FROM o GROUP BY 2
UNION ALL SELECT 'knob_bias', CAST(knob_bias AS VARCHAR), {q('avg(auc)')}, count(auc) FROM o GROUP BY 2""")
def knob_union_rollup(spark, sf_dir):
    return rounded(rollups.knob_rollup(sweep(spark, sf_dir).filter("scope = 'overall'"), ["knob_noise", "knob_latency", "knob_bias"]))


@query(f"WITH {SWEEP_SQL} SELECT model, knob_noise, knob_latency, knob_bias, {q('avg(auc)')} AS mean_auc, count(*) AS n FROM sweep WHERE scope = 'overall' GROUP BY 1, 2, 3, 4")
def knob_interaction(spark, sf_dir):
    return rounded(sweep(spark, sf_dir).filter("scope = 'overall'").groupBy("model", "knob_noise", "knob_latency", "knob_bias").agg(F.avg("auc").alias("mean_auc"), F.count("*").alias("n")))


@query(f"WITH {SWEEP_SQL} SELECT slice_name, {q('avg(auc)')} AS mean_auc, count(*) AS n FROM sweep WHERE scope = 'slice' GROUP BY slice_name")
def slice_rollup(spark, sf_dir):
    return rounded(sweep(spark, sf_dir).filter("scope = 'slice'").groupBy("slice_name").agg(F.avg("auc").alias("mean_auc"), F.count("*").alias("n")))


@query(f"WITH {TRACK_SQL} SELECT source, count(*) AS n, count(DISTINCT scene_id) AS n_scenes FROM track GROUP BY source")
def manifest_counts(spark, sf_dir):
    return tracks(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("scene_id").alias("n_scenes"))


@query(f"WITH {SWEEP_SQL} SELECT model, {q('avg(auc)')} AS mean_auc, {q('min(auc)')} AS low, {q('max(auc)')} AS high FROM sweep WHERE scope = 'overall' GROUP BY model")
def model_summary(spark, sf_dir):
    return rounded(sweep(spark, sf_dir).filter("scope = 'overall'").groupBy("model").agg(F.avg("auc").alias("mean_auc"), F.min("auc").alias("low"), F.max("auc").alias("high")))


@query(f"WITH {SWEEP_SQL} SELECT model, {q('avg(auc)')} AS auc FROM sweep WHERE scope = 'overall' AND knob_noise = '3-MEDIUM' AND knob_latency = 2 AND knob_bias = 0 GROUP BY model")
def mid_config(spark, sf_dir):
    rows = sweep(spark, sf_dir).filter("scope = 'overall' and knob_noise = '3-MEDIUM' and knob_latency = 2 and knob_bias = 0")
    return rounded(rows.groupBy("model").agg(F.avg("auc").alias("auc")))


@query(f"""WITH {SWEEP_SQL} SELECT slice_name, {q("avg(auc) FILTER (model = 'F')")} AS "F", {q("avg(auc) FILTER (model = 'O')")} AS "O", {q("avg(auc) FILTER (model = 'P')")} AS "P" FROM sweep WHERE scope = 'slice' GROUP BY slice_name""")
def pivot_model_slice(spark, sf_dir):
    return rounded(rollups.model_matrix(sweep(spark, sf_dir).filter("scope = 'slice'"), "slice_name", "model", ["F", "O", "P"]))


@query(f"""WITH {SWEEP_SQL}, o AS (SELECT * FROM sweep WHERE scope = 'overall'),
r AS (SELECT 'knob_noise' AS knob, 1 AS o, avg(auc) AS m FROM o GROUP BY knob_noise UNION ALL SELECT 'knob_latency', 2, avg(auc) FROM o GROUP BY knob_latency UNION ALL SELECT 'knob_bias', 3, avg(auc) FROM o GROUP BY knob_bias)
SELECT knob, {q('max(m) - min(m)')} AS spread FROM r GROUP BY knob, o ORDER BY max(m) - min(m) DESC, o LIMIT 1""")
def knob_spread_argmax(spark, sf_dir):
    knobs = ["knob_noise", "knob_latency", "knob_bias"]
    return rounded(rollups.knob_spread(rollups.knob_rollup(sweep(spark, sf_dir).filter("scope = 'overall'"), knobs), knobs))


@query(f"WITH {SWEEP_SQL}, m AS (SELECT slice_name, avg(auc) AS a FROM sweep WHERE scope = 'slice' GROUP BY slice_name) SELECT slice_name, {q('a')} AS mean_auc FROM m ORDER BY a DESC, slice_name LIMIT 1")
def hardest_slice(spark, sf_dir):
    means = sweep(spark, sf_dir).filter("scope = 'slice'").groupBy("slice_name").agg(F.avg("auc").alias("mean_auc"))
    return rounded(means.agg(F.max_by("slice_name", "mean_auc").alias("slice_name"), F.max("mean_auc").alias("mean_auc")))


@query(f"""WITH {SWEEP_SQL} SELECT 'overall' AS scope, model, CAST(NULL AS VARCHAR) AS slice_name, {q('avg(auc)')} AS auc, {q('stddev_pop(auc)')} AS spread FROM sweep WHERE scope = 'overall' GROUP BY model
UNION ALL SELECT 'slice', model, slice_name, {q('avg(auc)')}, NULL FROM sweep WHERE scope = 'slice' GROUP BY model, slice_name""")
def overall_and_slices(spark, sf_dir):
    rows = sweep(spark, sf_dir)
    overall = rows.filter("scope = 'overall'").groupBy("scope", "model").agg(F.avg("auc").alias("auc"), F.stddev_pop("auc").alias("spread"))
    parts = rows.filter("scope = 'slice'").groupBy("scope", "model", "slice_name").agg(F.avg("auc").alias("auc"))
    return rounded(rollups.stacked(overall, parts))


@query(f"""WITH {WITH_SPLIT}, s AS (SELECT avg(speed) AS m, stddev_pop(speed) AS d, avg(yaw_rate) AS m2, stddev_pop(yaw_rate) AS d2 FROM labelled WHERE split = 'train')
SELECT user_id, idx, {q('(speed - m) / (d + CAST(1e-5 AS DOUBLE))')} AS speed, {q('(yaw_rate - m2) / (d2 + CAST(1e-5 AS DOUBLE))')} AS yaw_rate FROM labelled, s""")
def channel_norm(spark, sf_dir):
    rows = with_split(spark, sf_dir).select("user_id", "idx", "speed", "yaw_rate", "split")
    return rounded(rollups.normalised(rows, ["speed", "yaw_rate"])).select("user_id", "idx", "speed", "yaw_rate")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS noise, json_extract_string(props, '$.k')::BIGINT % 5 AS latency FROM events")
def json_knobs(spark, sf_dir):
    cfg = F.from_json("props", "k bigint")
    return table(spark, sf_dir, "events").select("event_id", cfg["k"].alias("noise"), (cfg["k"] % 5).alias("latency"))


# Windows and series


def _window_sql(size: int, step: int) -> str:
    return f"""WITH {TRACK_SQL}, n AS (SELECT user_id, count(*) AS n FROM track GROUP BY user_id HAVING count(*) >= {size}),
    w AS (SELECT user_id, unnest(generate_series(0, (n - {size}) // {step})) AS win FROM n)
    SELECT w.user_id, w.win AS "window", count(*) AS n, {q('min(t)')} AS t0, {q('avg(speed)')} AS speed_mean
    FROM w JOIN track t ON t.user_id = w.user_id AND t.idx BETWEEN w.win * {step} AND w.win * {step} + {size - 1} GROUP BY 1, 2"""


def _windows(spark, sf_dir, size, step):
    cut = windows.cut_windows(tracks(spark, sf_dir).drop("idx"), ["user_id"], ["ts", "event_id"], size, step)
    return rounded(cut.groupBy("user_id", "window").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.avg("speed").alias("speed_mean")))


@query(_window_sql(61, 30))
def window_cut_61_30(spark, sf_dir):
    return _windows(spark, sf_dir, 61, 30)


@query(_window_sql(21, 10))
def window_cut_21_10(spark, sf_dir):
    return _windows(spark, sf_dir, 21, 10)


@query("SELECT count(*) FILTER (n < 61) AS short, count(*) FILTER (n >= 61) AS whole FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def short_track_counts(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id").count()
    return n.agg(F.count(F.when(F.col("count") < 61, 1)).alias("short"), F.count(F.when(F.col("count") >= 61, 1)).alias("whole"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) != 61")
def incomplete_segments(spark, sf_dir):
    return windows.incomplete(table(spark, sf_dir, "events"), ["user_id"], 61)


@query("""WITH e AS (SELECT user_id, epoch(ts) AS s, event_id, ts FROM events),
f AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) > 43200 THEN 1 ELSE 0 END AS b FROM e),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY s) AS run FROM f)
SELECT user_id, run::BIGINT AS run, count(*) AS n FROM r GROUP BY 1, 2 HAVING count(*) >= 2""")
def gap_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    return S.with_runs(e, ["user_id"], "s", 43200.0).groupBy("user_id", "run").agg(F.count("*").alias("n")).filter("n >= 2")


@query(f"""WITH {TRACK_SQL}, e AS (SELECT user_id, CAST(epoch(ts) AS DOUBLE) / 3600 AS h, speed FROM track),
p AS (SELECT user_id, h AS a, lead(h) OVER w AS b, speed AS va, lead(speed) OVER w AS vb, min(h) OVER (PARTITION BY user_id) AS h0, max(h) OVER (PARTITION BY user_id) AS h1 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY h)),
g AS (SELECT user_id, unnest(generate_series(0, CAST(floor((max(h) - min(h)) / 6 + 1e-9) AS BIGINT))) AS k, min(h) AS h0 FROM e GROUP BY user_id),
j AS (SELECT g.user_id, g.k, g.h0 + g.k * 6 AS h, p.a, p.b, p.va, p.vb FROM g ASOF JOIN p ON g.user_id = p.user_id AND g.h0 + g.k * 6 + 6e-9 >= p.a)
SELECT user_id, k, {q('h', 4)} AS h, {q('CASE WHEN b IS NULL OR b = a THEN va ELSE va + (h - a) / (b - a) * (vb - va) END', 4)} AS speed FROM j""")
def resample_linear(spark, sf_dir):
    e = tracks(spark, sf_dir).select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600).alias("h"), "speed")
    return rounded(S.resampled(e, ["user_id"], "h", ["speed"], 6.0), 4)


W_SQL = "(PARTITION BY user_id ORDER BY idx)"


def grad_sql(c: str) -> str:
    return f"coalesce((lead({c}) OVER {W_SQL} - lag({c}) OVER {W_SQL}) / CAST(0.2 AS DOUBLE), (lead({c}) OVER {W_SQL} - {c}) / CAST(0.1 AS DOUBLE), ({c} - lag({c}) OVER {W_SQL}) / CAST(0.1 AS DOUBLE))"


def _by_user(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    return rounded(df.select("user_id", "idx", F.col(column)), digits)


@query(f"WITH {TRACK_SQL} SELECT user_id, idx, {q(grad_sql('speed'))} AS accel FROM track")
def gradient(spark, sf_dir):
    w = S.ordered(["user_id"], "idx")
    return _by_user(tracks(spark, sf_dir).withColumn("accel", S.gradient(F.col("speed"), 0.1, w)), "accel")


@query(f"WITH {TRACK_SQL}, a AS (SELECT *, {grad_sql('speed')} AS accel FROM track) SELECT user_id, idx, {q(grad_sql('accel'), 4)} AS jerk FROM a")
def double_gradient(spark, sf_dir):
    w = S.ordered(["user_id"], "idx")
    rows = tracks(spark, sf_dir).withColumn("a", S.gradient(F.col("speed"), 0.1, w))
    return _by_user(rows.withColumn("jerk", S.gradient(F.col("a"), 0.1, w)), "jerk", 4)


@query(f"""WITH {TRACK_SQL}, d AS (SELECT user_id, idx, yaw_rate AS c, idx + speed / 100 AS s FROM track),
e AS (SELECT *, s - lag(s) OVER {W_SQL} AS a, lead(s) OVER {W_SQL} - s AS b, c - lag(c) OVER {W_SQL} AS down, lead(c) OVER {W_SQL} - c AS up FROM d)
SELECT user_id, idx, {q('coalesce((a * a * up + b * b * down) / (a * b * (a + b)), up / b, down / a)', 5)} AS slope FROM e""")
def uneven_gradient(spark, sf_dir):
    w = S.ordered(["user_id"], "idx")
    rows = tracks(spark, sf_dir).withColumn("s", F.col("idx") + F.col("speed") / 100)
    return _by_user(rows.withColumn("slope", S.uneven_gradient(F.col("yaw_rate"), F.col("s"), w)), "slope", 5)


def _mean_sql(taps: int) -> str:
    parts = " + ".join(f"coalesce(lag(speed, {k}) OVER {W_SQL}, f) + coalesce(lead(speed, {k}) OVER {W_SQL}, l)" for k in range(1, taps // 2 + 1))
    return f"WITH {TRACK_SQL}, e AS (SELECT *, first_value(speed) OVER {W_SQL} AS f, last_value(speed) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM track) SELECT user_id, idx, {q(f'(speed + {parts}) / {taps}')} AS smooth FROM e"


@query(_mean_sql(3))
def moving_avg_nearest3(spark, sf_dir):
    return _by_user(tracks(spark, sf_dir).withColumn("smooth", S.moving_average(F.col("speed"), 3, S.ordered(["user_id"], "idx"))), "smooth")


@query(_mean_sql(5))
def moving_avg_nearest5(spark, sf_dir):
    return _by_user(tracks(spark, sf_dir).withColumn("smooth", S.moving_average(F.col("speed"), 5, S.ordered(["user_id"], "idx"))), "smooth")


UNWRAP_SQL = f"""{TRACK_SQL}, wr AS (SELECT *, atan2(sin(k / 5.0), cos(k / 5.0)) AS ang FROM track), dj AS (SELECT *, ang - lag(ang) OVER {W_SQL} AS dd FROM wr),
fx AS (SELECT *, CASE WHEN dd IS NULL OR abs(dd) < pi() THEN 0 ELSE (dd + pi()) - floor((dd + pi()) / (2 * pi())) * 2 * pi() - pi() - dd END AS fix FROM dj)"""


@query(f"WITH {UNWRAP_SQL} SELECT user_id, idx, {q(f'ang + sum(fix) OVER {W_SQL}', 5)} AS phase FROM fx")
def unwrap(spark, sf_dir):
    k = F.col("k") / 5.0
    rows = tracks(spark, sf_dir).withColumn("ang", F.atan2(F.sin(k), F.cos(k)))
    return _by_user(S.with_unwrapped(rows, "ang", "phase", S.ordered(["user_id"], "idx")), "phase", 5)


@query(f"WITH {TRACK_SQL}, d AS (SELECT user_id, idx, coalesce(sqrt((x - lag(x) OVER {W_SQL}) ** 2 + (y - lag(y) OVER {W_SQL}) ** 2), 0) AS st FROM track) SELECT user_id, idx, {q(f'sum(st) OVER {W_SQL}', 5)} AS arc FROM d")
def arc_length(spark, sf_dir):
    w = S.ordered(["user_id"], "idx")
    rows = tracks(spark, sf_dir).withColumn("st", S.arc_step(F.col("x"), F.col("y"), w))
    return _by_user(rows.withColumn("arc", S.running_sum(F.col("st"), w)), "arc", 5)


@query(f"WITH {TRACK_SQL}, d AS (SELECT user_id, idx, x, y, sqrt((x - lag(x) OVER {W_SQL}) ** 2 + (y - lag(y) OVER {W_SQL}) ** 2) AS st FROM track) SELECT user_id, count(*) AS n FROM d WHERE st IS NULL OR st > 1e-6 GROUP BY user_id")
def path_points(spark, sf_dir):
    w = S.ordered(["user_id"], "idx")
    rows = tracks(spark, sf_dir).withColumn("st", S.arc_step(F.col("x"), F.col("y"), w))
    return rows.filter("st > 1e-6 or idx = 0").groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"WITH {TRACK_SQL} SELECT user_id, {q('max_by(heading, idx) - min_by(heading, idx)')} AS turn, {q('min_by(x, idx)')} AS x0 FROM track GROUP BY user_id")
def first_last_delta(spark, sf_dir):
    return rounded(tracks(spark, sf_dir).groupBy("user_id").agg((F.max_by("heading", "idx") - F.min_by("heading", "idx")).alias("turn"), F.min_by("x", "idx").alias("x0")))


@query(f"WITH {TRACK_SQL} SELECT user_id, CAST(min(idx) AS BIGINT) AS peak_idx, {q('any_value(a)')} AS peak FROM (SELECT user_id, idx, abs(yaw_rate) AS a, max(abs(yaw_rate)) OVER (PARTITION BY user_id) AS m FROM track) WHERE a = m GROUP BY user_id")
def argmax_peak(spark, sf_dir):
    peak = F.max(F.struct(F.abs("yaw_rate").alias("a"), (-F.col("idx")).alias("i")))
    return rounded(tracks(spark, sf_dir).groupBy("user_id").agg(peak.alias("m")).select("user_id", (-F.col("m.i")).alias("peak_idx"), F.col("m.a").alias("peak")))


@query(f"WITH {TRACK_SQL}, o AS (SELECT user_id, min_by(x, idx) AS ox, min_by(y, idx) AS oy FROM track GROUP BY user_id) SELECT user_id, idx, {q('x - ox')} AS x, {q('y - oy')} AS y FROM track JOIN o USING (user_id)")
def scene_origin(spark, sf_dir):
    whole = Window.partitionBy("user_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = tracks(spark, sf_dir)
    return rounded(rows.select("user_id", "idx", (F.col("x") - F.first("x").over(whole)).alias("x"), (F.col("y") - F.first("y").over(whole)).alias("y")))


@query(f"""WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings),
n AS (SELECT vec_id, a / s AS w, b / s AS x, c / s AS y, d / s AS z FROM (SELECT *, sqrt(a * a + b * b + c * c + d * d) AS s FROM v) WHERE s > 0)
SELECT vec_id, {q('atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))')} AS yaw FROM n""")
def quat_yaw(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    part = [F.get("embedding", F.lit(i)).cast("double") for i in range(4)]
    e = e.select("vec_id", *[p.alias(n) for p, n in zip(part, "wxyz", strict=True)]).withColumn("s", F.sqrt(sum(F.col(n) * F.col(n) for n in "wxyz"))).filter("s > 0")
    return rounded(e.select("vec_id", C.yaw_of(*[F.col(n) / F.col("s") for n in "wxyz"]).alias("yaw")))


# Labels and features of segments (windows of 61 rows every 30, by user and window)

SEGMENT = ["user_id", "window"]


def segments(spark, sf_dir, size=61, step=30, driven=False):
    """user_id, window, t and channels of every whole window."""
    cut = windows.cut_windows(tracks(spark, sf_dir, driven).drop("idx"), ["user_id"], ["ts", "event_id"], size, step)
    return cut.select(*SEGMENT, "idx", "t", "x", "y", "heading", "speed", "yaw_rate")


def segments_sql(size: int, step: int) -> str:
    """All whole windows; a segment's key stands in user_id."""
    return f"""{TRACK_SQL}, w AS (SELECT user_id, unnest(generate_series(0, (n - {size}) // {step})) AS win FROM (SELECT user_id, count(*) AS n FROM track GROUP BY user_id HAVING count(*) >= {size})),
seg AS (SELECT track.* REPLACE (struct_pack(u := track.user_id, w := w.win) AS user_id) FROM track JOIN w ON w.user_id = track.user_id AND track.idx BETWEEN w.win * {step} AND w.win * {step} + {size - 1})"""


SEG_SQL = segments_sql(61, 30)
SEG_UNWRAP = f"""{SEG_SQL}, dj AS (SELECT *, heading - lag(heading) OVER {W_SQL} AS dd FROM seg),
un AS (SELECT *, heading + sum(CASE WHEN dd IS NULL OR abs(dd) < pi() THEN 0 ELSE (dd + pi()) - floor((dd + pi()) / (2 * pi())) * 2 * pi() - pi() - dd END) OVER {W_SQL} AS h FROM dj)"""
KIN_SQL = f"""{SEG_UNWRAP}, k1 AS (SELECT *, {grad_sql('speed')} AS accel, {grad_sql('h')} AS hr, speed * yaw_rate AS lat, CASE WHEN speed > 0.5 THEN abs(yaw_rate / speed) ELSE 0 END AS curv,
coalesce(sqrt((x - lag(x) OVER {W_SQL}) ** 2 + (y - lag(y) OVER {W_SQL}) ** 2), 0) AS st FROM un),
k2 AS (SELECT *, {grad_sql('accel')} AS jerk, sum(st) OVER {W_SQL} AS arc FROM k1), kin AS (SELECT *, max(arc) OVER (PARTITION BY user_id) AS whole_arc FROM k2)"""


def _keyed(sql: str) -> str:
    return f'SELECT user_id.u AS user_id, user_id.w AS "window", * EXCLUDE (user_id) FROM ({sql})'


MANEUVER_SQL = f"""WITH {SEG_UNWRAP}, f AS (SELECT *, first_value(heading) OVER {W_SQL} AS h0, first_value(x) OVER {W_SQL} AS x0, first_value(y) OVER {W_SQL} AS y0 FROM un),
l AS (SELECT *, {q('abs(-sin(h0) * (x - x0) + cos(h0) * (y - y0))')} AS lat FROM f),
a AS (SELECT user_id, {q('min(speed)')} AS slow, {q('max(speed)')} AS fast, {q('avg(speed)')} AS mean, {q('max_by(h, t) - min_by(h, t)')} AS turn, min(t) AS t0, max(t) AS t1, max(lat) AS pk FROM l GROUP BY user_id),
p AS (SELECT a.*, {q('((SELECT min(t) FROM l WHERE l.user_id = a.user_id AND l.lat = a.pk) - t0) / (t1 - t0)')} AS part FROM a)
SELECT user_id, CASE WHEN slow <= 0.5 AND {q('fast - slow')} >= 5 THEN 'stop_and_go' WHEN turn >= 1 AND mean >= 1 THEN 'unprotected_left'
WHEN pk >= 1.6 AND abs(turn) <= 0.6 AND part > 0.25 AND part < 0.75 THEN 'cut_in' WHEN pk >= 1.6 AND abs(turn) <= 0.6 THEN 'merge' ELSE 'lane_keep' END AS maneuver FROM p"""


@query(_keyed(MANEUVER_SQL.replace(TRACK_SQL, DRIVE_SQL)))
def maneuver_label(spark, sf_dir):
    return labeling.maneuvers(segments(spark, sf_dir, driven=True), SEGMENT)


@query(_keyed(MANEUVER_SQL.replace(SEG_SQL, segments_sql(21, 10)).replace(TRACK_SQL, DRIVE_SQL)))
def maneuver_label_windows(spark, sf_dir):
    """Of shorter windows: 21 rows, every 10."""
    return labeling.maneuvers(segments(spark, sf_dir, 21, 10, driven=True), SEGMENT)


@query(_keyed(MANEUVER_SQL.replace(SEG_SQL, segments_sql(21, 10))))
def maneuver_label_abrupt(spark, sf_dir):
    """Of the tracks as all other queries have them, whose speeds jump."""
    return labeling.maneuvers(segments(spark, sf_dir, 21, 10), SEGMENT)


@query(f"""WITH {SEG_SQL.replace(TRACK_SQL, DRIVE_SQL)}, lab AS (SELECT user_id, maneuver FROM ({MANEUVER_SQL.replace(TRACK_SQL, DRIVE_SQL)})), j AS (SELECT seg.*, maneuver, {SPLIT.replace('scene_id', "concat('user_', seg.user_id.u)")} AS split FROM seg JOIN lab USING (user_id))
SELECT split, maneuver, count(DISTINCT user_id) AS n_segments, count(*) AS n, {q('avg(speed)')} AS speed_mean, {q('stddev_samp(speed)')} AS speed_std FROM j GROUP BY split, maneuver""")
def split_summary_joined(spark, sf_dir):
    """Rows of segments joined with their labels, by split and maneuver."""
    rows = segments(spark, sf_dir, driven=True)
    labels = labeling.maneuvers(rows, SEGMENT).withColumn("split", splits.split_of(F.concat(F.lit("user_"), F.col("user_id").cast("string"))))
    got = rows.join(labels, SEGMENT).groupBy("split", "maneuver")
    return rounded(got.agg(F.countDistinct("user_id", "window").alias("n_segments"), F.count("*").alias("n"), F.avg("speed").alias("speed_mean"), F.stddev_samp("speed").alias("speed_std")))


def _feature_query(names: str, sql: dict[str, str], digits: int = 5) -> None:
    """Over segments of 61 rows every 30; with ``_windows`` after its name, of 21 rows every 10."""
    columns = names.split()

    def run(spark, sf_dir):
        return rounded(features.motion_features(segments(spark, sf_dir), SEGMENT).select(*SEGMENT, *columns), digits)

    def run_windows(spark, sf_dir):
        return rounded(features.motion_features(segments(spark, sf_dir, 21, 10), SEGMENT).select(*SEGMENT, *columns), digits)

    run.__name__ = sql.pop("name")
    run_windows.__name__ = run.__name__ + "_windows"
    text = f"WITH {KIN_SQL} SELECT user_id, " + ", ".join(f"{q(sql[c], digits)} AS {c}" for c in columns) + " FROM kin GROUP BY user_id"
    query(_keyed(text))(run)
    query(_keyed(text.replace(SEG_SQL, segments_sql(21, 10))))(run_windows)


_feature_query("speed_mean speed_std speed_max speed_min", {"name": "feat_speed", "speed_mean": "avg(speed)", "speed_std": "stddev_pop(speed)", "speed_max": "max(speed)", "speed_min": "min(speed)"})
_feature_query("accel_mean accel_std accel_max", {"name": "feat_accel", "accel_mean": "avg(abs(accel))", "accel_std": "stddev_pop(accel)", "accel_max": "max(abs(accel))"})
_feature_query("jerk_mean jerk_std jerk_max jerk_p95", {"name": "feat_jerk", "jerk_mean": "avg(abs(jerk))", "jerk_std": "stddev_pop(jerk)", "jerk_max": "max(abs(jerk))", "jerk_p95": "quantile_cont(abs(jerk), 0.95)"}, 3)
_feature_query("lat_accel_mean lat_accel_std lat_accel_max lat_accel_p95 lat_accel_rms", {"name": "feat_lat_accel", "lat_accel_mean": "avg(abs(lat))", "lat_accel_std": "stddev_pop(lat)", "lat_accel_max": "max(abs(lat))", "lat_accel_p95": "quantile_cont(abs(lat), 0.95)", "lat_accel_rms": "sqrt(avg(lat * lat))"})
_feature_query("curvature_mean curvature_p95 curv_speed_corr", {"name": "feat_curvature", "curvature_mean": "avg(curv)", "curvature_p95": "quantile_cont(curv, 0.95)", "curv_speed_corr": "CASE WHEN stddev_pop(curv) <= 1e-12 OR stddev_pop(speed) <= 1e-12 THEN 0 ELSE corr(curv, speed) END"})
_feature_query("heading_rate_mean heading_rate_std heading_rate_max heading_smoothness", {"name": "feat_heading", "heading_rate_mean": "avg(abs(hr))", "heading_rate_std": "stddev_pop(hr)", "heading_rate_max": "max(abs(hr))", "heading_smoothness": "1 / (1 + stddev_pop(hr))"})
_feature_query("ttc_stop_mean ttc_stop_min ttc_path_end_min", {"name": "feat_ttc", "ttc_stop_mean": "avg(speed) / 6", "ttc_stop_min": "min(speed) / 6", "ttc_path_end_min": "min(least(10, greatest(0, (whole_arc - arc) / greatest(speed, 0.1))))"})

FREQ = "CAST(10 AS DOUBLE) / 64"


@query(f"""WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(generate_series(0, 63)) AS j FROM embeddings),
d AS (SELECT vec_id, j, (x - avg(x) OVER (PARTITION BY vec_id)) * (0.5 - 0.5 * cos(2 * pi() * j / 64)) AS v FROM s),
f AS (SELECT vec_id, k, (pow(sum(v * cos(2 * pi() * k * j / 64)), 2) + pow(sum(v * sin(2 * pi() * k * j / 64)), 2)) / (10 * 24.0) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END AS p
      FROM d, (SELECT unnest(generate_series(0, 32)) AS k) GROUP BY vec_id, k),
t AS (SELECT vec_id, k, (p + lead(p) OVER (PARTITION BY vec_id ORDER BY k)) / 2 * {FREQ} AS a FROM f),
b AS (SELECT vec_id, sum(a) FILTER (k < 12) AS lo, sum(a) FILTER (k >= 13) AS hi, sum(a) AS al FROM t GROUP BY vec_id)
SELECT vec_id, {q('lo', 7)} AS yaw_psd_0_2hz, {q('hi', 7)} AS yaw_psd_2_5hz, {q('al', 7)} AS yaw_psd_total, {q('CASE WHEN hi > 1e-12 THEN least(100, lo / hi) WHEN lo > 1e-12 THEN 100 ELSE 0 END', 5)} AS yaw_psd_ratio FROM b""")
def feat_psd(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("signal"))
    got = features.spectral_features(e, ["vec_id"], "signal")
    return got.select("vec_id", *[C.quantised(F.col(c), 5 if c.endswith("ratio") else 7).alias(c) for c in got.columns[1:]])


@query()
def segment_features(spark, sf_dir):
    """All thirty; the groups of them are compared one by one above."""
    return rounded(features.extract_features(segments(spark, sf_dir), SEGMENT))


@query()
def pivot_tensor(spark, sf_dir):
    return windows.nested(segments(spark, sf_dir), SEGMENT, "t", ["x", "y", "heading", "speed", "yaw_rate"])


# Metrics

AUC_RANKS = "rank() OVER ({0} ORDER BY p) + (count(*) OVER (PARTITION BY {1} p) - 1) / 2.0"
AUC_OF = "(sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))"


@query(f"WITH {TIED_SQL}, r AS (SELECT y, {AUC_RANKS.format('', '')} AS r FROM tied) SELECT count(*) AS n, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, {q(AUC_OF)} AS auc FROM r")
def auc_roc(spark, sf_dir):
    return rounded(metrics.auc_roc(tied(spark, sf_dir)))


CURVE_SQL = """g AS (SELECT p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM {0} GROUP BY p), c AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM g)"""


@query(f"WITH {SCORED_SQL}, {CURVE_SQL.format('scored')} SELECT {q('sum(pos / np * (tp / (tp + fp)))')} AS auc_pr FROM c")
def auc_pr(spark, sf_dir):
    return rounded(metrics.auc_pr(scored(spark, sf_dir)))


@query(f"WITH {SCORED_SQL}, {CURVE_SQL.format('scored')} SELECT {q('p')} AS threshold, {q('fp / nn')} AS fpr, {q('tp / np')} AS tpr FROM c")
def roc_points(spark, sf_dir):
    return rounded(metrics.roc_points(scored(spark, sf_dir)))


@query(f"WITH {TIED_SQL}, {CURVE_SQL.format('tied')} SELECT {q('greatest(tp / np - fp / nn, 0)')} AS youden_j, CASE WHEN tp / np - fp / nn > 0 THEN p ELSE 'infinity'::DOUBLE END AS threshold, {q('CASE WHEN tp / np - fp / nn > 0 THEN (tp + nn - fp) / (np + nn) ELSE nn / (np + nn) END')} AS accuracy FROM c ORDER BY tp / np - fp / nn DESC, p DESC LIMIT 1")
def youden(spark, sf_dir):
    got = metrics.youden(tied(spark, sf_dir))
    return got.select(C.quantised(F.col("youden_j")).alias("youden_j"), "threshold", C.quantised(F.col("accuracy")).alias("accuracy"))


@query(f"WITH {SCORED_SQL} SELECT {q('avg((p - y) ** 2)')} AS brier FROM scored")
def brier(spark, sf_dir):
    return rounded(metrics.brier(scored(spark, sf_dir)))


@query(f"WITH {SCORED_SQL}, c AS (SELECT y, greatest(1e-7, least(1 - 1e-7, p)) AS p FROM scored) SELECT {q('-avg(y * ln(p) + (1 - y) * ln(1 - p))')} AS bce FROM c")
def bce(spark, sf_dir):
    return rounded(metrics.log_loss(scored(spark, sf_dir)))


BINS_SQL = f"{SCORED_SQL}, b AS (SELECT y, p, ntile(15) OVER (ORDER BY p, row_id) AS bin FROM scored), m AS (SELECT bin, count(*) AS n, avg(p) AS mp, avg(y) AS fr FROM b GROUP BY bin)"


@query(f"WITH {BINS_SQL} SELECT bin::BIGINT AS bin, n, {q('mp')} AS mean_p, {q('fr')} AS frac_pos FROM m")
def reliability_bins(spark, sf_dir):
    return rounded(metrics.reliability(scored(spark, sf_dir)))


@query(f"WITH {BINS_SQL} SELECT {q('sum(n * abs(mp - fr)) / sum(n)')} AS ece FROM m")
def ece(spark, sf_dir):
    return rounded(metrics.calibration_error(scored(spark, sf_dir)).select("ece"))


@query(f"WITH {BINS_SQL} SELECT {q('max(abs(mp - fr))')} AS mce FROM m")
def mce(spark, sf_dir):
    return rounded(metrics.calibration_error(scored(spark, sf_dir)).select("mce"))


# Slices, gate, comparison

SLICED_AUC = f"s AS (SELECT slice, y, {AUC_RANKS.format('PARTITION BY slice', 'slice,')} AS r FROM {{0}}), a AS (SELECT slice, count(*) AS n, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, {AUC_OF.replace('count(*) FILTER (y = 0))', 'nullif(count(*) FILTER (y = 0), 0))')} AS auc FROM s GROUP BY slice)"


@query(f"WITH {SCORED_SQL}, {SLICED_AUC.format('scored')} SELECT slice, n, n_pos, n_neg, n_pos < 2 OR n_neg < 2 OR n < 4 AS skipped, CASE WHEN NOT (n_pos < 2 OR n_neg < 2 OR n < 4) THEN {q('auc')} END AS auc FROM a")
def slice_auc(spark, sf_dir):
    return rounded(slices.slice_aucs(scored(spark, sf_dir)))


@query(f"""WITH {TRACK_SQL}, m AS (SELECT median(k) FILTER (source = 'sim') AS mid FROM track),
e AS (SELECT event_id, 'maneuver:' || event_type AS slice FROM track
UNION ALL SELECT event_id, 'knob:noise_low' FROM track, m WHERE source = 'real' OR k <= mid UNION ALL SELECT event_id, 'knob:noise_high' FROM track, m WHERE source = 'real' OR k > mid
UNION ALL SELECT event_id, 'knob:latency_0' FROM track WHERE source = 'real' OR k % 5 = 0 UNION ALL SELECT event_id, 'knob:latency_gt0' FROM track WHERE source = 'real' OR k % 5 > 0)
SELECT slice, count(*) AS n, sum(event_id)::BIGINT AS ids FROM e GROUP BY slice""")
def knob_slices(spark, sf_dir):
    rows = tracks(spark, sf_dir).select(F.col("event_id").alias("segment_id"), "source", F.col("event_type").alias("maneuver"), "k")
    configs = rows.select("segment_id", F.to_json(F.struct(F.col("k").cast("double").alias("pos_noise_std"), (F.col("k") % 5).alias("latency_steps"))).alias("config_json"))
    return slices.sliced(rows.drop("k"), configs).groupBy("slice").agg(F.count("*").alias("n"), F.sum("segment_id").alias("ids"))


@query(f"""WITH t AS (SELECT p_brand AS name, (CAST(sum(p_size) AS BIGINT) % 97 + 1) / 100.0 AS p FROM part GROUP BY p_brand),
k AS (SELECT *, row_number() OVER (ORDER BY p, name) AS k, count(*) OVER () AS m FROM t)
SELECT name, {q('p')} AS p, {q('least(1, min(p * m / k) OVER (ORDER BY k DESC))')} AS p_adj FROM k""")
def bh_adjust(spark, sf_dir):
    t = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(((F.sum("p_size") % 97 + 1) / 100.0).alias("p"))
    return rounded(inference.adjusted(t, "p"))


GATE_SIDE = f"SELECT slice, n, auc, auc - 0.01 AS ci_low, auc + 0.01 AS ci_high FROM (SELECT l_shipmode_ AS slice, count(*) AS n, {AUC_OF} AS auc FROM (SELECT l_shipmode_, y, rank() OVER (PARTITION BY l_shipmode_ ORDER BY p) + (count(*) OVER (PARTITION BY l_shipmode_, p) - 1) / 2.0 AS r FROM g WHERE {{0}}) GROUP BY l_shipmode_)"


@query(f"""WITH g AS (SELECT concat(l_linestatus, l_linenumber) AS l_shipmode_, l_shipdate, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, floor(l_discount * 100 + 0.5) / 10 AS p FROM lineitem),
b AS ({GATE_SIDE.format("l_shipdate < TIMESTAMP '1998-05-24'")}), c AS ({GATE_SIDE.format("l_shipdate >= TIMESTAMP '1998-05-24'")}),
j AS (SELECT b.slice, CASE WHEN c.slice IS NULL OR c.auc IS NULL THEN 'missing' WHEN b.n < 30 OR c.n < 30 THEN 'few' WHEN c.ci_high < b.ci_low AND b.auc - c.auc > 0.05 THEN 'worse' ELSE 'kept' END AS status
FROM b LEFT JOIN c USING (slice))
SELECT slice, status, status IN ('missing', 'worse') AS violates FROM j""")
def regression_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("slice"), "l_shipdate", (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.floor(F.col("l_discount") * 100 + 0.5) / 10).alias("p"))
    early = F.col("l_shipdate") < F.lit("1998-05-24").cast("timestamp_ntz")
    ends = lambda d: d.withColumns({"ci_low": F.col("auc") - 0.01, "ci_high": F.col("auc") + 0.01}).withColumn("auc", F.when(~F.isnan("auc"), F.col("auc")))
    return slices.regression_gate(ends(metrics.auc_roc(rows.filter(early), ["slice"])), ends(metrics.auc_roc(rows.filter(~early), ["slice"])))


@query("""WITH e AS (SELECT concat('region.', n_regionkey, '.', n_nationkey) AS path, CAST(n_nationkey AS DOUBLE) AS value FROM nation WHERE n_nationkey < 20),
a AS (SELECT concat('region.', n_regionkey, '.', n_nationkey) AS path, CAST(n_nationkey AS DOUBLE) + CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END AS value FROM nation WHERE n_nationkey >= 5)
SELECT * FROM (SELECT coalesce(e.path, a.path) AS path, e.value AS expected, a.value AS actual, CASE WHEN a.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'extra' WHEN abs(e.value - a.value) > 1e-6 THEN 'differs' END AS problem
FROM e FULL JOIN a ON e.path = a.path) WHERE problem IS NOT NULL""")
def metric_diff(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat_ws(".", F.lit("region"), "n_regionkey", "n_nationkey").alias("path"))
    key = F.col("n_nationkey")
    expected = n.filter(key < 20).select("path", key.cast("double").alias("value"))
    actual = n.filter(key >= 5).select("path", (key + F.when(key % 3 == 0, 1).otherwise(0)).cast("double").alias("value"))
    return slices.metric_diff(expected, actual)


# Resampling

REPLICATES, PERMUTATIONS = 300, 100

JACK_SQL = f"""{SCORED_SQL}, cl AS (SELECT DISTINCT cluster AS out FROM scored), jr AS (SELECT out, y, rank() OVER (PARTITION BY out ORDER BY p) + (count(*) OVER (PARTITION BY out, p) - 1) / 2.0 AS r FROM cl JOIN scored ON cluster != out),
jack AS (SELECT out AS cluster, {AUC_OF} AS stat FROM jr GROUP BY out)"""


@query(f"WITH {JACK_SQL} SELECT cluster, {q('stat')} AS stat FROM jack")
def jackknife_auc(spark, sf_dir):
    return rounded(inference.jackknife_auc(scored(spark, sf_dir), "cluster"))


@query(f"WITH {JACK_SQL}, c AS (SELECT avg(stat) OVER () - stat AS c FROM jack) SELECT {q('sum(c * c * c) / (6 * pow(sum(c * c), 1.5))', 5)} AS acceleration FROM c")
def bca_acceleration(spark, sf_dir):
    return rounded(inference.acceleration(inference.jackknife_auc(scored(spark, sf_dir), "cluster")), 5)


def _draw_sql(*keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 8))::UBIGINT / CAST(4294967296 AS DOUBLE))"


BOOT_SQL = f"""{SCORED_SQL}, names AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS number FROM (SELECT DISTINCT cluster FROM scored)), cnt AS (SELECT count(*) AS s FROM names),
slots AS (SELECT b, unnest(generate_series(0, s - 1)) AS slot, s FROM cnt, (SELECT unnest(generate_series(0, {REPLICATES - 1})) AS b)),
drawn AS (SELECT b, CAST(floor({_draw_sql('0', 'b', 'slot')} * s) AS BIGINT) AS number, count(*) AS times FROM slots GROUP BY 1, 2),
wt AS (SELECT b, p, y, sum(times) AS w FROM drawn JOIN names USING (number) JOIN scored USING (cluster) GROUP BY b, p, y),
ps AS (SELECT b, p, sum(CASE WHEN y = 1 THEN w ELSE 0 END)::DOUBLE AS pos, sum(CASE WHEN y = 0 THEN w ELSE 0 END)::DOUBLE AS neg FROM wt GROUP BY b, p),
bl AS (SELECT *, sum(neg) OVER (PARTITION BY b ORDER BY p) - neg AS below FROM ps),
boot AS (SELECT b, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS stat FROM bl GROUP BY b)"""


@query(f"WITH {BOOT_SQL} SELECT b, {q('stat')} AS stat FROM boot")
def cluster_bootstrap(spark, sf_dir):
    return rounded(inference.bootstrap_auc(scored(spark, sf_dir), "cluster", REPLICATES))


@query()
def bca_interval(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return inference.bca_intervals(inference.bootstrap_auc(rows, "cluster", REPLICATES), inference.jackknife_auc(rows, "cluster"), metrics.auc_roc(rows))


ECE_BOOT_SQL = f"""{BOOT_SQL}, placed AS (SELECT b, p, pos, pos + neg AS w, sum(pos + neg) OVER (PARTITION BY b ORDER BY p) - pos - neg AS f, CAST(sum(pos + neg) OVER (PARTITION BY b) AS BIGINT) AS n FROM ps),
ends AS (SELECT *, (n // 15) * k + least(k, n % 15) AS low, (n // 15) * (k + 1) + least(k + 1, n % 15) AS high FROM placed, (SELECT unnest(generate_series(0, 14)) AS k)),
inside AS (SELECT b, k, p, pos / w AS fr, least(f + w, high) - greatest(f, low) AS m FROM ends),
gaps AS (SELECT b, k, sum(m) AS m, abs(sum(m * p) - sum(m * fr)) AS gap FROM inside WHERE m > 0 GROUP BY b, k),
eces AS (SELECT b, sum(gap) / sum(m) AS stat FROM gaps GROUP BY b)"""


@query(f"WITH {ECE_BOOT_SQL} SELECT count(*) AS n, {q('quantile_cont(stat, 0.025)')} AS ci_low, {q('quantile_cont(stat, 0.975)')} AS ci_high FROM eces")
def ece_interval(spark, sf_dir):
    boot = inference.bootstrap_ece(scored(spark, sf_dir), "cluster", 15, REPLICATES)
    return rounded(boot.agg(F.count("*").alias("n"), F.percentile("stat", 0.025).alias("ci_low"), F.percentile("stat", 0.975).alias("ci_high")))


PERM_SQL = f"""{SCORED_SQL}, k AS (SELECT sum(y) AS np FROM scored), sh AS (SELECT b, p, CASE WHEN row_number() OVER (PARTITION BY b ORDER BY {_draw_sql('0', 'b', 'row_id')}, row_id) <= np THEN 1 ELSE 0 END AS y FROM scored, k, (SELECT unnest(generate_series(0, {PERMUTATIONS - 1})) AS b)),
pr AS (SELECT b, y, {AUC_RANKS.format('PARTITION BY b', 'b,')} AS r FROM sh), perm AS (SELECT b, {AUC_OF} AS stat FROM pr GROUP BY b),
ob AS (SELECT {AUC_OF} AS auc FROM (SELECT y, {AUC_RANKS.format('', '')} AS r FROM scored))"""


@query(f"WITH {PERM_SQL} SELECT {q('(1 + count(*) FILTER (stat >= auc)) / (1.0 + count(*))')} AS p_value FROM perm, ob")
def permutation_p(spark, sf_dir):
    rows = scored(spark, sf_dir)
    null = inference.permutation_auc(rows, "row_id", PERMUTATIONS)
    return rounded(inference.p_value(null, metrics.auc_roc(rows).first()["auc"]))


PAIR_SIDE = f"SELECT b, {AUC_OF} AS auc FROM (SELECT b, y, rank() OVER (PARTITION BY b ORDER BY {{0}}) + (count(*) OVER (PARTITION BY b, {{0}}) - 1) / 2.0 AS r FROM sw) GROUP BY b"


@query(f"""WITH {SCORED_SQL}, two AS (SELECT row_id, y, p AS a, (row_id % 10) / 10.0::DOUBLE AS c FROM scored),
sw AS (SELECT b, y, CASE WHEN d < 0.5 THEN c ELSE a END AS pa, CASE WHEN d < 0.5 THEN a ELSE c END AS pb FROM (SELECT *, {_draw_sql('0', 'b', 'row_id')} AS d FROM two, (SELECT unnest(generate_series(0, {PERMUTATIONS - 1})) AS b))),
x AS ({PAIR_SIDE.format('pa')}), z AS ({PAIR_SIDE.format('pb')}) SELECT b, {q('x.auc - z.auc')} AS stat FROM x JOIN z USING (b)""")
def paired_permutation(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("c", (F.col("row_id") % 10) / F.lit(10.0))
    return rounded(inference.paired_permutation_auc(rows, "row_id", "p", "c", PERMUTATIONS))


# Evaluation


def _predictions(spark, sf_dir):
    """Quality labels as predictions: low quality stands for simulated."""
    rows = scored(spark, sf_dir)
    return rows.select(F.col("row_id").alias("segment_id"), F.col("cluster").alias("scene_id"), F.when(F.col("y") == 1, "sim").otherwise("real").alias("source"), F.col("slice").alias("maneuver"), splits.split_of(F.col("cluster")).alias("split"), F.col("p").alias("prob_sim"))


def _configs(spark, sf_dir):
    return _predictions(spark, sf_dir).filter("source = 'sim'").select("segment_id", F.to_json(F.struct(F.col("prob_sim").alias("pos_noise_std"), (F.col("segment_id") % 3).alias("latency_steps"))).alias("config_json"))


def _evaluation(spark, sf_dir):
    return evaluation.evaluate(_predictions(spark, sf_dir), _configs(spark, sf_dir), replicates=REPLICATES, permutations=PERMUTATIONS)


SLICE_P_SQL = f"""{SCORED_SQL}, sl AS (SELECT * FROM scored WHERE slice IS NOT NULL), {SLICED_AUC.format('sl')},
ok AS (SELECT slice, auc, n_pos AS np FROM a WHERE NOT (n_pos < 2 OR n_neg < 2 OR n < 4)),
sh AS (SELECT slice, b, p, CASE WHEN row_number() OVER (PARTITION BY slice, b ORDER BY {_draw_sql('0', 'b', 'row_id')}, row_id) <= np THEN 1 ELSE 0 END AS y FROM sl JOIN ok USING (slice), (SELECT unnest(generate_series(0, {PERMUTATIONS - 1})) AS b)),
pr AS (SELECT slice, b, y, {AUC_RANKS.format('PARTITION BY slice, b', 'slice, b,')} AS r FROM sh), perm AS (SELECT slice, b, {AUC_OF} AS stat FROM pr GROUP BY slice, b),
t AS (SELECT slice, any_value(auc) AS auc, (1 + count(*) FILTER (stat >= auc)) / (1.0 + count(*)) AS pv FROM perm JOIN ok USING (slice) GROUP BY slice),
k AS (SELECT *, row_number() OVER (ORDER BY pv, slice) AS k, count(*) OVER () AS m FROM t)"""


@query(f"WITH {SLICE_P_SQL} SELECT slice, {q('auc')} AS auc, {q('pv')} AS p_perm, {q('least(1, min(pv * m / k) OVER (ORDER BY k DESC))')} AS p_adj FROM k")
def slice_p_values(spark, sf_dir):
    rows = scored(spark, sf_dir).filter("slice is not null")
    return rounded(evaluation.slice_report(rows, "cluster", "row_id", REPLICATES, PERMUTATIONS, counted=False).filter("not skipped").select("slice", "auc", "p_perm", "p_adj"))


@query()
def evaluation_slices(spark, sf_dir):
    """Maneuvers and knobs of the evaluated split, with intervals and adjusted p-values."""
    return rounded(_evaluation(spark, sf_dir).slices)


@query()
def evaluation_overall(spark, sf_dir):
    return rounded(_evaluation(spark, sf_dir).overall.drop("threshold"))


@query()
def evaluation_gate(spark, sf_dir):
    """The run against a baseline of its own train split."""
    rows = _predictions(spark, sf_dir)
    base = evaluation.slice_report(slices.sliced(rows.filter("split = 'train'").withColumn("y", (F.col("source") == "sim").cast("int")).withColumnRenamed("prob_sim", "p")), replicates=REPLICATES, permutations=PERMUTATIONS)
    return evaluation.evaluate(rows, baseline=base.filter("not skipped"), replicates=REPLICATES, permutations=PERMUTATIONS).gate


RUNS_SQL = f"""runs AS (SELECT l.doc_id AS row_id, 'quality' AS config_id, m.model, l.quality AS y, CASE WHEN m.model = 'digit' THEN l.doc_id % 10 / 10.0::DOUBLE ELSE CAST(d.n_chars AS DOUBLE) / (d.n_chars + 2000) END AS p, 'maneuver:' || d.lang AS slice
 FROM labels l JOIN documents d USING (doc_id), (SELECT unnest(['digit', 'length']) AS model) m WHERE l.quality IS NOT NULL AND d.n_chars IS NOT NULL
 UNION ALL SELECT l.doc_id, 'toxic', m.model, l.toxic, CASE WHEN m.model = 'digit' THEN l.doc_id % 10 / 10.0::DOUBLE ELSE CAST(d.n_chars AS DOUBLE) / (d.n_chars + 2000) END, 'maneuver:' || d.lang
 FROM labels l JOIN documents d USING (doc_id), (SELECT unnest(['digit', 'length']) AS model) m WHERE l.toxic IS NOT NULL AND d.n_chars IS NOT NULL)"""


def _runs(spark, sf_dir):
    """Predictions of four runs: two labels as configurations, two scores as models."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang").filter("n_chars is not null")
    both = table(spark, sf_dir, "labels").join(d, "doc_id")
    both = both.withColumn("config_id", F.explode(F.array(F.lit("quality"), F.lit("toxic")))).withColumn("model", F.explode(F.array(F.lit("digit"), F.lit("length"))))
    both = both.withColumn("y", F.when(F.col("config_id") == "quality", F.col("quality")).otherwise(F.col("toxic"))).filter("y is not null")
    p = F.when(F.col("model") == "digit", F.col("doc_id") % 10 / F.lit(10.0)).otherwise(F.col("n_chars").cast("double") / (F.col("n_chars") + 2000))
    return both.select(
        "config_id", F.lit("mid").alias("knob_noise"), F.lit(2).cast("bigint").alias("knob_latency"), F.lit(0.0).alias("knob_bias"), "model", F.col("doc_id").alias("segment_id"),
        F.col("source").alias("scene_id"), F.when(F.col("y") == 1, "sim").otherwise("real").alias("source"), F.col("lang").alias("maneuver"), F.lit("test").alias("split"), p.alias("prob_sim"),
    )


@query(f"""WITH {RUNS_SQL}, r AS (SELECT config_id, model, y, p, {AUC_RANKS.format('PARTITION BY config_id, model', 'config_id, model,')} AS r FROM runs),
o AS (SELECT config_id, model, NULL::VARCHAR AS slice_name, count(*) AS n, count(*) FILTER (y = 1) AS n_pos, {AUC_OF} AS auc, avg((p - y) ** 2) AS brier FROM r GROUP BY ALL),
b AS (SELECT config_id, model, y, p, ntile(15) OVER (PARTITION BY config_id, model ORDER BY p, row_id) AS bin FROM runs), m AS (SELECT config_id, model, bin, count(*) AS n, avg(p) AS mp, avg(y) AS fr FROM b GROUP BY ALL),
e AS (SELECT config_id, model, sum(n * abs(mp - fr)) / sum(n) AS ece, max(abs(mp - fr)) AS mce FROM m GROUP BY ALL),
t AS (SELECT config_id, model, slice, y, {AUC_RANKS.format('PARTITION BY config_id, model, slice', 'config_id, model, slice,')} AS r FROM runs WHERE slice IS NOT NULL),
s AS (SELECT config_id, model, slice AS slice_name, count(*) AS n, count(*) FILTER (y = 1) AS n_pos, {AUC_OF.replace('count(*) FILTER (y = 0))', 'nullif(count(*) FILTER (y = 0), 0))').replace('(count(*) FILTER (y = 1) *', '(nullif(count(*) FILTER (y = 1), 0) *')} AS auc FROM t GROUP BY ALL)
SELECT 'overall' AS scope, config_id, model, slice_name, n, n_pos, {q('auc')} AS auc, {q('brier')} AS brier, {q('ece')} AS ece, {q('mce')} AS mce FROM o JOIN e USING (config_id, model)
UNION ALL SELECT 'slice', config_id, model, slice_name, n, n_pos, {q('auc')}, NULL, NULL, NULL FROM s WHERE n_pos >= 2 AND n - n_pos >= 2 AND n >= 4""")
def sweep_runs(spark, sf_dir):
    """The table of a sweep over four runs in one plan; what SQL can express of it."""
    got = evaluation.sweep_rows(_runs(spark, sf_dir), replicates=60, permutations=40)
    return rounded(got.select("scope", "config_id", "model", "slice_name", "n", "n_pos", "auc", "brier", "ece", "mce"))


@query()
def permutation_counted(spark, sf_dir):
    """p by counted draws; its replicates are compared with brute force in a test."""
    rows = scored(spark, sf_dir)
    return inference.p_value(inference.counted_permutation_auc(rows, 1000), metrics.auc_roc(rows).first()["auc"])


# Power and calibration


@query(f"""WITH g AS (SELECT s_suppkey, 0.5 + (s_suppkey % 50) / 100.0::DOUBLE AS auc, 20.0::DOUBLE + s_suppkey % 7 AS n1, 30.0::DOUBLE AS n0 FROM supplier)
SELECT s_suppkey, {q('sqrt((auc * (1 - auc) + (n1 - 1) * (auc / (2 - auc) - auc * auc) + (n0 - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (n1 * n0))')} AS se FROM g""")
def hanley_mcneil(spark, sf_dir):
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.lit(0.5) + (k % 50) / 100.0).alias("auc"), (k % 7 + F.lit(20.0)).alias("n1"))
    return rounded(rows.select("s_suppkey", power.auc_error(F.col("auc"), F.col("n1"), F.lit(30.0)).alias("se")))


POWER_SQL = "sqrt((a * (1 - a) + (n1 - 1) * (a / (2 - a) - a * a) + (n0 - 1) * (2 * a * a / (1 + a) - a * a)) / (n1 * n0))"


@query(f"""WITH s AS (SELECT s_suppkey, 0.51::DOUBLE + s_suppkey % 45 / 100.0 AS a, 4 + s_suppkey % 997 AS n FROM supplier), p AS (SELECT *, floor(n / 2)::DOUBLE AS n1, n - floor(n / 2)::DOUBLE AS n0 FROM s),
z AS (SELECT s_suppkey, (a - 0.5) / {POWER_SQL} - 1.6448536269514722 AS z FROM p),
i AS (SELECT s_suppkey, z, sum(exp(-0.5 * pow(z * k / 400, 2)) * CASE WHEN k IN (0, 400) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * z / 1200 / sqrt(2 * pi()) AS area FROM z, (SELECT unnest(generate_series(0, 400)) AS k) GROUP BY s_suppkey, z)
SELECT s_suppkey, {q('0.5 + area')} AS power FROM i""")
def power_curve(spark, sf_dir):
    """The power of each supplier's AUC at its number of rows."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.lit(0.51) + k % 45 / 100.0).alias("auc"), (4 + k % 997).alias("n"))
    return rounded(power.with_power(rows).select("s_suppkey", "power"))


@query(f"""WITH s AS (SELECT s_suppkey, 0.55::DOUBLE + s_suppkey % 40 / 100.0 AS a FROM supplier), g AS (SELECT DISTINCT a FROM s), t AS (SELECT a, n, n / 2.0::DOUBLE AS n1, n / 2.0::DOUBLE AS n0 FROM g, (SELECT unnest(generate_series(4, 2000, 2)) AS n)),
m AS (SELECT a, min(n) AS n FROM t WHERE (a - 0.5) / {POWER_SQL} - 1.6448536269514722 >= 0.8416212335729143 GROUP BY a) SELECT s_suppkey, n::BIGINT AS n FROM s JOIN m USING (a)""")
def required_samples(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.lit(0.55) + F.col("s_suppkey") % 40 / 100.0).alias("auc"))
    return power.with_required(rows).select("s_suppkey", "n")


def _halves(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return rows.filter("row_id % 2 = 0"), rows.filter("row_id % 2 = 1")


@query()
def recalibration(spark, sf_dir):
    return calibration.recalibrated(*_halves(spark, sf_dir))


# Simulator


@query(f"""WITH RECURSIVE sc AS (SELECT s_suppkey, (s_suppkey % 21 - 10) / 10.0::DOUBLE AS st, (s_suppkey % 9 - 4)::DOUBLE AS ac, (s_suppkey % 15)::DOUBLE AS v0 FROM supplier),
r AS (SELECT s_suppkey, 0 AS i, greatest(-0.6, least(0.6, st)) AS st, greatest(-5.0, least(3.0, ac)) AS ac, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS h, v0 AS v FROM sc
UNION ALL SELECT s_suppkey, i + 1, st, ac, x + v * cos(h) * CAST(0.1 AS DOUBLE), y + v * sin(h) * CAST(0.1 AS DOUBLE), h + v / CAST(2.7 AS DOUBLE) * tan(st) * CAST(0.1 AS DOUBLE), greatest(0, v + ac * CAST(0.1 AS DOUBLE)) FROM r WHERE i < 60)
SELECT s_suppkey, CAST(i AS BIGINT) AS step, {q('x', 5)} AS x, {q('y', 5)} AS y, {q('h', 5)} AS heading, {q('v', 5)} AS speed FROM r""")
def bicycle_rollout(spark, sf_dir):
    k = F.col("s_suppkey")
    states = simulate.bicycle_states((k % 21 - 10) / F.lit(10.0), (k % 9 - 4).cast("double"), (k % 15).cast("double"), 60)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(states).alias("step", "s"))
    return rounded(rows.select("s_suppkey", F.col("step").cast("bigint").alias("step"), *[F.col(f"s.{c}").alias(c) for c in ("x", "y", "heading", "speed")]), 5)


@query(f"WITH {TRACK_SQL} SELECT user_id, idx, {q(f'coalesce(lag(yaw_rate * CAST(1.2 AS DOUBLE), 2) OVER {W_SQL}, 0)')} AS steer FROM track")
def latency_fifo(spark, sf_dir):
    w = S.ordered(["user_id"], "idx")
    return _by_user(tracks(spark, sf_dir).withColumn("steer", F.lag(F.col("yaw_rate") * 1.2, 2, 0.0).over(w)), "steer")


def _scenarios(spark, sf_dir):
    k = F.col("c_custkey")
    steps = F.sequence(F.lit(0), F.lit(80))
    return table(spark, sf_dir, "customer").select(
        k.alias("scenario_id"), F.transform(steps, lambda i: i.cast("double")).alias("path_x"), F.transform(steps, lambda i: 2 * F.sin(i / 10.0 + k % 7)).alias("path_y"),
        F.lit(0.0).alias("x"), (2 * F.sin((k % 7).cast("double"))).alias("y"), F.lit(0.0).alias("heading"), (5 + k % 6).cast("double").alias("speed"),
        (k % 5).alias("latency_steps"), ((k % 3) / 10.0).alias("steer_bias"), F.lit(0.01).alias("steer_noise_std"), F.lit(1.0).alias("lookahead_gain"),
    )


@query(f"""WITH s AS (SELECT c_custkey, unnest(generate_series(0, 60)) AS k FROM customer) SELECT c_custkey AS scenario_id, k::BIGINT AS step, {q('k / 10.0::DOUBLE')} AS t, {q('(5 + c_custkey % 6) * k / 10.0::DOUBLE * cos(c_custkey % 7)')} AS x,
{q('(5 + c_custkey % 6) * k / 10.0::DOUBLE * sin(c_custkey % 7)')} AS y, {q('(c_custkey % 7)::DOUBLE')} AS heading, {q('(5 + c_custkey % 6)::DOUBLE')} AS speed, {q('0.0::DOUBLE')} AS yaw_rate FROM s""")
def straight_rollout(spark, sf_dir):
    """Without noise along a straight path, where the closed form is known."""
    k = F.col("c_custkey")
    way = lambda f: F.transform(F.sequence(F.lit(0), F.lit(100)), lambda i: i * f((k % 7).cast("double")))
    zero = F.lit(0.0)
    rows = table(spark, sf_dir, "customer").select(k.alias("scenario_id"), way(F.cos).alias("path_x"), way(F.sin).alias("path_y"), zero.alias("x"), zero.alias("y"), (k % 7).cast("double").alias("heading"), (5 + k % 6).cast("double").alias("speed"))
    return rounded(simulate.batch_rollout(rows, 60).withColumn("yaw_rate", F.round("yaw_rate", 9) + 0.0))


@query()
def batch_rollout(spark, sf_dir):
    """61 rows for each customer as a scenario."""
    return rounded(simulate.batch_rollout(_scenarios(spark, sf_dir), 60, knobs=("latency_steps", "steer_bias", "steer_noise_std", "lookahead_gain")))


@query()
def recorder_noise(spark, sf_dir):
    return rounded(simulate.recorder_noise(segments(spark, sf_dir), SEGMENT, "real"))


@query()
def matched_rollouts(spark, sf_dir):
    """A counterpart of every whole window of the driver's tracks."""
    return rounded(simulate.matched_rollouts(segments(spark, sf_dir), keys=SEGMENT))


@query()
def reference_rollouts(spark, sf_dir):
    return rounded(simulate.reference_rollouts(tracks(spark, sf_dir).withColumn("agent_token", F.col("user_id").cast("string"))))


@query(f"""WITH {TRACK_SQL}, o AS (SELECT user_id, min_by(x, idx) AS ox, min_by(y, idx) AS oy FROM track GROUP BY user_id)
SELECT concat('scene ', user_id) AS scene_id, concat('agent ', user_id) AS agent_token, {q('CAST(epoch_us(ts) AS DOUBLE) / 1e6', 3)} AS t, {q('x - ox')} AS x, {q('y - oy')} AS y,
{q('2 * atan2(sin(heading / 2), cos(heading / 2)) - 2 * pi() * floor((2 * atan2(sin(heading / 2), cos(heading / 2)) + pi()) / (2 * pi()))', 4)} AS heading FROM track JOIN o USING (user_id)""")
def keyframe_observations(spark, sf_dir):
    """Each user as a scene with one agent, whose recorder stands where the agent starts."""
    t = tracks(spark, sf_dir)
    user, token = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    scene = t.select(F.concat(F.lit("s"), user).alias("token"), F.concat(F.lit("scene "), user).alias("name")).distinct()
    sample = t.select(token.alias("token"), F.concat(F.lit("s"), user).alias("scene_token"), (F.unix_micros(F.col("ts").cast("timestamp")) + F.col("idx") * 0).alias("timestamp"), token.alias("ego_pose_token"))
    pose = t.select(token.alias("token"), F.array("x", "y", F.lit(0.0)).alias("translation"))
    turn = F.col("heading") / 2
    rotation = F.struct(F.cos(turn).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.sin(turn).alias("z"))
    notes = t.select(token.alias("token"), token.alias("sample_token"), F.concat(F.lit("agent "), user).alias("instance_token"), rotation.alias("rotation"), F.array("x", "y", F.lit(0.0)).alias("translation"))
    got = keyframes.observations(scene, sample, notes, pose)
    return got.select("scene_id", "agent_token", C.quantised(F.col("t"), 3).alias("t"), C.quantised(F.col("x")).alias("x"), C.quantised(F.col("y")).alias("y"), C.quantised(F.col("heading"), 4).alias("heading"))


TRACKS_SQL = f"""WITH {TRACK_SQL}, e AS (SELECT user_id, CAST(epoch_us(ts) AS DOUBLE) / 1e6 / 3600 AS h, idx, x, y, heading FROM track),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY h, idx) AS run FROM (SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY user_id ORDER BY h, idx) > 24 THEN 1 ELSE 0 END AS b FROM e)),
o AS (SELECT user_id, run, min(h) AS h0, max(h) AS h1 FROM r GROUP BY ALL HAVING max(h) - min(h) >= 36 - 1e-9 AND count(*) >= 2),
p AS (SELECT r.user_id, r.run, h AS a, lead(h) OVER v AS b, x, lead(x) OVER v AS x1, y, lead(y) OVER v AS y1, heading AS d, lead(heading) OVER v AS d1 FROM r JOIN o USING (user_id, run) WINDOW v AS (PARTITION BY r.user_id, r.run ORDER BY h, idx)),
g AS (SELECT user_id, run, h0, unnest(generate_series(0, CAST(floor((h1 - h0) / 6 + 1e-9) AS BIGINT))) AS k FROM o),
j AS (SELECT g.user_id, g.run, g.k, g.h0 + g.k * 6 AS t, p.* EXCLUDE (user_id, run) FROM g ASOF JOIN p ON g.user_id = p.user_id AND g.run = p.run AND g.h0 + g.k * 6 + 6e-9 >= p.a),
i AS (SELECT user_id, run, k, t, x + f * (x1 - x) AS x, y + f * (y1 - y) AS y, d + f * (d1 - d) AS d FROM (SELECT * REPLACE (coalesce(x1, x) AS x1, coalesce(y1, y) AS y1, coalesce(d1, d) AS d1), CASE WHEN b IS NULL OR b = a THEN 0 ELSE (t - a) / (b - a) END AS f FROM j)),
m AS (SELECT user_id, run, k, t, (x + coalesce(lag(x, 1) OVER w, first_value(x) OVER w) + coalesce(lead(x, 1) OVER w, last_value(x) OVER (PARTITION BY user_id, run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) + coalesce(lag(x, 2) OVER w, first_value(x) OVER w) + coalesce(lead(x, 2) OVER w, last_value(x) OVER (PARTITION BY user_id, run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) / 5 AS x, (y + coalesce(lag(y, 1) OVER w, first_value(y) OVER w) + coalesce(lead(y, 1) OVER w, last_value(y) OVER (PARTITION BY user_id, run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) + coalesce(lag(y, 2) OVER w, first_value(y) OVER w) + coalesce(lead(y, 2) OVER w, last_value(y) OVER (PARTITION BY user_id, run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) / 5 AS y, (d + coalesce(lag(d, 1) OVER w, first_value(d) OVER w) + coalesce(lead(d, 1) OVER w, last_value(d) OVER (PARTITION BY user_id, run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) + coalesce(lag(d, 2) OVER w, first_value(d) OVER w) + coalesce(lead(d, 2) OVER w, last_value(d) OVER (PARTITION BY user_id, run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))) / 5 AS d FROM i WINDOW w AS (PARTITION BY user_id, run ORDER BY k))
SELECT user_id, run::BIGINT AS run, k::BIGINT AS k, {q('t', 3)} AS t, {q('x', 4)} AS x, {q('y', 4)} AS y, {q('d', 4)} AS heading, {q('sqrt(dx * dx + dy * dy)', 4)} AS speed, {q('dd', 4)} AS yaw_rate
FROM (SELECT *, coalesce((lead(x) OVER w - lag(x) OVER w) / 12.0::DOUBLE, (lead(x) OVER w - x) / 6.0::DOUBLE, (x - lag(x) OVER w) / 6.0::DOUBLE) AS dx, coalesce((lead(y) OVER w - lag(y) OVER w) / 12.0::DOUBLE, (lead(y) OVER w - y) / 6.0::DOUBLE, (y - lag(y) OVER w) / 6.0::DOUBLE) AS dy, coalesce((lead(d) OVER w - lag(d) OVER w) / 12.0::DOUBLE, (lead(d) OVER w - d) / 6.0::DOUBLE, (d - lag(d) OVER w) / 6.0::DOUBLE) AS dd FROM m WINDOW w AS (PARTITION BY user_id, run ORDER BY k))"""


@query(TRACKS_SQL)
def keyframe_tracks(spark, sf_dir):
    """Each user's events as keyframes, hours for seconds: cut at gaps of a day, short runs left out, put on a grid of six hours, smoothed, derived."""
    e = tracks(spark, sf_dir)
    seen = e.select(F.col("user_id").alias("scene_id"), F.lit("a").alias("agent_token"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600).alias("t"), "x", "y", "heading")
    got = keyframes.tracks(seen, step=6.0, gap=24.0, least=36.0)
    return got.select(F.col("scene_id").alias("user_id"), F.col("run").cast("bigint").alias("run"), F.col("k").cast("bigint").alias("k"), C.quantised(F.col("t"), 3).alias("t"), *[C.quantised(F.col(c), 4).alias(c) for c in ("x", "y", "heading", "speed", "yaw_rate")])


# Dataset


def _dataset(spark, sf_dir):
    real = segments(spark, sf_dir).select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("scene_id"), F.col("user_id").cast("string").alias("agent_token"), "window", "t", "x", "y", "heading", "speed", "yaw_rate")
    return dataset.build(real)


@query()
def dataset_aligned(spark, sf_dir):
    """Labels, features and channels of every real and simulated segment."""
    return _dataset(spark, sf_dir).aligned()


@query(f"""WITH {TRACK_SQL}, w AS (SELECT user_id, (count(*) - 61) // 30 + 1 AS n FROM track GROUP BY user_id HAVING count(*) >= 61), s AS (SELECT concat('user_', user_id) AS scene_id, n FROM w),
x AS (SELECT {SPLIT} AS split, n FROM s) SELECT source, split, sum(n)::BIGINT AS n, count(*) AS n_scenes FROM x, (SELECT unnest(['real', 'sim']) AS source) GROUP BY source, split""")
def dataset_manifest(spark, sf_dir):
    labels = _dataset(spark, sf_dir).labels
    return labels.groupBy("source", "split").agg(F.count("*").alias("n"), F.countDistinct("scene_id").alias("n_scenes"))


# Models


def _examples(spark, sf_dir):
    """A row for each window of the driven tracks; all windows of a user are in one split. The label is the way of driving, the other way
    round for a fifth of the users."""
    rows = features.extract_features(segments(spark, sf_dir, driven=True), SEGMENT)
    scene = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    y = (F.col("user_id") % 5 >= 3).cast("int").bitwiseXOR((C.md5_bucket(scene, 5) == 0).cast("int"))
    return saved(rows.select(F.concat_ws("_", "user_id", "window").alias("segment_id"), scene.alias("scene_id"), y.alias("y"), splits.split_of(scene).alias("split"), *schemas.FEATURES), "examples")


_SHARED: dict[tuple[str, str], DataFrame] = {}
_FITTED: dict[tuple[str, str], models.Boosted] = {}


def _shared_examples(spark, sf_dir):
    """The examples, which the queries of a session share."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SHARED:
        _SHARED.clear()
        _FITTED.clear()
        _SHARED[key] = _examples(spark, sf_dir)
    return _SHARED[key]


def _boosted(spark, sf_dir):
    """The examples and the trees fitted on them, which the queries of a session share."""
    key, rows = (spark.sparkContext.applicationId, sf_dir), _shared_examples(spark, sf_dir)
    if key not in _FITTED:
        _FITTED[key] = models.fit_boosted(rows, schemas.FEATURES)
    return rows, _FITTED[key]


@query()
def gbt_scores(spark, sf_dir):
    rows, fitted = _boosted(spark, sf_dir)
    return fitted.score(rows).select("segment_id", F.col("y").cast("bigint").alias("y"), "split", "p")


@query()
def gbt_stages(spark, sf_dir):
    """The AUC on val by the number of trees, in one pass over the rows."""
    rows, fitted = _boosted(spark, sf_dir)
    return models.stage_aucs(rows.filter("split = 'val'"), fitted.ensemble)


@query()
def top_importances(spark, sf_dir):
    """Mean absolute attributions of the same trees, over the rows they were fitted on."""
    rows, fitted = _boosted(spark, sf_dir)
    return models.importances(rows.filter("split = 'train'"), fitted)


@query()
def gbt_attributions(spark, sf_dir):
    """What each feature adds to each row's score."""
    rows, fitted = _boosted(spark, sf_dir)
    return trees.attributed(rows, fitted.best, ["segment_id"])


@query()
def fold_scores(spark, sf_dir):
    """The AUC of each of five folds, by all 400 trees fitted on the other four."""
    rows = _shared_examples(spark, sf_dir)
    return models.fold_aucs(models.cross_fitted(rows, schemas.FEATURES, "scene_id", 5))


@query("""WITH RECURSIVE s AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id),
k AS (SELECT *, row_number() OVER (ORDER BY n DESC, ('0x' || substr(md5(user_id::VARCHAR), 1, 16))::UBIGINT % 4294967296, user_id::VARCHAR) AS k FROM s),
r AS (SELECT 0::BIGINT AS k, [0, 0, 0, 0, 0]::BIGINT[] AS loads, NULL::BIGINT AS user_id, NULL::BIGINT AS n, NULL::BIGINT AS fold
UNION ALL SELECT k.k, list_transform(r.loads, lambda x, i: CASE WHEN i = list_position(r.loads, list_min(r.loads)) THEN x + k.n ELSE x END), k.user_id, k.n, list_position(r.loads, list_min(r.loads)) - 1 FROM r JOIN k ON k.k = r.k + 1)
SELECT user_id, n, fold FROM r WHERE k > 0""")
def grouped_folds(spark, sf_dir):
    """Users in five folds of nearly equal numbers of events."""
    return models.fold_assignment(table(spark, sf_dir, "events"), "user_id", 5)


# Samples and digests


@query(f"WITH d AS (SELECT o_orderpriority, o_orderkey, {_draw_sql('7', 'o_orderkey')} AS d FROM orders) SELECT o_orderpriority, o_orderkey FROM d QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY d, o_orderkey) <= 50")
def sample_of_k(spark, sf_dir):
    """Fifty orders of each priority."""
    return sampling.bottom_k(table(spark, sf_dir, "orders"), 50, "o_orderkey", ["o_orderpriority"], 7).select("o_orderpriority", "o_orderkey")


def _digest_sql(name: str, columns: dict[str, str]) -> str:
    shown = {"text": "{0}", "whole": "CAST({0} AS VARCHAR)", "number": "CAST(CAST(floor({0} * 1000000 + 0.5) AS DECIMAL(38, 0)) AS VARCHAR)"}
    parts = ", ".join(f"coalesce('=' || {shown[kind].format(c)}, '-')" for c, kind in sorted(columns.items()))
    return f"SELECT '{name}' AS name, count(*) AS n, CAST(coalesce(sum(('0x' || substr(md5(concat_ws('|', {parts})), 1, 15))::BIGINT::HUGEINT), 0) AS VARCHAR) AS digest FROM {name}"


DIGESTED = {
    "events": {"event_id": "whole", "user_id": "whole", "event_type": "text", "value": "number", "props": "text"},
    "customer": {"c_custkey": "whole", "c_name": "text", "c_nationkey": "whole", "c_acctbal": "number", "c_mktsegment": "text"},
    "documents": {"doc_id": "whole", "text": "text", "lang": "text", "source": "text", "n_chars": "whole"},
}


@query(" UNION ALL ".join(_digest_sql(n, c) for n, c in DIGESTED.items()))
def table_digests(spark, sf_dir):
    """Digests that don't depend on the order of rows."""
    out = None
    for name, columns in DIGESTED.items():
        part = replay.table_digest(table(spark, sf_dir, name), sorted(columns)).select(F.lit(name).alias("name"), "n", "digest")
        out = part if out is None else out.union(part)
    return out


@query("""WITH b AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 11 != 0), a AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 13 != 0)
SELECT * FROM (SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'gone' WHEN b.o_orderkey IS NULL THEN 'new' WHEN a.o_totalprice != b.o_totalprice THEN 'changed' END AS status FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey) WHERE status IS NOT NULL""")
def changed_orders(spark, sf_dir):
    """What differs between two states of a table, by key."""
    rows, key = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), F.col("o_orderkey")
    after = rows.filter(key % 13 != 0).withColumn("o_totalprice", F.when(key % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return replay.changed_rows(rows.filter(key % 11 != 0), after, ["o_orderkey"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def script_section(spark, sf_dir):
    """The last statement of a script's first section."""
    table(spark, sf_dir, "events").createOrReplaceTempView("strandlake_events")
    script = "-- first\nCREATE OR REPLACE TEMP VIEW strandlake_types AS SELECT event_type FROM strandlake_events;\nSELECT event_type, count(*) AS n FROM strandlake_types GROUP BY event_type;\n-- SECTION: sweep\nSELECT 1;"
    return files.run_script(spark, files.sections(script, "-- SECTION:")[0])


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
