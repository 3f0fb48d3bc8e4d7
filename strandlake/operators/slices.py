"""Slices of predictions, the report over them, the gate against a baseline, and the comparison of metric trees."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import auc_roc

SCHEMA_TAG = "strandlake.baseline.v1"


def sliced(df: DataFrame, configs: DataFrame | None = None, config_type: str = "pos_noise_std double, latency_steps bigint") -> DataFrame:
    """A row for each (row, slice) that it is in: its maneuver; and, with configs (segment_id, config_json), the halves of
    the knobs. Real rows are in all knob slices; simulated ones by noise against the simulated median, and by latency. A knob
    that no simulated row has a number for makes no slices. A row without a maneuver is in no slice of one."""
    named = df.select("*", F.concat(F.lit("maneuver:"), "maneuver").alias("slice"))
    base = named.filter("slice is not null")
    if configs is None:
        return base
    parsed = configs.select("segment_id", F.from_json("config_json", config_type).alias("cfg"))
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")), F.col(c).cast("double"))
    joined = df.join(parsed, "segment_id", "left").withColumns({"_noise": number("cfg.pos_noise_std"), "_latency": number("cfg.latency_steps")})
    sim = F.col("source") == "sim"
    known = joined.filter(sim).agg(F.median("_noise").alias("_mid"), F.count("_latency").alias("_late"))
    joined = joined.crossJoin(F.broadcast(known))  # one row
    noise, latency, mid, late = F.col("_noise"), F.col("_latency"), F.col("_mid"), F.col("_late") > 0
    marks = {
        "knob:noise_low": mid.isNotNull() & (~sim | (noise <= mid)),
        "knob:noise_high": mid.isNotNull() & (~sim | (noise > mid)),
        "knob:latency_0": late & (~sim | (latency == 0)),
        "knob:latency_gt0": late & (~sim | (latency > 0)),
    }
    names = F.filter(F.array(*[F.when(m, F.lit(n)) for n, m in marks.items()]), lambda x: x.isNotNull())
    return base.unionByName(joined.withColumn("slice", F.explode(names)).select(*base.columns))


def slice_aucs(rows: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """groups, slice, n, n_pos, n_neg, auc, skipped: with under two of a class or four rows, no AUC."""
    got = auc_roc(rows, [*groups, "slice"])
    few = (F.col("n_pos") < 2) | (F.col("n_neg") < 2) | (F.col("n") < 4)
    return got.withColumn("skipped", few).withColumn("auc", F.when(~few, F.col("auc")))


def baseline_json(report: DataFrame) -> str:
    """Of (slice, auc, ci_low, ci_high, n), one row a slice."""
    rows = report.select("slice", "auc", "ci_low", "ci_high", "n").collect()
    return json.dumps({"schema": SCHEMA_TAG, "slices": {r[0]: {"auc": r[1], "ci_low": r[2], "ci_high": r[3], "n": r[4]} for r in rows}}, sort_keys=True)


def read_baseline(spark: SparkSession, text: str) -> DataFrame:
    kind = "struct<schema:string, slices:map<string, struct<auc:double, ci_low:double, ci_high:double, n:bigint>>>"
    got = spark.createDataFrame([(text,)], "j string").select(F.explode(F.from_json("j", kind)["slices"]).alias("slice", "v"))
    return got.select("slice", "v.*")


def regression_gate(base: DataFrame, current: DataFrame, tolerance: float = 0.05, least: int = 30) -> DataFrame:
    """slice, status of every baseline slice: missing, few, worse or kept. Worse: the intervals don't meet and the AUC fell
    by more than the tolerance."""
    b = base.select("slice", *[F.col(c).alias(f"base_{c}") for c in ("auc", "ci_low", "n")])
    c = current.select("slice", *[F.col(x).alias(f"cur_{x}") for x in ("auc", "ci_high", "n")], F.lit(True).alias("_there"))
    status = (
        F.when(F.col("_there").isNull() | F.col("cur_auc").isNull(), "missing")
        .when((F.col("base_n") < least) | (F.col("cur_n") < least), "few")
        .when((F.col("cur_ci_high") < F.col("base_ci_low")) & (F.col("base_auc") - F.col("cur_auc") > tolerance), "worse")
        .otherwise("kept")
    )
    return b.join(c, "slice", "left").select("slice", status.alias("status"), status.isin("missing", "worse").alias("violates"))


def flattened(tree: Any, at: str = "") -> dict[str, Any]:
    """Leaves of nested records and lists by dotted path."""
    if isinstance(tree, Mapping):
        items = tree.items()
    elif isinstance(tree, list):
        items = enumerate(tree)
    else:
        return {at: tree}
    out: dict[str, Any] = {}
    for k, v in items:
        out |= flattened(v, f"{at}.{k}" if at else str(k))
    return out


def metric_diff(expected: DataFrame, actual: DataFrame, tolerance: float = 1e-6, ignored: tuple[str, ...] = ("elapsed_s",)) -> DataFrame:
    """path, expected, actual, problem (missing, extra, differs) of (path, value double) frames; NaN equals NaN."""
    e, a = expected.select("path", F.col("value").alias("expected"), F.lit(True).alias("_e")), actual.select("path", F.col("value").alias("actual"), F.lit(True).alias("_a"))
    both = e.join(a, "path", "full").filter(~F.element_at(F.split("path", r"\."), -1).isin(*ignored))
    same = F.col("expected").eqNullSafe(F.col("actual")) | (F.abs(F.col("expected") - F.col("actual")) <= tolerance)
    problem = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(~F.coalesce(same, F.lit(False)), "differs")
    return both.select("path", "expected", "actual", problem.alias("problem")).filter("problem is not null")
