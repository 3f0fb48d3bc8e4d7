"""Evaluation of scored runs: figures of the evaluated split, the report over its slices, the gate's state, and the sweep's table.

Everything takes ``groups``, so that many runs, by configuration and model, are one plan: a figure is the same aggregation with more keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.running import with_ranges
from ..session import saved
from . import calibration, inference, metrics, slices, splits


def slice_report(rows: DataFrame, cluster: str = "scene_id", row_id: str = "segment_id", replicates: int = 2000, permutations: int = 1000, seed: int = 0, alpha: float = 0.05, groups: Sequence[str] = (), counted: bool = True) -> DataFrame:
    """groups, slice, n, n_pos, n_neg, auc, skipped, ci_low, ci_high, p_perm, p_adj of rows (groups, slice, y, p, cluster, row_id):
    intervals by clusters, p-values under shuffled labels (by counted draws, or by a draw a row), adjusted over a group's slices that aren't
    skipped. All slices in one plan, over the rows' few columns and their ranges, saved once, as every figure reads them."""
    by = [*groups, "slice"]
    rows = saved(with_ranges(rows.select(*by, "y", "p", cluster, row_id), "p"), "slices")
    aucs = saved(slices.slice_aucs(rows, groups), "slice-aucs")  # a row a slice
    judged = aucs.filter("not skipped")
    kept = rows.join(judged.select(*by), by)
    ends = inference.bca_intervals(inference.bootstrap_auc(kept, cluster, replicates, seed, by), inference.jackknife_auc(kept, cluster, by), judged, by, alpha)
    null = inference.counted_permutation_auc(kept, permutations, seed, by) if counted else inference.permutation_auc(kept, row_id, permutations, seed, by)
    tested = inference.adjusted(inference.p_values(null, judged, by), "p_perm", groups, row_id="slice")
    return aucs.join(ends.drop("auc"), by, "left").join(tested, by, "left")


def overall_figures(rows: DataFrame, cluster: str = "scene_id", row_id: str = "segment_id", bins: int = 15, replicates: int = 2000, permutations: int = 1000, seed: int = 0, alpha: float = 0.05, groups: Sequence[str] = ()) -> DataFrame:
    """A row, or a row a group: every metric of rows (groups, y, p, cluster, row_id), with the intervals of AUC and calibration error and
    a p-value. The rows' few columns and their ranges are saved once, as every figure reads them."""
    rows = saved(with_ranges(rows.select(*groups, "y", "p", cluster, row_id), "p"), "figures")
    aucs = saved(metrics.auc_roc(rows, groups), "aucs")
    ends = inference.bca_intervals(inference.bootstrap_auc(rows, cluster, replicates, seed, groups), inference.jackknife_auc(rows, cluster, groups), aucs, groups, alpha)
    errors = metrics._total(inference.bootstrap_ece(rows, cluster, bins, replicates, seed, groups), groups, F.percentile("stat", alpha / 2).alias("ece_ci_low"), F.percentile("stat", 1 - alpha / 2).alias("ece_ci_high"))
    tested = inference.p_values(inference.counted_permutation_auc(rows, permutations, seed, groups), aucs, groups)
    out = aucs
    for more in (metrics.auc_pr(rows, groups), metrics.brier(rows, groups), metrics.calibration_error(rows, bins, groups, row_id), metrics.youden(rows, groups), ends.drop("auc"), errors, tested):
        out = inference.beside(out, more, groups)
    return out


def _judged(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("y", (F.col("source") == "sim").cast("int")).withColumnRenamed("prob_sim", "p")


@dataclass
class Evaluation:
    """A run; each part is worked out when it is first asked for."""

    rows: DataFrame
    configs: DataFrame | None
    baseline: DataFrame | None
    bins: int
    resampling: dict[str, float]

    @cached_property
    def used(self) -> DataFrame:
        return splits.evaluated_split(self.rows)

    @cached_property
    def split_used(self) -> str | None:
        return next((r[0] for r in self.used.select("split").limit(1).collect()), None)

    @cached_property
    def overall(self) -> DataFrame:
        return overall_figures(self.used, bins=self.bins, **self.resampling)

    @cached_property
    def slices(self) -> DataFrame:
        return saved(slice_report(slices.sliced(self.used, self.configs), **self.resampling), "report")  # a row a slice

    @cached_property
    def calibration(self) -> DataFrame | None:
        val = self.rows.filter("split = 'val'").withColumn("row_id", F.col("segment_id"))
        if val.limit(2).count() < 2:
            return None
        return calibration.recalibrated(val, self.used.withColumn("row_id", F.col("segment_id")), self.bins)

    @cached_property
    def gate(self) -> DataFrame | None:
        return None if self.baseline is None else slices.regression_gate(self.baseline, self.slices.filter("not skipped"))

    def exit_state(self) -> int:
        """1 if a slice violates the baseline, else 0."""
        return int(self.gate is not None and bool(self.gate.filter("violates").limit(1).count()))


def evaluate(predictions: DataFrame, configs: DataFrame | None = None, baseline: DataFrame | None = None, bins: int = 15, **resampling: float) -> Evaluation:
    """Of predictions (segment_id, scene_id, source, maneuver, split, prob_sim): the test split, or val, or train if there is
    nothing before it. Recalibration is fitted on val, if there is one. ``baseline``: slice, auc, ci_low, ci_high, n."""
    return Evaluation(saved(_judged(predictions), "predictions"), configs, baseline, bins, resampling)


KNOBS = ("knob_noise", "knob_latency", "knob_bias")
RUN = ("config_id", "model")


def _as_sweep(df: DataFrame) -> DataFrame:
    """The sweep's columns in order, null where ``df`` has none."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.fields(schemas.SWEEP_DDL)])


def _scopes(overall: DataFrame, report: DataFrame) -> DataFrame:
    """Overall rows, and rows of the maneuvers' slices with what a slice has."""
    kept = ["config_id", *KNOBS, "model", "split_used", "n", "n_pos", "n_neg", "auc", "ci_low", "ci_high"]
    parts = report.filter("not skipped and slice like 'maneuver:%'").select(*[c for c in kept if c in report.columns], F.col("slice").alias("slice_name"))
    return _as_sweep(overall.withColumns({"scope": F.lit("overall"), "slice_name": F.lit(None).cast("string")})).union(_as_sweep(parts.withColumn("scope", F.lit("slice"))))


def sweep_row(evaluation: Evaluation, config_id: str, noise: str, latency: int, bias: float, model: str) -> DataFrame:
    """Overall and maneuver rows of one run, as the table of a sweep has them; what a scope lacks is null."""
    head = {"config_id": F.lit(config_id), "knob_noise": F.lit(noise), "knob_latency": F.lit(latency).cast("bigint"), "knob_bias": F.lit(float(bias)), "model": F.lit(model), "split_used": F.lit(evaluation.split_used)}
    overall = evaluation.overall.withColumns(head)
    if evaluation.calibration is not None:
        after = evaluation.calibration.agg(*[F.max(F.when(F.col("method") == m, F.col("ece"))).alias(f"ece_after_{m}") for m in ("platt", "isotonic")])
        overall = inference.beside(overall, after)
    return _scopes(overall, evaluation.slices.withColumns(head))


def sweep_rows(predictions: DataFrame, recalibrated: DataFrame | None = None, bins: int = 15, **resampling: float) -> DataFrame:
    """The sweep's table for all runs at once, of predictions with config_id, the knobs and model before them. A run's rows have one value
    of each knob. ``recalibrated``: config_id, model, ece_after_platt, ece_after_isotonic, from runs that have a val split."""
    rows = saved(splits.evaluated_split(_judged(predictions), groups=RUN), "runs")
    about = rows.groupBy(*RUN).agg(*[F.min(k).alias(k) for k in KNOBS], F.min("split").alias("split_used"))
    overall = overall_figures(rows, bins=bins, groups=RUN, **resampling).join(about, list(RUN))
    if recalibrated is not None:
        overall = overall.join(recalibrated, list(RUN), "left")
    return _scopes(overall, slice_report(slices.sliced(rows), groups=RUN, **resampling).join(about, list(RUN)))
