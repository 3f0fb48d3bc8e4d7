"""Declared schemas of the engine's tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

CHANNELS = ("t", "x", "y", "heading", "speed", "yaw_rate")
FEATURES = (
    "speed_mean speed_std speed_max speed_min accel_mean accel_std accel_max jerk_mean jerk_std jerk_max jerk_p95 "
    "lat_accel_mean lat_accel_std lat_accel_max lat_accel_p95 lat_accel_rms yaw_psd_0_2hz yaw_psd_2_5hz yaw_psd_total yaw_psd_ratio "
    "curvature_mean curvature_p95 curv_speed_corr heading_rate_mean heading_rate_std heading_rate_max heading_smoothness "
    "ttc_stop_mean ttc_stop_min ttc_path_end_min"
).split()


def fields(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def ddl(names, kind: str) -> str:
    return ", ".join(f"{n} {kind}" for n in names)


SEGMENTS_DDL = "segment_id bigint, scene_id string, source string, agent_token string, " + ddl(CHANNELS, "double")
LABELS_DDL = "segment_id bigint, scene_id string, source string, agent_token string, maneuver string, split string, config_json string"
FEATURES_DDL = "segment_id bigint, scene_id string, source string, " + ddl(FEATURES, "double")
PREDICTIONS_DDL = "segment_id bigint, scene_id string, source string, maneuver string, split string, prob_sim double"
CONFIG_DDL = "accel double, config_seed bigint, dt double, heading_noise_std double, latency_steps bigint, lookahead_gain double, max_accel double, max_decel double, max_steer double, min_lookahead double, pos_noise_std double, steer_bias double, steer_noise_std double, wheelbase double"
SWEEP_DDL = (
    "config_id string, knob_noise string, knob_latency bigint, knob_bias double, model string, split_used string, scope string, slice_name string, n bigint, n_pos bigint, n_neg bigint, "
    "auc double, ci_low double, ci_high double, auc_pr double, brier double, ece double, ece_ci_low double, ece_ci_high double, mce double, ece_after_platt double, ece_after_isotonic double, p_perm double"
)
