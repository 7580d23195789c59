"""Table schemas, fixed vocabularies and natural keys."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The three lesson situations, the intervention phases and the study roles.
SITUATIONS = ("聞く", "書く", "話し合う")
PHASES = ("normal", "pre", "post", "pilot_post")
ROLES = ("development", "external_validation", "trial")
EVENT_PHASES = ("pre", "AB", "cooldown", "post")
UNSET_SITUATION = "(未設定)"
SCORES = tuple(range(1, 8))


_BOX = "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
DDL: dict[str, str] = {
    "videos": "dataset_id STRING, id BIGINT, path STRING, fps DOUBLE, width INT, height INT, frame_count BIGINT",
    "tracks": "dataset_id STRING, video_id BIGINT, track_id BIGINT",
    "detections": f"dataset_id STRING, id BIGINT, video_id BIGINT, frame_idx BIGINT, t DOUBLE, track_id BIGINT, {_BOX}, conf DOUBLE",
    "windows": "dataset_id STRING, id BIGINT, video_id BIGINT, t_start DOUBLE, t_end DOUBLE, situation STRING, "
               "situation_set_by STRING, situation_updated_at TIMESTAMP, situation_locked BOOLEAN",
    "segments": "dataset_id STRING, id BIGINT, window_id BIGINT, track_id BIGINT",
    "segment_frames": f"dataset_id STRING, id BIGINT, segment_id BIGINT, t DOUBLE, frame_idx BIGINT, {_BOX}, "
                      "crop_path STRING, pose_path STRING",
    "labels": "dataset_id STRING, segment_id BIGINT, rater STRING, score INT, created_at TIMESTAMP, updated_at TIMESTAMP",
    "window_skips": "dataset_id STRING, rater STRING, window_id BIGINT, created_at TIMESTAMP",
    "excluded_segments": "dataset_id STRING, segment_id BIGINT, reason STRING, excluded_by STRING, created_at TIMESTAMP",
    "label_events": "dataset_id STRING, id BIGINT, created_at TIMESTAMP, rater STRING, action STRING, segment_id BIGINT, "
                    "old_score INT, new_score INT",
    "predictions": "video_path STRING, frame_idx BIGINT, t DOUBLE, track_id BIGINT, stable_id BIGINT, score DOUBLE, "
                   f"score_clamped INT, situation STRING, situation_confidence DOUBLE, situation_probs STRING, det_conf DOUBLE, {_BOX}, "
                   "situation_override STRING, situation_override_note STRING",
    "situation_overrides": "id BIGINT, video_path STRING, start_sec DOUBLE, end_sec DOUBLE, situation STRING, note STRING, "
                           "applied_at TIMESTAMP",
    "research_metadata": "dataset_id STRING, school_id STRING, grade STRING, class_id STRING, session_id STRING, "
                         "intervention_phase STRING, study_role STRING, minutes_since_intervention DOUBLE, updated_at TIMESTAMP",
    "blind_assignments": "dataset_id STRING, rater STRING, segment_id BIGINT, blind_code STRING, display_order BIGINT",
    "label_observations": "dataset_id STRING, segment_id BIGINT, rater STRING, source_clip_start DOUBLE, source_clip_end DOUBLE, "
                          "source_clip_sec DOUBLE, updated_at TIMESTAMP",
    "label_consensus": "dataset_id STRING, segment_id BIGINT, mean_score DOUBLE, rater_count BIGINT, score_std DOUBLE, "
                       "score_min INT, score_max INT",
    "merge_sources": "source_name STRING, source_sha256 STRING, label_count BIGINT, raters STRING",
    "trial": "school_id STRING, class_id STRING, session_id STRING, phase STRING, time_bin STRING, classroom_score DOUBLE",
    "pairs": "school_id STRING, phase STRING, human_score DOUBLE, model_score DOUBLE",
    "evaluation": "db_index INT, segment_id BIGINT, track_id BIGINT, video_id BIGINT, t_start DOUBLE, t_end DOUBLE, situation STRING, "
                  "predicted_situation STRING, situation_confidence DOUBLE, situation_probs STRING, true_score DOUBLE, "
                  "pred_score DOUBLE, score_error DOUBLE, true_class INT, pred_class INT",
    "cv_summary": "variant STRING, seed INT, fold INT, situation_epoch INT, epoch INT, val_mse DOUBLE, val_mae DOUBLE, "
                  "val_qwk DOUBLE, val_exact_accuracy DOUBLE, val_constant_baseline DOUBLE",
}

# Declared unique keys; every per-store id is qualified by its dataset.
UNIQUE_KEYS: dict[str, list[list[str]]] = {
    "videos": [["dataset_id", "id"], ["dataset_id", "path"]],
    "tracks": [["dataset_id", "video_id", "track_id"]],
    "windows": [["dataset_id", "id"], ["dataset_id", "video_id", "t_start", "t_end"]],
    "segments": [["dataset_id", "id"], ["dataset_id", "window_id", "track_id"]],
    "segment_frames": [["dataset_id", "segment_id", "t"]],
    "labels": [["dataset_id", "segment_id", "rater"]],
    "window_skips": [["dataset_id", "rater", "window_id"]],
    "excluded_segments": [["dataset_id", "segment_id"]],
    "blind_assignments": [["dataset_id", "rater", "segment_id"], ["dataset_id", "rater", "blind_code"],
                          ["dataset_id", "rater", "display_order"]],
}

POSE_JSON = "struct<keypoints:array<array<double>>>"
KEYPOINTS = 17


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(DDL[table])


def conform(df: DataFrame, table: str, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Cast to a table's schema; absent columns become their default or NULL, unknown (retired) columns are dropped."""
    defaults = dict(defaults or {})
    have = set(df.columns)

    def one(field: T.StructField) -> Column:
        source = F.col(field.name) if field.name in have else F.lit(defaults.get(field.name))
        return source.cast(field.dataType).alias(field.name)

    return df.select(*[one(f) for f in schema(table).fields])


def missing_columns(df: DataFrame, required: set[str]) -> list[str]:
    return sorted(required - set(df.columns))


def require_columns(df: DataFrame, required: set[str], what: str = "table") -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")
    return df
