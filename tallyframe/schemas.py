"""Declared schemas (DDL text) of the tables the jobs exchange."""

from __future__ import annotations

ANNOTATIONS = (
    "id string, video string, procedure_type string, question string, answer string, "
    "answer_format string, track string, generation string, clinical_relevance boolean, "
    "ood boolean, timestamp_start string, timestamp_end string, primary_capability string, "
    "secondary_capabilities array<string>"
)

PREDICTIONS = (
    "sample_id string, model_name string, question string, answer string, answer_format string, "
    "primary_capability string, secondary_capabilities string, clinical_relevance boolean, "
    "ood boolean, video string, timestamp_start string, timestamp_end string, image_path string, "
    "frame_paths string, frame_timestamps string, n_frames int, prompt string, "
    "raw_model_output string, normalized_prediction string, prediction string, "
    "latency_sec double, error string"
)

RESULTS = (
    "qID string, video string, ood string, clinical string, primary string, "
    "answer_format string, latency double, timed_out string, correctness string"
)

SUMMARY = (
    "level string, name string, accuracy double, ci_low double, ci_high double, count long"
)

VIEWS = (
    "sample_id string, dataset string, video string, question string, answer string, "
    "count_mode string, target string, view_id string, view_kind string, "
    "raw_model_output string, answer_text string, value string, latency_sec double, error string"
)

REQUESTS = (
    "qID string, videoID string, start_time double, end_time double, "
    "procedure_type string, question string"
)

RESPONSES = ("qID string, content string, latency double")

BOXES = (
    "case_id string, box_id string, class_name string, x double, y double, width double, "
    "height double, difficult boolean, uncertain boolean"
)

REVISIONS = (
    "timestamp timestamp, case_id string, revision long, previous_status string, "
    "status string, box_count int, client string"
)

EPOCH_METRICS = ("epoch int, dataset string, accuracy double, global_step long")
